"""DuckDB SQL of the queries that SQL can express.

Nearest neighbours (hashing decides what is found), byte BPE, the classifier, the suffix
sort, fingerprints and surrogates have none; their tests use brute-force versions.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), level(n, capped, height) AS (
  SELECT 0, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT l.n + 1, x.capped, x.height FROM level l, LATERAL (
    SELECT count(*) FILTER (2.0 * source_size <= weight * l.height) AS capped,
           (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size <= weight * l.height), 0))
             / sum(weight) FILTER (NOT 2.0 * source_size <= weight * l.height) AS height
    FROM sources) x
  WHERE x.height IS NOT NULL AND x.capped <> l.capped
), goal AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT arg_max(height, n) FROM level)) AS target FROM sources
), drawn AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || coalesce(s.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS chance
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copied AS (
  SELECT *, CAST(floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""

OP3 = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), spoken AS (
  SELECT doc_id, i, line,
         lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third, lead(i, 2) OVER w AS last
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, last, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, i) AS occurrence
  FROM spoken WHERE last IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, last)) AS i FROM windows WHERE occurrence > 1
), marked AS (
  SELECT l.*, c.i IS NOT NULL AS gone FROM lines l LEFT JOIN covered c USING (doc_id, i)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

_HOST = r"rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.')"
_PATH = r"trim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)', 1), '/')"

OP5 = rf"""
WITH parsed AS (
  SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, 1704067200 + (page_id * 290021) % (366 * 86400) AS fetched FROM pages
), patterns AS (
  SELECT DISTINCT 'domain' AS kind, array_to_string(string_split(host, '.')[-3:], '.') AS pattern FROM parsed
  UNION SELECT DISTINCT 'prefix', host || '/' || string_split(path, '/')[1] FROM parsed
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS h FROM patterns
), entries AS (
  SELECT 'spam' AS list, pattern, 'add' AS action, h % 181 AS day FROM hashed WHERE kind = 'domain' AND h % 3 = 0
  UNION ALL SELECT 'spam', pattern, 'remove', h % 181 + 60 FROM hashed WHERE kind = 'domain' AND h % 3 = 0
  UNION ALL SELECT 'spam', pattern, 'add', h % 181 + 120 FROM hashed WHERE kind = 'domain' AND h % 3 = 0
  UNION ALL SELECT 'adult', pattern, 'add', h % 307 FROM hashed WHERE kind = 'domain' AND h % 5 = 0
  UNION ALL SELECT 'trusted', pattern, 'add', h % 101 FROM hashed WHERE kind = 'domain' AND h % 7 = 0
  UNION ALL SELECT 'trusted', pattern, 'remove', h % 101 + 100 FROM hashed WHERE kind = 'domain' AND h % 7 = 0
  UNION ALL SELECT 'paths', pattern, 'add', h % 211 FROM hashed WHERE kind = 'prefix' AND h % 4 = 0
  UNION ALL SELECT 'paths', pattern, 'add', h % 211 + 50 FROM hashed WHERE kind = 'prefix' AND h % 4 = 0
), last AS (
  SELECT p.page_id, e.list, e.pattern, arg_max(e.action, e.day) AS action
  FROM parsed p JOIN entries e
    ON (p.host = e.pattern OR ends_with(p.host, '.' || e.pattern) OR p.host || '/' || p.path = e.pattern OR starts_with(p.host || '/' || p.path, e.pattern || '/') AND contains(e.pattern, '/'))
   AND 1704067200 + e.day * 86400 <= p.fetched
  GROUP BY ALL
), matched AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM last WHERE action = 'add' GROUP BY page_id
)
SELECT p.page_id, coalesce(m.lists, '') AS lists, CAST(coalesce(m.n, 0) AS BIGINT) AS n_matches,
       coalesce(m.lists, '') <> '' AND NOT contains(coalesce(m.lists, ''), 'trusted') AS blocked
FROM parsed p LEFT JOIN matched m USING (page_id)
"""

#: Measure: units, numerator, denominator, has a lower threshold, percentiles, fence.
_MEASURES = {
    "chars": (100, "word_chars", "n_words", True, (95, 99), 1),
    "symbols": (1000, "n_symbols", "n_words", False, (95, 99), 1),
    "dups": (1000, "n_dup_lines", "n_lines", False, (99,), 0),
    "repeats": (1000, "n_repeat_words", "n_words", False, (99,), 0),
}


def _bin(units: int, x: str, y: str) -> str:
    """The measure in units, its low bits beyond the first six cleared."""
    v = f"({units} * {x} // nullif({y}, 0))"
    return f"CAST({v} - {v} % CAST(pow(2, greatest(0, length(bin({v})) - 6)) AS BIGINT) AS BIGINT)"


def _quantile(m: str, percent: int) -> str:
    """The smallest value that at least this share of the values doesn't exceed."""
    return f"list_sort(list({m}) FILTER ({m} IS NOT NULL))[greatest(1, ({percent} * count({m}) + 99) // 100)]"


def _fences() -> str:
    out = []
    for m, (_, _, _, lower, levels, fence) in _MEASURES.items():
        q = {p: _quantile(m, p) for p in (1, 5, 50, 95, 99)}
        top = "coalesce(" + ", ".join([f"CASE WHEN {q[p]} > {q[50]} THEN {q[p]} END" for p in levels] + [q[99]]) + ")"
        low = "coalesce(" + ", ".join([f"CASE WHEN {q[100 - p]} < {q[50]} THEN {q[100 - p]} END" for p in levels] + [q[1]]) + ")"
        out += [f"{low} - {fence} * ({q[50]} - {low}) AS {m}_low" if lower else f"CAST(NULL AS BIGINT) AS {m}_low", f"{top} + {fence} * ({top} - {q[50]}) AS {m}_high"]
    return "count(*) AS n, " + ", ".join(out)


def _within() -> str:
    pick = lambda x: f"CASE WHEN g.n >= 200 THEN g.{x} WHEN l.n >= 200 THEN l.{x} ELSE e.{x} END"
    return " AND ".join(f"coalesce({m} <= {pick(m + '_high')}, true) AND coalesce({m} >= {pick(m + '_low')}, true)" for m in _MEASURES)


OP6 = rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), starts AS (
  SELECT doc_id, w[i:i + 7] AS words, i FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM starts) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{_bin(*x[:3])} AS {m}" for m, x in _MEASURES.items())}
  FROM counted
), passed AS (SELECT * FROM measured WHERE NOT base_failed),
g AS (SELECT lang, source, {_fences()} FROM passed GROUP BY lang, source),
l AS (SELECT lang, {_fences()} FROM passed GROUP BY lang),
e AS (SELECT {_fences()} FROM passed)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_within()} AS kept
FROM measured m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN e
"""

OP11 = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) AS i FROM split)
), least AS (
  SELECT k, min(doc_id) AS m FROM starts GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 13)) AS j FROM starts s JOIN least USING (k) WHERE s.doc_id > m
), marked AS (
  SELECT w.doc_id, w.j, w.word, g.j IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM split) w LEFT JOIN gone g USING (doc_id, j)
), cut AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN cut USING (doc_id)
"""


def _codes(rounds: int = 2) -> str:
    """The rounds of assignment and means, one CTE after the other; a part's entry is the least of distance * 64 + index."""
    out = [
        "vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM vectors, range(16) r(p))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vectors ORDER BY vec_id LIMIT 64)",
        "book0 AS (SELECT p, e, x AS c FROM parts JOIN firsts USING (vec_id))",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        out.append(f"near{k} AS (SELECT vec_id, p, any_value(x) AS x, min(CAST({distance} AS BIGINT) * 64 + e) AS best FROM parts JOIN book{k} USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            out.append(f"sums{k} AS (SELECT p, best % 64 AS e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{k}) GROUP BY ALL)")
            out.append(f"means{k} AS (SELECT p, e, list(CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) ORDER BY j) AS m FROM sums{k} GROUP BY p, e)")
            out.append(f"book{k + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN means{k} USING (p, e))")
    return ",\n".join(out)


OP12 = f"""
WITH {_codes()}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near2 JOIN vectors USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""

OP13 = rf"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN known USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), f AS (SELECT unnest(range(5)) AS f), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda x: chr(CAST(65 + x AS INTEGER))), '') AS filter_order, CAST(s AS INTEGER) AS step, CAST(1 << o[s] AS BIGINT) AS bit,
         CAST(coalesce(list_sum(list_transform(o[1:s - 1], lambda x: 1 << x)), 0) AS BIGINT) AS before
  FROM orders, range(1, 6) r(s)
), audited AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM audited
"""

ORACLE: dict[str, str] = {"op2_mixing": OP2, "op3_line_dedup": OP3, "op5_url_filter": OP5, "op6_quality": OP6, "op11_recompression": OP11, "op12_vector_codes": OP12, "op13_filter_audit": OP13}
