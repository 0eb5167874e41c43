"""Text operators against brute force, with nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("seedspread.llm")

from pyspark.sql import functions as F  # noqa: E402

from seedspread.llm import bpe, components, linededup, mixing, quality, repeats, simhash, suffixes, surrogates, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: doc_id, text, source, and columns named like results
SCHEMA = "doc_id long, text string, lang string, source string, size string, fingerprint string, score string, kept string, n_lines string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
CASES = [
    (1, "a b c", "en", "s1"),
    (2, None, "en", "s1"),
    (None, "", None, None),
    (None, "  \t\n ", None, None),
    (3, "Repeated Row here", "en", "s2"),
    (3, "Repeated Row here", "en", "s2"),
    (4, LONG, "de", "s2"),
    (5, "line one x\nline two y\nline three z\nline four", None, "é"),
    (6, "line one x\nline two y\n\nline three z", "en", "\U0001f600"),
    (7, "same", "en", "s3"),
    (8, "same", "en", "s3"),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(*c, "own", "own", "own", "own", "own") for c in CASES], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


# mixing ------------------------------------------------------------------------


def filled(sizes, weights, share, cap):
    """Capped shares, by giving out the excess again and again."""
    left = share * sum(sizes.values())
    got = dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s]}
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        given = left
        for s in sorted(open_):
            add = min(given * weights[s] / total, cap * sizes[s] - got[s])
            got[s] += add
            left -= add
        open_ = {s for s in open_ if got[s] < cap * sizes[s] - 1e-9}
    return got


def test_mix_targets_and_copies(small):
    rows = mixing.mix(small).collect()
    sizes = Counter()
    for r in small.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: s.encode())
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    assert len(rows) == small.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * r.copies and r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
        assert r.taken <= 2 * r["size"]
    again = mixing.mix(small.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.emit(small).count() == sum(r.copies for r in rows)
    assert mixing.emit(small).columns == small.columns


def test_draw_is_uniform(spark):
    got = spark.range(20_000).select(mixing.draw(1, F.col("id")).alias("u")).toPandas().u
    assert abs(got.mean() - 0.5) < 0.01 and abs((got < 0.25).mean() - 0.25) < 0.01


def test_mix_cases(cases, empty):
    rows = mixing.mix(cases).collect()
    assert len(rows) == len(CASES)
    assert {r.taken for r in rows if not r.text or not WORD.findall(r.text)} == {0}
    null = [r for r in rows if r.source is None]
    assert len(null) == 2 and all(r.source_size == 0 and r.target == 0 and r.copies == 0 for r in null)
    assert all(isinstance(r["size"], int) for r in rows)
    twice = [r.copies for r in rows if r.doc_id == 3]
    assert twice[0] == twice[1]
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).columns == empty.columns


# line dedup --------------------------------------------------------------------


def test_line_dedup_cases(cases, empty):
    rows = {(r.doc_id, r.text): r for r in linededup.without_repeats(cases).collect()}
    texts = {k[0]: k[1] for k in rows if k[0]}
    assert texts[5] == CASES[7][1] and texts[6] == ""  # the blank line between covered ones goes too
    assert texts[2] is None and texts[1] == "a b c" and texts[4] == LONG
    assert rows[6, ""].n_removed == 4 and rows[2, None].n_lines == 0
    out = linededup.without_repeats(cases, counts=False)
    assert out.columns == cases.columns and out.count() == len(CASES)
    assert linededup.without_repeats(empty).count() == 0


def test_line_dedup_keeps_first_line_everywhere(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "x\na\na\na\ny"), (3, "p\nq\nr\ns"), (4, "q\nr\ns\nt"), (None, "p\nq\nr")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert got == {1: "a", 2: "x\ny", 3: "p\nq\nr\ns", 4: "t", None: ""}


# quality -----------------------------------------------------------------------


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(small, cases):
    for docs in (small, cases):
        for r in quality.features(docs, keep=["doc_id", "text"]).collect():
            n = counts(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_quality_thresholds_adapt(spark, empty, cases):
    plain = " ".join(["alpha beta gamma delta epsilon"] * 1 + [f"word{k}" for k in range(40)])
    dense = " ".join(f"w{k}###" for k in range(40))
    rows = [(k, f"{plain} {k} t{k}", "en", "prose") for k in range(300)] + [(1000 + k, f"{dense} {k}", "en", "code") for k in range(300)]
    rows += [(5000, dense, "en", "prose"), (5001, f"{dense} more words", "en", "code"), (5002, "x " * 30, "en", "prose")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=["doc_id"]).collect()}
    assert not got[5000].kept and not got[5000].base_failed  # symbols are usual in code, not in prose
    assert got[5001].kept and not got[5002].kept
    assert all(got[k].kept for k in range(300)) and all(got[1000 + k].kept for k in range(300))
    assert quality.judged(empty, keep=["doc_id"]).count() == 0
    judged = quality.judged(cases, keep=["doc_id", "kept"])
    assert judged.count() == len(CASES) and judged.columns.count("kept") == 1


def test_quality_limits_come_from_the_groups(spark):
    """At sf0.1 every group of 200 rows has its own limits, below the base rule's; two runs agree whatever the order."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", "source", "text")
    limits = []
    for parts in (3, 11):
        rows = quality.features(docs.repartition(parts), "text", ["lang", "source"]).where("not base_failed").select("*", *quality.rounded())
        parts_of = quality.sketches(rows, ["lang", "source"])
        limits.append({(r.lang, r.source): r for r in quality.fences(parts_of, ["lang", "source"]).collect()})
    assert limits[0] == limits[1]
    big = [r for r in limits[0].values() if r.n >= 200]
    assert len(big) >= 15 and all(0 < r.repeat_word_share_high < 300 and 0 < r.dup_line_share_high < 1000 for r in big)
    for m in quality.MEASURES:
        assert len({r[f"{m}_high"] for r in big}) > 3
    coarse = quality.fences(quality.merged(parts_of, ["lang"]), ["lang"]).collect()
    whole = quality.fences(quality.sketches(rows, ["lang"]), ["lang"]).collect()
    assert {r.lang: r for r in coarse} == {r.lang: r for r in whole}


# byte-level BPE ----------------------------------------------------------------


def test_bpe_equals_tiktoken_and_round_trips(spark, small, cases, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    vocabulary = bpe.Vocabulary(spark, path, P.PATTERN)
    odd = spark.createDataFrame([(1, "<|endoftext|> café \U0001f44d\U0001f3fd ½Ⅷ \x1c\x85 � it's"), (2, "\U000325e5't ٠١ 　　x")], "doc_id long, text string")
    for docs in (small, cases, odd):
        for r in bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary, spans_col="at", packed_col="packed"), vocabulary).collect():
            text = r.text or ""
            assert bytes(r.packed) == np.array(r.ids, "<u4").tobytes()
            assert r.ids == own.encode_ordinary(text)
            assert bytes(r.decoded) == text.encode()
            if len(text) < 10_000:
                for k, (a, b) in enumerate(zip(r.at_start, r.at_end, strict=True)):
                    assert own.decode_single_token_bytes(r.ids[k]) in text[a:b].encode()
    assert bpe.encode(empty, vocabulary).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocabulary).first().decoded == b""


def test_bpe_cuts_change_no_id(small, monkeypatch):
    import public_tokenizers as P

    own = bpe.Encoder(bpe.model_json(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), P.PATTERN)
    texts = [r.text for r in small.limit(60).collect()] + ["a  b \n\n c", "x" * 500, " " * 300, "a　 b" * 50]
    whole = [own.encode(t)[0] for t in texts]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(bpe, "MEMO", 50)
    assert [own.encode(t)[0] for t in texts] == whole


# toxicity ----------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.scored(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    wrong = sum((r.score >= 0.7) != (r.toxic == 1) for r in rows)
    caught = sum(r.score >= 0.7 for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert wrong / len(rows) < 0.1 and caught > 0.6
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_cases(spark, cases, empty):
    words = ["vile", "scum", "fine", "good", "calm", "kind"]
    docs = spark.createDataFrame([(k, f"{words[k % 6]} text {words[(k // 6) % 6]} number{k % 7}") for k in range(240)], "doc_id long, text string")
    labels = docs.select("doc_id", F.col("text").rlike("vile|scum").cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(spark.createDataFrame([(1, "such scum"), (2, "kind and calm"), (3, None), (4, "")], "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.7 > by[2] and by[3] == by[4]
    scored = toxicity.scored(cases, model)
    assert scored.count() == len(CASES) and dict(scored.dtypes)["score"] == "double"
    for few in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit(docs, few)
        assert {r.score for r in toxicity.scored(docs, none).collect()} == {toxicity.NO_MODEL}
    assert toxicity.scored(empty, model).count() == 0


# SimHash -----------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, bits):
    todo, out = dict(enumerate(prints)), [None] * len(prints)
    for k in range(len(prints)):
        if out[k] is None:
            out[k], stack = k, [k]
            while stack:
                a = stack.pop()
                for b in list(todo):
                    if out[b] is None and (prints[a] ^ prints[b]).bit_count() <= bits:
                        out[b] = k
                        stack.append(b)
    return out


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_simhash_equals_brute_force(small, cases):
    for docs in (small, cases):
        rows = simhash.near_duplicates(docs, keep=["doc_id", "text"]).collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        assert [r.fingerprint % (1 << 64) for r in rows] == prints
        want = brute_components(prints, 4)
        assert same_partition([r.root for r in rows], want)
        least = {}
        for r, c in zip(rows, want, strict=True):
            least[c] = min(x for x in (least.get(c), r.doc_id, 1 << 62) if x is not None)
        assert [r.component_id for r in rows] == [least[c] if least[c] < 1 << 62 else None for c in want]


@pytest.mark.parametrize("segments", [2, 3, 5])
@pytest.mark.parametrize("block", [4, 4096])
def test_links_keep_every_component(spark, segments, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rng = np.random.default_rng(segments)
    centres = rng.integers(0, 1 << 63, size=12, dtype=np.uint64)
    prints = set()
    for c in centres:
        for _ in range(40):
            flips = rng.integers(0, 64, size=rng.integers(0, 7))
            prints.add(int(np.bitwise_xor.reduce(np.concatenate([[c], np.uint64(1) << flips.astype(np.uint64)]))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 4, segments)).collect()}
    assert same_partition([roots.get(p, p) for p in signed], brute_components(prints, 4))


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)] + [(2000, 2000 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(201)} == {0} and got[1001] == 1000 and {got[2000 + k] for k in range(60)} == {2000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(cases, empty):
    kept = simhash.one_of_each(cases)
    assert kept.columns == cases.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and ids[7] == 1 and ids[8] == 0 and ids[2] == 1 and ids[None] == 0
    assert simhash.one_of_each(empty).count() == 0


# repeated strings --------------------------------------------------------------


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("classes", [1, 512])
def test_repeats_equal_brute_force(spark, classes, monkeypatch):
    monkeypatch.setattr(repeats, "CLASSES", classes)
    monkeypatch.setattr(repeats, "SORTED", 4000)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdeé ")) for _ in range(n))
    passage, other = word(450), word(230)
    rows = [(1, word(300) + passage + word(80)), (2, passage[:300] + word(250)), (3, word(50) + passage[100:] + other), (4, other + word(100) + other), (5, "ab" * 400), (6, None), (None, ""), (7, word(199)), (8, passage), (8, passage), (9, word(700)), (None, word(260)), (10, other[:199]), (11, "x" * 200), (12, other[5:] + other[:220])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_repeats_on_table_and_empty(small, empty, cases):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = repeats.without_repeats(small).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)
    assert repeats.without_repeats(empty).count() == 0 and repeats.without_repeats(cases, keep=["doc_id", "kept"]).count() == len(CASES)


def test_long_documents_are_cut_into_blocks(monkeypatch):
    data = np.random.default_rng(2).integers(97, 100, size=5000).astype(np.uint8)
    whole = repeats.runs(data)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    parts = repeats.runs(data)
    spread = lambda x: [(a, s + k, s + p) for a, s, n, p, c, r in zip(*(v.tolist() for v in x), strict=True) for k in range(n) if (c, r) == (1, n)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 4801


def test_periodic_bytes_are_few_runs():
    rng = np.random.default_rng(4)
    noise = rng.integers(97, 123, size=3000).astype(np.uint8)
    ruled = np.concatenate([noise, np.full(100_000, ord("-"), np.uint8), noise[::-1], np.tile(noise[:3], 30_000), np.tile(noise[5:70], 500), noise[:900]])
    for data, bound in ((np.full(100_000, 97, np.uint8), 1), (np.frombuffer(b"ab " * 33_334, np.uint8), 9), (ruled, 400)):
        found = repeats.runs(data)
        assert len(found[0]) <= bound
        windows, covered = 0, np.zeros(len(data) - 199, bool)
        for _, start, n, _, copies, reach in zip(*(x.tolist() for x in found), strict=True):
            step = (reach - n) // max(1, copies - 1)
            assert step <= 200 and reach == n + (copies - 1) * step
            piece = data[start : start + n + 199]
            for k in {0, 1, copies // 2, copies - 1} & set(range(copies)):
                assert (data[start + k * step : start + k * step + n + 199] == piece).all()
            windows += n * copies
            covered[start : start + reach] = True
        assert windows == len(data) - 199 and covered.all()


def test_periodic_texts_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefg ")) for _ in range(n))
    table = "| - " * 120
    broken = "=" * 260 + "#" + "=" * 350 + "#" + "=" * 199
    rows = [(1, "a" * 100_000), (2, word(300) + "-" * 700 + word(90)), (3, "-" * 230 + word(40)), (4, table + word(250) + table[1:260]), (5, word(65) * 9 + word(10)), (6, broken), (7, word(190) * 3), (8, "z" * 201), (9, "y" * 200), (10, "ab" * 99 + "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_long_matches_are_not_remembered():
    memo = bpe.Memo(len)
    assert [memo[x] for x in ("ab", "c" * bpe.MEMO_CHARS, "d" * 10_000)] == [2, bpe.MEMO_CHARS, 10_000]
    assert all(len(x) <= bpe.MEMO_CHARS for x in memo) and len(memo) == 2


def test_suffix_sort_and_verification():
    rng = np.random.default_rng(1)
    for t in range(60):
        length = int(rng.integers(2, 12))
        data = rng.integers(0, 2 + t % 3, size=int(rng.integers(length, 200))).astype(np.uint8)
        at = rng.permutation(np.arange(len(data) - length + 1))
        group = np.sort(rng.integers(0, 1 + t % 4, size=len(at)))
        order = suffixes.Suffixes(data, length).sorted(at, group)
        key = lambda g, p: (g, data[p : p + length].tobytes())  # noqa: E731, B023
        assert [key(g, p) for g, p in zip(group, order, strict=True)] == sorted(key(g, p) for g, p in zip(group, at, strict=True))
        seen = Counter(key(g, p) for g, p in zip(group, at, strict=True))
        assert suffixes.repeated(data, at, group, length).tolist() == [seen[key(g, p)] > 1 for g, p in zip(group, at, strict=True)]


def test_equal_hashes_of_unequal_strings_are_no_repeat(monkeypatch):
    monkeypatch.setattr(suffixes, "BYTE", np.ones(256, np.uint64))  # every string of one length has one hash
    data = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    assert not suffixes.repeated(data, np.arange(10), np.zeros(10, int), 5).any()


# surrogates --------------------------------------------------------------------

KEY = b"secret"


def test_surrogates_kind_format_and_coreference():
    text = "Ask A.Bob12@Mail5.Example.com or a.bob12@mail5.example.com, +1 (743) 555-3824, +1 743 555 3824; 4785380592391139 and 4785 3805 9239 1139; 70.23.22.57; 999.1.1.1; 1234567890123456"
    new, spans = surrogates.rewrite(text, KEY, {})
    values = [(s["kind"], new[s["start"] : s["end"]]) for s in spans]
    assert [k for k, _ in values] == ["email", "email", "phone", "phone", "card", "card", "ip"]
    mails, phones, cards = [v for k, v in values if k == "email"], [v for k, v in values if k == "phone"], [v for k, v in values if k == "card"]
    assert mails[0] == mails[1] and re.fullmatch(r"\w+\.\w+\d\d@\w+\.example\.\w+", mails[0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    assert surrogates.luhn(cards[0]) and cards[0][0] == "4" and cards[1].replace(" ", "") == cards[0]
    assert "999.1.1.1" in new and "1234567890123456" in new  # no address, no card
    for old in ("743", "4785380592391139", "70.23.22.57", "Bob12"):
        assert old not in new
    assert surrogates.rewrite(text, KEY, {}) == (new, spans) != surrogates.rewrite(text, b"other", {})


def test_surrogates_gender_script_and_parts():
    new, _ = surrogates.rewrite("Mrs. Maria Lopez met Herr LOPEZ, г-жа Анна Иванова and Κα Ελένη Παππά. Dr smith. Mr", KEY, {})
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+), г-жа (\w+) (\w+) and Κα (\w+) (\w+)\. Dr smith\. Mr", new)
    assert m and m[3] == m[2].upper() and "Maria" not in new and "Иванова" not in new
    assert m[1].endswith("a") and m[4][-1] in "ая"
    assert all(surrogates.script(m[k].lower()) == s for k, s in ((1, "latin"), (4, "cyrillic"), (5, "cyrillic"), (6, "greek")))


JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c="


@pytest.mark.parametrize(
    "before, secret, after",
    [
        ("token: ", "aB3_" * 175, " end"),
        ("token: ", JWT, ". Then"),
        ("token=Bearer ", JWT, ""),
        ("password = ", "P@ssw0rd!23", " x"),
        ('{"password": "', "abcdefgh1", '", "user": 1}'),
        ('{\\"password\\": \\"', "abcdefgh1", '\\"}'),
        ("api_key     =     ", "abcd1234efgh", ", next"),
        ("secret: '", 'it "is" a, long; one', "' x"),
        ('password="', "ab1", '"'),
        ('password="', "!@#$%^&*", '"'),
        ("https://a.example/?token=", "abcd.efgh~1234", "&page=2"),
        ("(token=", "abcdefgh1", ")"),
        ("token: \"", "unclosed_secret", "\nnext line"),
    ],
)
def test_surrogates_replace_whole_secrets(before, secret, after):
    new, spans = surrogates.rewrite(before + secret + after, KEY, {})
    assert [s["kind"] for s in spans] == ["secret"] and new.startswith(before) and new.endswith(after)
    got = new[len(before) : len(new) - len(after)]
    assert len(got) == max(8, len(secret)) and got != secret and not any(secret[k : k + 8] in new for k in range(max(1, len(secret) - 7)))
    assert surrogates.mentions("token: short, password: x, token count = 5, password=''") == []


@pytest.mark.parametrize(
    "phone",
    ["555-123-4567", "555.123.4567", "1-800-555-1234", "020 7946 0958", "(020) 7946 0958", "01 23 45 67 89", "01.23.45.67.89", "030 12345678", "030/12345678", "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "+49 30 12345", "+1 (743) 555-3824", "(743) 555-3824", "+33\xa01\xa023\xa045\xa067\xa089"],
)
def test_surrogates_find_phone_forms(phone):
    new, spans = surrogates.rewrite(f"call {phone}, or {phone}.", KEY, {})
    m = re.fullmatch(r"call (.+), or (.+)\.", new)
    assert [s["kind"] for s in spans] == ["phone"] * 2 and m[1] == m[2] != phone
    assert re.sub(r"\d", "d", m[1]) == re.sub(r"\d", "d", phone) and m[1][0] in (phone[0], *"23456789")


def test_surrogates_take_no_dates_and_decimals_for_phones():
    for text in ("01-02-2024", "01.02.2024 10:30", "2024-01-02", "01 02 2024 12", "0.123.4567", "3.555.123.4567", "1,555.123.4567", "555.123.4567.8", "012.345", "555-123-45678", "x555-123-4567", "10:02-03 04 05", "2024-01-02 03:04:05", "007 12", "01/02/2024", "+1 2 34"):
        assert surrogates.mentions(f"on {text} at") == [], text
    assert [m[2] for m in surrogates.mentions("010.20.30.40 and 4785 3805 9239 1139")] == ["ip", "card"]


def test_surrogates_of_bare_mentions():
    text = "Kowalska came. Mrs Anna Kowalska, Mrs Kowalska's car; Anna Kowalska and Anna\nKowalska. KOWALSKA said: Kowalska's, a Kowalska-led team, Anna, kowalska, Kowalskaya. г-жа Анна Иванова. Анна Иванова. Иванова"
    new, spans = surrogates.rewrite(text, KEY, {})
    m = re.fullmatch(r"(\w+) came\. Mrs (\w+) (\w+), Mrs (\w+)'s car; (\w+) (\w+) and (\w+)\n(\w+)\. (\w+) said: (\w+)'s, a (\w+)-led team, Anna, kowalska, Kowalskaya\. г-жа (\w+) (\w+)\. (\w+) (\w+)\. (\w+)", new)
    family, given = m[3], m[2]
    assert {m[k] for k in (1, 4, 6, 8, 10, 11)} == {family} != {"Kowalska"} and m[9] == family.upper() and {m[5], m[7]} == {given} != {"Anna"}
    assert (m[14], m[15], m[16]) == (m[12], m[13], m[13]) and "Иванова" not in new
    assert [new[s["start"] : s["end"]] for s in spans] == [m[k] for k in range(1, 17)]
    # of two persons with one given name, each keeps the own surrogate
    m = re.fullmatch(r"Mr (\w+) (\w+), Mrs (\w+) (\w+): (\w+) (\w+), (\w+) (\w+)", surrogates.rewrite("Mr Andrea Rossi, Mrs Andrea Bianchi: Andrea Bianchi, Andrea Rossi", KEY, {})[0])
    assert (m[5], m[6], m[7], m[8]) == (m[3], m[4], m[1], m[2]) and m[1] != m[3]


@pytest.mark.parametrize(("kind", "entity"), [("phone", "+12345"), ("given:f:latin", "ana"), ("email", "1@x.com"), ("secret", "12345678"), ("ip", "10.0.0.1"), ("domain", "x.com")])
def test_surrogates_grow_with_the_attempt(kind, entity):
    sizes = [len(surrogates.surrogate(KEY, kind, entity, attempt)) for attempt in range(12)]
    assert max(sizes[8:]) > max(sizes[:2])


def test_surrogates_settle_where_entities_outnumber_the_short_ones(spark):
    """Phone numbers with one free digit have 8 surrogates of their length; 60 others get longer ones, all distinct, none an entity."""
    known = spark.createDataFrame([("phone", f"+1{n}") for n in range(60)], "kind string, entity string")
    rows = surrogates.assigned(known, KEY).collect()
    new = {r.surrogate for r in rows}
    assert len(rows) == len(new) == 60 and not new & {r.entity for r in rows}


def test_surrogates_collisions_are_drawn_again(spark, monkeypatch):
    import pandas as pd

    real = surrogates.surrogate
    # a space of eight addresses, of which the corpus has one
    monkeypatch.setattr(surrogates, "surrogate", lambda key, kind, entity, attempt=0: f"u{surrogates.Draw(key, kind, entity, attempt)(8)}@b.example")
    known = spark.createDataFrame([("email", f"p{k}@a.example") for k in range(6)] + [("email", "u3@b.example")], "kind string, entity string")
    rows = pd.DataFrame(map(tuple, surrogates.assigned(known, KEY).collect()), columns=["kind", "entity", "attempt", "surrogate"])
    assert len(rows) == 7 and rows.surrogate.is_unique and "u3@b.example" not in set(rows.surrogate) and (rows.attempt > 0).any()
    assert real is not surrogates.surrogate


@pytest.mark.parametrize("told", [100_000, -1])
def test_domains_stay_distinct(spark, told, monkeypatch):
    monkeypatch.setattr(surrogates, "TOLD", told)
    real = surrogates._word
    # first attempts at a domain have a single syllable and few endings
    monkeypatch.setattr(surrogates, "_word", lambda draw, letters, *rest: "ba" + "lnr"[draw(3)] if letters == 8 and b"domain" in draw.what else real(draw, letters, *rest))
    docs = spark.createDataFrame([(k, f"write to Ann@site{k}.example.org or bob@site{k}.example.org") for k in range(30)], "doc_id long, text string")
    found = {r.doc_id: re.findall(r"[^\s@]+@(\S+)", r.text) for r in surrogates.replaced(docs, KEY).collect()}
    assert all(len(d) == 2 and d[0] == d[1] for d in found.values()) and len({d[0] for d in found.values()}) == 30
    known = surrogates.entities(docs)
    assert known.where("kind = 'domain'").count() == 30 and known.where("kind = 'email'").count() == 60


@pytest.mark.parametrize("told", [100_000, -1])
def test_replaced_documents(spark, cases, empty, told, monkeypatch):
    monkeypatch.setattr(surrogates, "TOLD", told)
    docs = spark.createDataFrame([(1, "mail x.y1@mail1.example.com now"), (2, "x.y1@mail1.example.com, z1@mail1.example.com"), (2, None), (None, ""), (3, "no data"), (3, "no data")], "doc_id long, text string").withColumn("spans", F.lit("own"))
    rows = surrogates.replaced(docs, KEY).collect()
    assert Counter(r.n_private for r in rows) == {1: 1, 2: 1, 0: 4}
    first, second = next(r.text for r in rows if r.doc_id == 1), next(r.text for r in rows if r.n_private == 2)
    assert first.split()[1] == second.split(", ")[0] and len(set(second.split(", "))) == 2 and "mail1" not in first + second
    assert [r.text for r in rows if r.doc_id == 3] == ["no data"] * 2 and None in [r.text for r in rows]
    assert surrogates.replaced(empty, KEY).count() == 0 and surrogates.replaced(cases, KEY).count() == len(CASES)
