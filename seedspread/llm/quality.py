"""Quality rules with adaptive thresholds per language and source.

Each document gets counts (``features``) and from them four measures: characters a
word, symbols a word, share of repeated lines, share of words in repeated windows.
Per (language, source) one quantile sketch of each measure is built over all documents
that pass the base rule: counts of the measure rounded to ``BITS`` significant bits (about
three percent), so a sketch has a bounded number of entries, doesn't depend on the order of
rows, and two runs agree.  Sketches merge by adding counts: map-side parts into groups, groups
into languages, languages into one for everything, without reading a text again.

A group's own values decide its thresholds.  The upper one looks at the first of the
measure's percentiles (95th and 99th, or the 99th alone) that lies above the group's
median, and adds ``fence`` times its distance from the median; without such spread it is the
99th itself.  The lower one mirrors that.  Shares of repeated lines and words use the 99th
without a fence, so a limit is a value that the group has, below the base rule's.  A group
with fewer than ``min_rows`` rows takes the thresholds of its language, and such a
language those of all rows.  The thresholds are joined to the documents, and a document
whose rounded measure lies beyond one of them isn't kept.

Everything is built-in functions.  Repeated windows: each word is hashed to 64 bits and
each window of eight is the hash of its eight word hashes; only documents that have two
equal windows are examined further, by sorting (hash, place).

Defined cases: a null or blank text has no words, fails the base rule and isn't kept;
null languages and sources are values like any other; documents that fail the base rule
are left out of the sketches, and if all do, there are no thresholds to fail.  ``keep``
names the input columns to return; those called like a result are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedspread.llm.common import broadcast_if_small, col, words, written

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: The base rule: at least so many words, and at most such a share of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Measure: (units of its sketch in 1, has a lower threshold, percentiles to look at, fence).
MEASURES = {"chars_per_word": (100, True, (95, 99), 1), "symbols_per_word": (1000, False, (95, 99), 1), "dup_line_share": (1000, False, (99,), 0), "repeat_word_share": (1000, False, (99,), 0)}
#: Numerator and denominator of each measure, and the significant bits of its sketch.
PARTS = {"chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_word_share": ("n_repeat_words", "n_words")}
BITS = 6
LEVELS = (1, 5, 50, 95, 99)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "n_lines", *MEASURES, "base_failed", "kept")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _windows(tokens: Column) -> Column:
    """Hashes of all windows of eight words, in order."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    at = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.size(tokens) >= WINDOW, bind(hashes, at)).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
        places = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j)["at"]))
        return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

    def total(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda n, j: n + F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW))))

    ordered = F.sort_array(F.transform(windows, lambda g, at: F.struct(g.alias("g"), at.alias("at"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(bind(bind(ordered, starts), total))


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts of each whole text and ``base_failed``, beside the columns ``keep`` (all by default)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    own = [col(c) for c in keep]
    text = F.coalesce(F.col("_text"), F.lit(""))
    split = docs.select(*own, col(text_col).alias("_text")).select(*own, "_text", words(F.col("_text")).alias("_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = split.select(*own, "_words", F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"), _windows(F.col("_words")).alias("_windows"))
    counted = wide.select(
        *own,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_windows")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def measures() -> list[Column]:
    """The measures of a row of ``features`` (null without words or lines)."""
    return [(F.col(x) / F.nullif(F.col(y), F.lit(0))).alias(m) for m, (x, y) in PARTS.items()]


def rounded() -> list[Column]:
    """The measures in units of their sketches, rounded down to ``BITS`` significant bits, as ``<measure>_bin``."""
    out = []
    for m, (x, y) in PARTS.items():
        units = F.floor(F.col(x) * F.lit(MEASURES[m][0]) / F.nullif(F.col(y), F.lit(0))).cast("long")
        out.append(bind(units, _leading).alias(f"{m}_bin"))
    return out


def _leading(v: Column) -> Column:
    """``v`` with the bits after its first ``BITS`` cleared."""
    drop = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, measure, bin, n)``: how often each group has each rounded value of each measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_bin").alias("bin")) for m in MEASURES])
    long = rows.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.measure", "_p.bin").where("bin is not null")
    return long.groupBy(*by, "measure", "bin").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return parts.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n)`` with the thresholds ``m_low`` (null for none) and ``m_high`` of each measure, from sketches."""
    group = Window.partitionBy(*by, "measure")  # the entries of one sketch
    summed = parts.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    quantile = [F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bin"))).alias(f"q{p}") for p in LEVELS]
    found = summed.groupBy(*by, "measure").agg(F.max("all").alias("n"), *quantile)
    limits = []
    for m, (_, lower, levels, fence) in MEASURES.items():
        mid = F.col("q50")
        top = F.coalesce(*[F.when(F.col(f"q{p}") > mid, F.col(f"q{p}")) for p in levels], F.col("q99"))
        low = F.coalesce(*[F.when(F.col(f"q{100 - p}") < mid, F.col(f"q{100 - p}")) for p in levels], F.col("q1"))
        here = lambda x, m=m: F.max(F.when(F.col("measure") == m, x))
        limits += [here(low - fence * (mid - low) if lower else F.lit(None).cast("long")).alias(f"{m}_low"), here(top + fence * (top - mid)).alias(f"{m}_high")]
    return found.groupBy(*by).agg(F.max("n").alias("n"), *limits)


def thresholds(rows: DataFrame, min_rows: int = 200) -> DataFrame:
    """``(lang, source)`` with the thresholds that hold for the group; ``rows`` has lang, source and the rounded measures."""
    fine = written(sketches(rows, ["lang", "source"]), "sketches")
    langs = written(merged(fine, ["lang"]), "lang-sketches")
    every = fences(merged(langs, []), []).where("n > 0").first()
    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    by_lang = fences(langs, ["lang"]).select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), *[F.col(x).alias(f"_{x}") for x in names])
    both = fences(fine, ["lang", "source"]).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    pick = lambda x: F.when(F.col("n") >= min_rows, F.col(x)).when(F.col("_n") >= min_rows, F.col(f"_{x}")).otherwise(F.lit(every[x] if every else None).cast("long"))
    return both.select("lang", "source", *[pick(x).alias(x) for x in names])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, min_rows: int = 200) -> DataFrame:
    """The columns ``keep`` (all but the text by default), the counts, the measures, ``base_failed`` and ``kept``."""
    keep = [c for c in ([c for c in docs.columns if c != text_col] if keep is None else keep) if c.lower() not in RESULTS]
    named = docs.select(F.struct(*[col(c) for c in keep]).alias("_kept"), col(lang_col).alias("_q_lang"), col(source_col).alias("_q_source"), col(text_col).alias("_q_text"))
    counted = features(named, "_q_text", ["_kept", "_q_lang", "_q_source"])
    rows = written(counted.select("*", *measures(), *rounded()), "features")
    passed = rows.where("not base_failed").select(F.col("_q_lang").alias("lang"), F.col("_q_source").alias("source"), *[f"{m}_bin" for m in MEASURES])
    limits = written(thresholds(passed, min_rows), "thresholds")
    matched = rows.join(broadcast_if_small(limits), F.col("_q_lang").eqNullSafe(F.col("lang")) & F.col("_q_source").eqNullSafe(F.col("source")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within &= F.coalesce(F.col(f"{m}_bin") <= F.col(f"{m}_high"), F.lit(True)) & F.coalesce(F.col(f"{m}_bin") >= F.col(f"{m}_low"), F.lit(True))
    return matched.select(*[F.col("_kept")[c].alias(c) for c in keep], *COUNTS, "n_lines", *MEASURES, "base_failed", (~F.col("base_failed") & within).alias("kept"))
