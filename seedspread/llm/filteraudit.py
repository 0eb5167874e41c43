"""How filters interact: what each would remove after any others, by joins of failing-id relations.

Each filter has one written id table: the keys of the documents that fail it.  A prefix is
the set of filters applied so far.  Its survivors are a chain of left-anti joins: filter
by filter every key goes on once without the filter and once with it, and the copies with
it that the filter's table holds drop out, so after the last filter the written relation
has every prefix with its survivors.  Failing ids are paired with each prefix that lacks
their filter: those that a left-semi join finds among the survivors are what the filter
removes there, those that a left-anti join leaves over failed an earlier filter
too.  Labels are lost with removed rows.  A step of an order depends on the set before it
only, so orders look their steps up and are never run one by one.

Documents that fail nothing survive every prefix and are counted once a part; only the
others meet the joins, at most 2^(n-1) rows each.  Keys are two hashes of id and text, so
no join has a hot key; a text that a third of all rows share is met as its smallest id,
written before the join, which AQE may split.  Counts by part are summed up before the
shuffle.

Defined cases: a null text is empty; rows equal in id and text are one key and count as
often as they occur; a null id counts as larger than any other; a null part is the empty
string; a document's label is the largest of its label rows; no documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedspread.llm.common import col, forget, words, written

KEY = ["k1", "k2"]


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails the filters A to D: short, repetitive, loud, or with signs of markup."""
    tokens = words(text)
    return {
        "A": F.size(tokens) < 200,
        "B": 100 * F.size(F.array_distinct(tokens)) < 50 * F.size(tokens),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def keyed(docs: DataFrame, fails: dict[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(k1, k2, id, part, digest)`` and ``fail_<name>`` of each row; ``fails`` refer to the text as ``_text``."""
    text = F.coalesce(col(text_col), F.lit(""))
    named = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col), F.lit("")).alias("part"), text.alias("_text"))
    key = [F.xxhash64(F.lit(seed), F.col("id").isNull(), "id", "_text").alias(k) for seed, k in enumerate(KEY, 1)]
    return named.select(*key, "id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), *[x.alias(f"fail_{f}") for f, x in fails.items()])


def copies_of_smaller(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose text a smaller id has too."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    first = written(rows.groupBy("digest").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("digest", "lo"), "audit-first")
    return rows.join(first, "digest").where(order > F.col("lo")).select(*KEY).distinct()


def relations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(k1, k2, part, copies, good, toxic)`` of all documents, and the id table of each filter A to E."""
    rows = written(keyed(docs, conditions(F.col("_text")), id_col, text_col, part_col), "audit-rows")
    fails = {f: written(rows.where(f"fail_{f}").select(*KEY).distinct(), f"fails-{f}") for f in "ABCD"}
    fails["E"] = written(copies_of_smaller(rows), "fails-E")
    marked = lambda x: F.max((F.col(x) == 1).cast("int"))
    known = written(labels.where("doc_id is not null").groupBy("doc_id").agg(marked("quality").alias("good"), marked("toxic").alias("toxic")), "audit-labels")
    labelled = rows.select(*KEY, "id", "part").join(known, F.col("id") == F.col("doc_id"), "left")
    one = lambda x: F.coalesce(F.max(x), F.lit(0)).alias(x)
    base = written(labelled.groupBy(*KEY, "part").agg(F.count("*").alias("copies"), one("good"), one("toxic")), "audit-base")
    forget(rows)
    forget(known)
    return base, fails


def survivors(base: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """``(k1, k2, part, copies, prefix)``: the rows with a failure that survive each prefix, a set of filters as bits."""
    left = base.select(*KEY, "part", "copies", F.lit(0).alias("prefix"))
    for bit, failing in enumerate(fails.values()):
        both = left.withColumn("prefix", F.explode(F.array("prefix", F.col("prefix") + (1 << bit))))
        other = failing.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"))
        applied = F.col("prefix").bitwiseAND(1 << bit) != 0
        left = both.join(other, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & applied, "left_anti")
    return left


def steps(base: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """One row per part, filter (its place in ``fails``) and prefix without it, zeros included."""
    n = len(fails)
    pairs = [(f, s) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    stacked = None
    for f, failing in enumerate(fails.values()):
        own = failing.withColumn("filter", F.lit(f))
        stacked = own if stacked is None else stacked.unionByName(own)
    failed = written(base.join(stacked, KEY), "audit-failed")
    affected = base.join(failed.select(*KEY).distinct(), KEY, "left_semi")
    alive = written(survivors(affected, fails), "survivors")
    clean = base.join(failed.select(*KEY).distinct(), KEY, "left_anti").groupBy("part").agg(F.sum("copies").alias("kept"))
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("prefix")) for f, s in pairs])).alias("at")

    at = ["part", "filter", "prefix"]
    counts = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
    shaped = lambda t: t.select(*at, *[(F.col(c) if c in t.columns else F.lit(0)).cast("long").alias(c) for c in counts])
    every = base.select("part").distinct().select("part", grid).select("part", "at.*")
    whole = clean.select("part", "kept", grid).select("part", "kept", "at.*")
    after = alive.groupBy("part", "prefix").agg(F.sum("copies").alias("kept"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.getbit("prefix", f) == 1)
    rest = after.where("prefix > 0").withColumn("filter", F.explode(bits)).withColumn("prefix", (F.col("prefix") - F.expr("shiftleft(1, filter)")).cast("int"))

    prefixes = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: F.getbit(s, F.col("filter")) == 0)
    meets = failed.withColumn("prefix", F.explode(prefixes))
    present = alive.select(*KEY, "prefix")
    removed = meets.join(present, [*KEY, "prefix"], "left_semi").groupBy(*at).agg(F.sum("copies").alias("removed"), F.sum(F.col("copies") * F.col("good")).alias("good_lost"), F.sum(F.col("copies") * F.col("toxic")).alias("toxic_lost"))
    redundant = meets.join(present, [*KEY, "prefix"], "left_anti").groupBy(*at).agg(F.sum("copies").alias("redundant"))
    parts = [shaped(t) for t in (every, whole, rest, removed, redundant)]
    stats = parts[0]
    for t in parts[1:]:
        stats = stats.unionByName(t)
    out = written(stats.groupBy(*at).agg(*[F.sum(c).alias(c) for c in counts]), "audit-steps")
    forget(failed)
    forget(alive)
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the module's docstring.

    ``part, filter_order, step``, and ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` (long).
    """
    base, fails = relations(docs, labels, id_col, text_col, part_col)
    names, n = "".join(fails), len(fails)
    found = steps(base, fails)
    sums = Window.partitionBy("part", "filter")  # 2^(n-1) rows each
    before = F.bit_count("prefix")
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), before + 1)
    alone = F.when(before == n - 1, F.col("removed"))
    scored = found.withColumns({"shapley": F.sum(F.col("removed") * weight).over(sums), "unique_fails": F.max(alone).over(sums)})
    rows = [("".join(p), k + 1, names.index(f), sum(1 << names.index(g) for g in p[:k])) for p in permutations(names) for k, f in enumerate(p)]
    orders = docs.sparkSession.createDataFrame(rows, "filter_order string, step int, filter int, prefix int")
    joined = scored.join(F.broadcast(orders), ["filter", "prefix"])  # n * n! rows, whatever the documents
    return joined.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
