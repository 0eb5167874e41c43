"""Removal of passages that other documents have already, by windows of three lines.

Lines are what newlines part; those without a word are passed over.  Every three
consecutive lines of a document (windows overlap) are hashed to 128 bits.  A window
found more than once in the whole table keeps its first occurrence, in the order of id
(null last), text hash and line; each later occurrence covers its lines, from the first
to the third and what lies between.  The covered lines of all windows are merged, and
removed.  A line's first occurrence in that order is never covered.

All steps are built-in functions.  Counting is summed up before the shuffle, so a
passage that a third of all documents share is one row a task.  First occurrences are
written before the join that finds the later ones: both its sides come straight
from a shuffle, so AQE may split the rows of one window.  No text is shuffled but once, to meet
its document's covered lines.

Defined cases: texts of fewer than three lines with words have no window and stay as
they are; a null text stays null; a text whose lines are all covered becomes empty, its
row stays; rows equal in id and text count as one document and are treated alike.
Added columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.llm.common import col, written
from seedspread.llm.quality import bind

LINES = 3


def _windows(text: Column) -> Column:
    """``(a, b, w1, w2)`` of each window: its first and last line and its hash."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(i.alias("i"), F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))))

    def window(n: Column, j: Column) -> Column:
        part = lambda h: F.xxhash64(*[F.get(n, j + k)[h] for k in range(LINES)])
        return F.struct(F.get(n, j)["i"].alias("a"), F.get(n, j + (LINES - 1))["i"].alias("b"), part("h1").alias("w1"), part("h2").alias("w2"))

    found = bind(F.filter(lines, lambda x: x.isNotNull()), lambda n: F.when(F.size(n) >= LINES, F.transform(F.sequence(F.lit(0), F.size(n) - LINES), lambda j: window(n, j))))
    return found


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _t1, _t2, covered)``: the lines to remove of each document that has some, counted from 0."""
    text = col(text_col)
    key = [col(id_col).alias("_id"), F.xxhash64(F.lit(1), text).alias("_t1"), F.xxhash64(F.lit(2), text).alias("_t2")]
    # one document for equal rows: each of their windows still counts once
    rows = docs.where(F.instr(text, "\n") > 0).select(*key, F.explode(_windows(text)).alias("w")).select("_id", "_t1", "_t2", "w.*")
    rows = written(rows, "line-windows")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col("a").alias("a"))
    first = written(rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("w1", "w2", "first"), "line-firsts")
    later = rows.join(first, ["w1", "w2"]).where(place != F.col("first"))
    lines = later.select("_id", "_t1", "_t2", F.explode(F.sequence("a", "b")).alias("line"))
    return lines.groupBy("_id", "_t1", "_t2").agg(F.collect_set("line").alias("covered"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the covered lines removed from the text, and ``n_lines`` and ``n_removed`` (long) if ``counts``."""
    text = col(text_col)
    removed = covered_lines(docs, id_col, text_col)
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_ld_row"), col(id_col).alias("_ld_id"), text.alias("_ld_text"), F.xxhash64(F.lit(1), text).alias("_ld_t1"), F.xxhash64(F.lit(2), text).alias("_ld_t2"))
    same = F.col("_ld_id").eqNullSafe(F.col("_id")) & (F.col("_ld_t1") == F.col("_t1")) & (F.col("_ld_t2") == F.col("_t2"))
    joined = keyed.join(removed, same, "left")
    lines = F.split(F.col("_ld_text"), "\n")
    rest = bind(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("covered")), lambda i: F.get(ls, i)), "\n"))
    text_now = F.when(F.col("covered").isNull(), F.col("_ld_text")).otherwise(rest)
    added = {"n_lines": F.when(F.col("_ld_text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size("covered"), F.lit(0)).cast("long")} if counts else {}
    kept = [(text_now if c == text_col else F.col("_ld_row")[c]).alias(c) for c in docs.columns if c.lower() not in added]
    return joined.select(*kept, *[x.alias(c) for c, x in added.items()])
