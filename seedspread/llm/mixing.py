"""Mixing sources to target weights.

1. Words are summed per source (partial sums before the shuffle, so a source that
   holds a third of all rows costs no task more than the others).
2. ``targets`` shares ``share`` times all words among the sources by weight.  No
   source gets more than ``cap`` times its own words; what it can't take goes to the
   others by weight, until none is above.
3. ``mix`` gives each document ``floor(rate)`` copies plus one with probability
   ``rate - floor(rate)``, ``rate = target / words of the source``.  The draw is a hash
   of seed, id and text, so reruns and retried tasks agree.

Defined cases: a null source is a source of its own, last in the order; a null or
empty text has size 0 and draws like any other; a source without a word has target 0
and its documents 0 copies; repeated rows (same id, same text) draw alike; an empty
table gives an empty mix.  ``mix`` adds columns under the names in ``NAMES``; an input
column of such a name is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedspread.llm.common import broadcast_if_small, col, n_words, written

#: What ``mix`` adds.
NAMES = ("size", "source_size", "target", "copies", "taken")
#: Draws are 52-bit fractions: exact in a double.
DRAW_HEX, DRAW_RANGE = 13, float(1 << 52)


def source_sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(source, source_size)``: words per source."""
    return docs.groupBy(col(source_col).alias("source")).agg(F.sum(n_words(col(text_col))).alias("source_size"))


def weighted(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds ``weight``: the sources in code-point order, null last, take the weights in turn.

    The order is a distributed sort; a source's position is its place in its partition
    plus the rows of the partitions before (one row per partition).
    """
    ordered = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_start") + place) % len(weights) + 1).cast("int"))
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").select("source", "source_size", turn.alias("weight"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``source_sizes``.

    The capped shares are ``min(cap * size, level * weight)``.  The level rises as
    capped sources pass on their excess: each round is one aggregate over the sources,
    of which the driver gets three numbers; it ends when no further source is capped.
    """
    table = written(weighted(sizes, weights), "weights")
    ceiling = F.col("source_size") * F.lit(cap)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = ceiling <= F.col("weight") * F.lit(level)
        n, held, rest = table.agg(F.count_if(full), F.sum(F.when(full, ceiling).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest or n == capped:
            break
        level, capped = (share * total - held) / rest, n
    return table.withColumn("target", F.least(ceiling, F.col("weight") * F.lit(level)))


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, DRAW_HEX), 16, 10).cast("double") / F.lit(DRAW_RANGE)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every document with its size, its source's size and target, its copies and ``taken = size * copies``."""
    goal = written(targets(source_sizes(docs, text_col, source_col), weights, share, cap), "targets")
    goal = goal.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"))
    joined = docs.join(broadcast_if_small(goal), col(source_col).eqNullSafe(F.col("_mix_source")), "left")
    rate = F.when(F.col("_mix_size") > 0, F.col("_mix_target") / F.col("_mix_size")).otherwise(F.lit(0.0))
    chance = draw(seed, col(id_col), col(text_col))
    size, copies = n_words(col(text_col)), (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long"))
    kept = [col(c) for c in docs.columns if c.lower() not in NAMES]
    out = joined.select(*kept, size.alias("size"), F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs`` only."""
    mixed = mix(docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), *[col(options.get(k, d)).alias(f"_{d}") for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]), **{k: v for k, v in options.items() if not k.endswith("_col")}, id_col="_doc_id", text_col="_text", source_col="_source")
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    rows = mixed.select("_row", times.alias("_time"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
