"""Connected components of a link table, by large-star and small-star rounds.

A round replaces each node's links by links to the smallest node among its
neighbours, first for the larger neighbours (large star), then for the smaller ones
(small star); components stay what they are and end as stars around their smallest
node after a few rounds (logarithmic in practice).  Minima are summed up before the
shuffle and written before they are joined back, so a node with very many links is no
hot task: AQE may split a join whose sides both come straight from a shuffle.  Each round is written to the shared folder; the driver sees two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm.common import forget, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of each node in ``links (u, v)``; ``root`` is the smallest node of the component."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        after = written(_small_star(_large_star(now)), "links")
        forget(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
