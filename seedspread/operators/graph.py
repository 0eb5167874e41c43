"""kNN graph over labelled and unlabelled points.

One ``edges`` table replaces the reference's four sparse matrices:
``(src, src_obs, dst, dst_obs, d2, w, rank)``; a sub-graph (ul, uu, ...) is a filter
on the two booleans.  Every source keeps ``k_l`` labelled and ``k_u`` unlabelled
neighbours (rank by ``(d2, dst)``, never itself).  Only edges leaving unlabelled
sources are used by propagation, so those are built by default.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedspread.functions.vectors import edge_weight
from seedspread.operators.knn import knn_join, project
from seedspread.session import materialize

# Row sums below this are treated as 1 (float64 machine epsilon).
EPS = 2.220446049250313e-16

KIND_LABELED = 1
KIND_UNLABELED = 0


def _kinded(points: DataFrame, group_col: str | None = None) -> DataFrame:
    gc = [group_col] if group_col else []
    return points.select(*gc, "id", "x",
                         F.when(F.col("observed"), F.lit(KIND_LABELED)).otherwise(F.lit(KIND_UNLABELED)).alias("kind"))


def build_graph(
    points: DataFrame,
    k_labeled: int,
    k_unlabeled: int,
    *,
    sources: str = "unlabeled",
    L=None,
    bandwidth: float = 1.0,
    group_col: str | None = None,
    knn: Mapping | None = None,
) -> DataFrame:
    """K6: heterogeneous kNN graph.  ``points`` = ``(id, x, observed)``.

    ``sources`` is ``"unlabeled"`` (what propagation reads) or ``"all"``.
    ``L`` applies a linear metric first (K2), once per point.  With ``group_col``
    one independent graph is built per group value (sweep variants) in one plan.
    ``knn``: options of the neighbour search (``method="lsh"`` and its parameters for the
    approximate one; not with ``group_col``).
    """
    gc = [group_col] if group_col else []
    pts = project(points, L) if L is not None else points
    ref = _kinded(pts, group_col)
    query = pts if sources == "all" else pts.where(~F.col("observed"))
    query = query.select(*gc, "id", "x")
    nn = knn_join(query, ref, {KIND_LABELED: k_labeled, KIND_UNLABELED: k_unlabeled}, exclude_self=True,
                  kind_col="kind", group_col=group_col, **(knn or {}))
    obs = pts.select(*gc, F.col("id").alias("src"), F.col("observed").alias("src_obs"))
    return (
        nn.join(obs, gc + ["src"])
        .select(*gc, "src", "src_obs", "dst", (F.col("kind") == KIND_LABELED).alias("dst_obs"), "d2",
                edge_weight("d2", bandwidth).alias("w"), "rank")
    )


def transitions(edges: DataFrame, eps: float = EPS, group_col: str | None = None) -> DataFrame:
    """``p = w / row sum`` over both labelled and unlabelled edges of a source; sums < eps count as 1."""
    gc = [group_col] if group_col else []
    s = F.sum("w").over(Window.partitionBy(*gc, "src"))
    return edges.withColumn("p", F.col("w") / F.when(s < F.lit(eps), F.lit(1.0)).otherwise(s))


def drop_zero_weights(edges: DataFrame) -> DataFrame:
    """Remove edges whose weight underflowed to 0."""
    return edges.where(F.col("w") > 0)


def adjacency(edges: DataFrame) -> DataFrame:
    """K9: per source and neighbour kind, the neighbours ordered by ``(d2, dst)``."""
    return edges.groupBy("src", "dst_obs").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d2", "dst"))), lambda s: s["dst"]).alias("neighbors"),
        F.count(F.lit(1)).alias("degree"),
    )


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """Who points at each node, as a long table ``(node, src_obs, src, in_degree)``.

    In-degrees of kNN graphs are unbounded (a hub can be the neighbour of a large
    share of all rows), so the sources are never collected into one row; the
    in-degree is a partial aggregation, written before it is joined back: AQE splits a
    skewed join only where both sides come straight from a shuffle.
    """
    rev = edges.select(F.col("dst").alias("node"), "src_obs", "src")
    deg = materialize(rev.groupBy("node").agg(F.count(F.lit(1)).alias("in_degree")), "degrees")
    return rev.join(deg, "node")


def radii(edges: DataFrame, group_col: str | None = None) -> DataFrame:
    """Squared distance of each source's farthest kept neighbour, per neighbour kind."""
    return edges.groupBy(*([group_col] if group_col else []), "src", "dst_obs").agg(F.max("d2").alias("radius"), F.count(F.lit(1)).alias("n_neighbors"))


def insert_nodes(
    edges: DataFrame,
    stored: DataFrame,
    new: DataFrame,
    k_labeled: int,
    k_unlabeled: int,
    *,
    sources: str = "unlabeled",
    bandwidth: float = 1.0,
    knn: Mapping | None = None,
    group_col: str | None = None,
) -> DataFrame:
    """K14 + K15: add a batch of points to a graph without rebuilding it.

    * new rows (K14): the k best of each new source among stored and new points;
    * column update (K15): a stored source adopts a new point when it beats its
      current k-th neighbour of that kind (or when it has fewer than k); the
      loser drops out.  Only the ``k`` best of the new points per stored source
      can enter, so they come from one kNN join ``stored x new`` and a re-rank of
      the affected sources -- a bounded top-k merge.

    The result equals ``build_graph`` on ``stored + new`` (ties by smaller id).  With
    ``group_col`` on all inputs, a batch enters many independent graphs in the same jobs.
    """
    gc = [group_col] if group_col else []
    k_map = {KIND_LABELED: k_labeled, KIND_UNLABELED: k_unlabeled}
    search = dict(exclude_self=True, kind_col="kind", group_col=group_col, **(knn or {}))
    all_pts = stored.unionByName(new.select(*stored.columns))
    # Rows of the new sources, against everything stored so far
    new_src = new if sources == "all" else new.where(~F.col("observed"))
    own = knn_join(new_src.select(*gc, "id", "x"), _kinded(all_pts, group_col), k_map, **search)
    # Stored sources against the new points only
    old_src = stored if sources == "all" else stored.where(~F.col("observed"))
    cand = knn_join(old_src.select(*gc, "id", "x"), _kinded(new, group_col), k_map, **search)
    cand = cand.select(*gc, "src", "dst", (F.col("kind") == KIND_LABELED).alias("dst_obs"), "d2")
    # prefilter by the radius of the source (or a free slot)
    rad = radii(edges, group_col)
    kk = F.when(F.col("dst_obs"), F.lit(k_labeled)).otherwise(F.lit(k_unlabeled))
    beat = (cand.join(rad, [*gc, "src", "dst_obs"], "left")
            .where(F.col("radius").isNull() | (F.col("n_neighbors") < kk) | (F.col("d2") <= F.col("radius")))
            .select(*gc, "src", "dst", "dst_obs", "d2"))
    beat = materialize(beat, "entering")  # read twice: the search runs once
    touched = beat.select(*gc, "src").distinct()
    old_touched = edges.join(touched, [*gc, "src"], "left_semi").select(*gc, "src", "dst", "dst_obs", "d2")
    merged = old_touched.unionByName(beat)
    w = Window.partitionBy(*gc, "src", "dst_obs").orderBy("d2", "dst")
    merged = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kk)
    kept = edges.join(touched, [*gc, "src"], "left_anti").select(*gc, "src", "dst", "dst_obs", "d2", "rank")
    fresh = own.select(*gc, "src", "dst", (F.col("kind") == KIND_LABELED).alias("dst_obs"), "d2", F.col("rank").cast("int"))
    out = kept.unionByName(merged.withColumn("rank", F.col("rank").cast("int"))).unionByName(fresh)
    obs = all_pts.select(*gc, F.col("id").alias("src"), F.col("observed").alias("src_obs"))
    return out.join(obs, [*gc, "src"]).select(*gc, "src", "src_obs", "dst", "dst_obs", "d2", edge_weight("d2", bandwidth).alias("w"), "rank")


def rebuild_with_metric(points: DataFrame, L, k_labeled: int, k_unlabeled: int, **kw) -> DataFrame:
    """Change the metric and rebuild the graph from scratch."""
    return build_graph(points, k_labeled, k_unlabeled, L=L, **kw)
