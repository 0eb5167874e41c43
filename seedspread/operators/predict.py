"""Out-of-sample prediction (P1-P5): a pure join against the state, never an insert.

One kNN join per query batch finds ``k_l`` labelled and ``k_u`` unlabelled
neighbours at once; weights ``exp(-d2)`` are L1-normalised per query row and kind
(an all-zero row stays zero), then multiplied with the one-hot labels (P1) or the
estimates ``F`` (P2).  P3 is their sum (mass 2), P4 returns ``(P1, P3)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedspread.functions.vectors import edge_weight
from seedspread.operators.graph import KIND_LABELED, KIND_UNLABELED, _kinded
from seedspread.operators.knn import knn_join
from seedspread.operators.sampling import decode
from seedspread.session import materialize

MODES = ("knn", "lp", "pair", None)


def from_neighbors(nn: DataFrame, query_ids: DataFrame, f: DataFrame | None, y_l: DataFrame, classes: Sequence[int],
                   bandwidth: float = 1.0, group_col: str | None = None, label_keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """P1 and P2 from the neighbours ``(src, dst, kind, d2)`` of the query rows, each as ``(id, class, p)``.

    Without estimates ``f`` the second is all zeros.  With ``group_col`` on ``nn``, ``query_ids`` and ``f`` (and the labels shared) many variants at once;
    ``label_keys``: columns of ``nn`` that ``y_l`` has too, where variants have labels of their own.
    """
    gc = [group_col] if group_col else []
    w = edge_weight("d2", bandwidth)
    s = F.sum("w").over(Window.partitionBy(*gc, "src", "kind"))
    nn = nn.withColumn("w", w).withColumn("pn", F.coalesce(F.col("w") / F.nullif(s, F.lit(0.0)), F.lit(0.0)))
    cls = F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class")
    qz = query_ids.select(*gc, "id", cls, F.lit(0.0).alias("p"))
    lab = (nn.where(F.col("kind") == KIND_LABELED)
           .join(y_l.where(F.col("p") != 0).select(*label_keys, F.col("id").alias("dst"), "class", F.col("p").alias("y")), [*label_keys, "dst"])
           .select(*gc, F.col("src").alias("id"), "class", (F.col("pn") * F.col("y")).alias("p")))
    p_knn = lab.unionByName(qz).groupBy(*gc, "id", "class").agg(F.sum("p").alias("p"))
    if f is None:
        return p_knn, qz
    unl = (nn.where(F.col("kind") == KIND_UNLABELED)
           .join(f.select(*gc, F.col("id").alias("dst"), "class", F.col("p").alias("fp")), [*gc, "dst"])
           .select(*gc, F.col("src").alias("id"), "class", (F.col("pn") * F.col("fp")).alias("p")))
    p_lp = unl.unionByName(qz).groupBy(*gc, "id", "class").agg(F.sum("p").alias("p"))
    return p_knn, p_lp


def _parts(query: DataFrame, points: DataFrame, f: DataFrame, y_l: DataFrame, classes: Sequence[int],
           k_labeled: int, k_unlabeled: int, bandwidth: float = 1.0, knn: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    nn = knn_join(query.select("id", "x"), _kinded(points), {KIND_LABELED: k_labeled, KIND_UNLABELED: k_unlabeled},
                  kind_col="kind", **(knn or {}))
    if k_labeled and k_unlabeled:
        nn = materialize(nn, "neighbors")  # both kinds come from one search
    return from_neighbors(nn, query.select("id"), f, y_l, classes, bandwidth)


def predict_proba(query: DataFrame, points: DataFrame, f: DataFrame, y_l: DataFrame, classes: Sequence[int],
                  k_labeled: int, k_unlabeled: int, mode: str | None = None, knn: Mapping | None = None) -> DataFrame:
    """Long-form class distributions of the query rows ``(id, x)``.

    ``points``: stored ``(id, x, observed)``; ``f``: estimates of unlabelled points;
    ``y_l``: one-hot labels of labelled points.  ``mode``: ``knn`` (P1), ``lp`` (P2),
    ``None`` (P3), ``pair`` (P4: columns ``p_knn`` and ``p_combined``).  ``knn``: options of
    the neighbour search (``method="lsh"`` and its parameters for the approximate one).
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    # only the neighbour kinds the mode reads are searched
    k_l = k_labeled if mode != "lp" else 0
    k_u = k_unlabeled if mode != "knn" else 0
    p_knn, p_lp = _parts(query, points, f, y_l, classes, k_l, k_u, knn=knn)
    if mode == "knn":
        return p_knn
    if mode == "lp":
        return p_lp
    both = p_knn.withColumnRenamed("p", "p_knn").join(p_lp.withColumnRenamed("p", "p_lp"), ["id", "class"])
    both = both.withColumn("p_combined", F.col("p_knn") + F.col("p_lp"))
    if mode == "pair":
        return both.select("id", "class", "p_knn", "p_combined")
    return both.select("id", "class", F.col("p_combined").alias("p"))


def predict(query: DataFrame, points: DataFrame, f: DataFrame, y_l: DataFrame, classes: Sequence[int],
            k_labeled: int, k_unlabeled: int, mode: str | None = None, knn: Mapping | None = None) -> DataFrame:
    """P5: decoded classes ``(id, pred)``; ``pair`` gives ``(id, pred_knn, pred_combined)``."""
    proba = predict_proba(query, points, f, y_l, classes, k_labeled, k_unlabeled, mode, knn)
    if mode == "pair":
        a = decode(proba.select("id", "class", F.col("p_knn").alias("p"))).withColumnRenamed("pred", "pred_knn")
        b = decode(proba.select("id", "class", F.col("p_combined").alias("p"))).withColumnRenamed("pred", "pred_combined")
        return a.join(b, "id")
    return decode(proba)
