"""Learning quality on generated Gaussian clusters (FIXTURES.md §6): a test fixture, not a query."""

import numpy as np
from pyspark.sql import functions as F

from seedspread.operators import graph as G
from seedspread.operators import metrics as M
from seedspread.operators import sampling as S
from seedspread.operators.predict import predict
from seedspread.operators.propagate import normalize_l1, offline_propagate


def clusters(spark, n=500, c=10, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((c, dim))
    centres = 4 * centres / np.linalg.norm(centres, axis=1, keepdims=True)
    cen = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centres])
    noise = F.array(*[F.randn(seed * 100 + j) * 0.3 for j in range(dim)])
    df = spark.range(n).select(F.col("id"), (F.col("id") % c).cast("int").alias("label"))
    df = df.withColumn("x", F.zip_with(F.element_at(cen, F.col("label") + 1), noise, lambda a, b: (a + b) / 2))
    return df


def test_knn_and_propagation_learn_clusters(spark):
    pts = clusters(spark)
    from seedspread.session import cut_lineage

    pts = cut_lineage(S.mask_labels(pts, "id", "label", 0.04, 1))   # 2 labelled rows per class
    assert pts.where("observed").count() == 20
    classes = list(range(10))
    edges = G.build_graph(pts.select("id", "x", "observed"), 3, 3)
    y_l = S.one_hot(pts.where("observed"), "id", "label", classes)
    res = offline_propagate(G.transitions(edges), y_l, pts.where(~F.col("observed")).select("id"), classes)
    truth = pts.where(~F.col("observed")).select("id", "label")
    ev = M.evaluate(normalize_l1(res.f), truth, 10).first()
    assert ev["clf_error_mixed"] < 0.05
    pred = predict(pts.where(~F.col("observed")).select("id", "x"), pts.where("observed"), y_l.limit(0), y_l, classes, 3, 3,
                   mode="knn")
    assert M.zero_one(pred, truth).first()["error"] < 0.05
