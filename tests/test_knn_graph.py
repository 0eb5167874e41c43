"""kNN join against NumPy brute force; graph invariants; incremental insert equals rebuild."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from seedspread.operators import graph as G
from seedspread.operators.knn import knn_join
from seedspread.plans.fixtures import embeddings_points
from seedspread.sources.datasets import load_points


def brute(X, ids, Q, qids, k, exclude_self):
    out = {}
    for qi, q in zip(qids, Q):
        d = ((X - q) ** 2).sum(1)
        cand = sorted((float(dd), int(i)) for dd, i in zip(d, ids) if not (exclude_self and i == qi))
        out[int(qi)] = [i for _, i in cand[:k]]
    return out


def test_knn_matches_brute_force_multi_block(spark):
    pts = load_points(spark, SF_SMALL, "embeddings")
    local = pts.orderBy("id").collect()
    X = np.array([r["x"] for r in local])
    ids = [r["id"] for r in local]
    want = brute(X, ids, X, ids, 5, True)
    # tiny blocks force many block pairs and the candidate merge
    nn = knn_join(pts, pts, 5, exclude_self=True, block_rows=64)
    got = {}
    for r in nn.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == want


def test_graph_invariants(spark):
    pts = embeddings_points(spark, SF_SMALL)
    e = G.build_graph(pts.select("id", "x", "observed"), 3, 4)
    assert e.where("src = dst").count() == 0
    deg = e.groupBy("src", "dst_obs").count()
    assert deg.where((F.col("dst_obs") & (F.col("count") != 3)) | (~F.col("dst_obs") & (F.col("count") != 4))).count() == 0
    t = G.transitions(e)
    sums = t.groupBy("src").agg(F.sum("p").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-12).count() == 0


def test_incremental_insert_equals_rebuild(spark):
    pts = embeddings_points(spark, SF_SMALL)
    cols = ["id", "x", "observed"]
    full = G.build_graph(pts.select(*cols), 3, 3)
    stored = pts.where("id % 4 <> 0").select(*cols)
    new = pts.where("id % 4 = 0").select(*cols)
    inc = G.insert_nodes(G.build_graph(stored, 3, 3), stored, new, 3, 3)
    key = ["src", "dst", "dst_obs"]
    a = full.select(*key, F.round("d2", 9).alias("d2"))
    b = inc.select(*key, F.round("d2", 9).alias("d2"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fewer_candidates_than_k(spark):
    q = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    nn = knn_join(q, q, 5, exclude_self=True)
    assert sorted((r["src"], r["dst"]) for r in nn.collect()) == [(1, 2), (2, 1)]


def test_far_point_all_weights_underflow(spark):
    from seedspread.operators import sampling as S
    from seedspread.operators.predict import predict_proba

    pts = spark.createDataFrame([(1, [0.0], 0, True), (2, [1.0], 1, True)], "id long, x array<double>, label int, observed boolean")
    y_l = S.one_hot(pts, "id", "label", [0, 1])
    q = spark.createDataFrame([(9, [1e6])], "id long, x array<double>")
    p = predict_proba(q, pts, y_l.limit(0), y_l, [0, 1], 2, 2, mode="knn").collect()
    assert all(r["p"] == 0.0 for r in p)


def test_lsh_distances_exact_and_recall(spark):
    pts = load_points(spark, SF_SMALL, "embeddings")
    local = pts.orderBy("id").collect()
    X = np.array([r["x"] for r in local])
    ids = [r["id"] for r in local]
    exact = brute(X, ids, X, ids, 3, True)
    approx = knn_join(pts, pts, 3, exclude_self=True, method="lsh", block_rows=64, lsh_tables=12, lsh_bits=2).collect()
    pos = {i: n for n, i in enumerate(ids)}
    hits = 0
    for r in approx:
        d = float(((X[pos[r["src"]]] - X[pos[r["dst"]]]) ** 2).sum())
        assert abs(d - r["d2"]) < 1e-9          # distances are exact, only recall is approximate
        assert r["src"] != r["dst"]
        hits += r["dst"] in exact[r["src"]]
    assert hits / (3 * len(ids)) >= 0.9
    # without a bit there is one bucket: the approximate join is the exact one
    same = knn_join(pts, pts, 3, exclude_self=True, method="lsh", lsh_bits=0).collect()
    got = {}
    for r in sorted(same, key=lambda r: (r["src"], r["rank"])):
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == exact


def test_lsh_recall_of_the_query_and_of_the_defaults(spark):
    from seedspread.plans.catalog import QUERIES

    pts = load_points(spark, SF_SMALL, "embeddings")
    exact = {(r["src"], r["dst"]) for r in knn_join(pts, pts, 3, exclude_self=True).collect()}
    for nn in (QUERIES["knn_approx"](spark, SF_SMALL), knn_join(pts, pts, 3, exclude_self=True, method="lsh")):
        got = {(r["src"], r["dst"]) for r in nn.collect()}
        assert len(got) == len(exact) and len(got & exact) / len(exact) >= 0.9


def test_lsh_rows_with_too_few_in_their_buckets_meet_all_rows(spark):
    # 2^16 buckets of a single table: nearly every row is alone in its bucket
    rng = np.random.default_rng(7)
    pts = spark.createDataFrame([(i, rng.normal(size=5).tolist(), i % 2) for i in range(60)], "id long, x array<double>, kind int")
    key = lambda t: sorted((r["src"], r["kind"], r["rank"], r["dst"]) for r in t.collect())
    for opts in ({"k": 3}, {"k": {0: 2, 1: 4}, "kind_col": "kind"}):
        got = key(knn_join(pts, pts, exclude_self=True, method="lsh", lsh_tables=1, lsh_bits=16, **opts))
        want = key(knn_join(pts, pts, exclude_self=True, **opts))
        assert len(got) == len(want)
        assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.9 * len(want)


def test_grouped_join_hot_group(spark):
    # one group holds most rows: it is cut into blocks, the result stays exact
    rows = [(0 if i < 300 else 1 + i % 5, i, [float(i % 17), float(i % 29)]) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, id long, x array<double>")
    nn = knn_join(df, df, 2, exclude_self=True, group_col="g", block_rows=32)
    local = {}
    for g, i, x in rows:
        local.setdefault(g, []).append((i, np.array(x)))
    for g, members in local.items():
        Xg = np.array([m[1] for m in members])
        idg = [m[0] for m in members]
        want = brute(Xg, idg, Xg, idg, 2, True)
        got = {}
        for r in nn.where(F.col("g") == g).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["dst"])
        assert got == want


def test_kernel_distances_equal_the_column_expression(spark):
    from seedspread.functions.vectors import sq_dist

    pts = load_points(spark, SF_SMALL, "embeddings")
    nn = knn_join(pts, pts, 3, exclude_self=True)
    a = pts.select(F.col("id").alias("src"), F.col("x").alias("xa"))
    b = pts.select(F.col("id").alias("dst"), F.col("x").alias("xb"))
    j = nn.join(a, "src").join(b, "dst").withColumn("d2e", sq_dist("xa", "xb"))
    assert j.where(F.abs(F.col("d2") - F.col("d2e")) > 1e-12).count() == 0
