"""The named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.

Float outputs are rounded to 6 places so that the SQL oracle (``oracle.py``) can be
compared value by value; ties are always broken by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedspread.operators import graph as G
from seedspread.operators import metrics as M
from seedspread.operators import sampling as S
from seedspread.operators.knn import knn_join
from seedspread.operators.predict import predict, predict_proba
from seedspread.operators.propagate import normalize_l1, offline_propagate
from seedspread.plans.fixtures import (
    K_L,
    K_U,
    MAX_ITER,
    SEED,
    TOL,
    classes_of,
    embeddings_points,
    embeddings_split,
    orders,
)
from seedspread.sources.datasets import load_points, read_table, scale_features

Query = Callable[[SparkSession, str], DataFrame]

# Diagonal of the linear metric used by `knn_metric` (entry i is 1 + (i mod 4) / 4).
METRIC_DIAGONAL_RULE = (1.0, 0.25, 4)
# Sampling parameters of the order queries.
BURN_N_LABELED = 2
BURN_RATIO = 0.5
REST_RATIO = 0.1
TAIL_N = 1000
TAIL_N_NULLS = 100
BUDGET_PER_CLASS = 300
PART_DIVISOR = 255.0


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def metric_diagonal(width: int):
    base, step, period = METRIC_DIAGONAL_RULE
    import numpy as np

    return np.diag([base + (i % period) * step for i in range(width)])


# ------------------------------------------------------------------ shared state
def _state(spark: SparkSession, sf_dir: str, pts: DataFrame | None = None):
    """Graph, transitions, labels and the converged estimates on masked ``embeddings``."""
    pts = pts if pts is not None else embeddings_points(spark, sf_dir)
    classes = classes_of(pts)
    edges = G.build_graph(pts.select("id", "x", "observed"), K_L, K_U)
    trans = G.transitions(edges)
    y_l = S.one_hot(pts.where("observed"), "id", "label", classes)
    unl = pts.where(~F.col("observed")).select("id")
    res = offline_propagate(trans, y_l, unl, classes, max_iter=MAX_ITER, tol=TOL)
    return pts, classes, edges, trans, y_l, res


# ------------------------------------------------------------------ step 1: predict hidden labels
def q_predict_knn(spark, sf):
    pts = embeddings_points(spark, sf)
    classes = classes_of(pts)
    hidden = pts.where(~F.col("observed"))
    y_l = S.one_hot(pts.where("observed"), "id", "label", classes)
    pred = predict(hidden.select("id", "x"), pts.where("observed"), y_l.limit(0), y_l, classes, K_L, K_U, mode="knn")
    return pred.join(hidden.select("id", "label"), "id").select("id", F.col("pred").cast("int").alias("pred"), "label")


def q_test_error(spark, sf):
    p = q_predict_knn(spark, sf)
    return M.zero_one(p.select("id", "pred"), p.select("id", "label")).select(r6("error").alias("error"), "misses", "n")


# ------------------------------------------------------------------ step 2: sampling on orders
def q_class_sizes(spark, sf):
    return S.class_sizes(orders(spark, sf), "o_orderstatus", min_size=2)


def _burn(spark, sf, shuffle=True):
    return S.burn_in_split(orders(spark, sf), "o_orderkey", "o_orderstatus", BURN_N_LABELED, BURN_RATIO, SEED,
                           shuffle=shuffle, seq_col="o_orderkey")


def q_burn_in_split(spark, sf):
    return _burn(spark, sf).where("burn_in").select("o_orderkey", "o_orderstatus", "observed", "burn_rank")


def q_burn_in_split_ordered(spark, sf):
    return _burn(spark, sf, shuffle=False).where("burn_in").select("o_orderkey", "o_orderstatus", "observed", "burn_rank")


def q_label_mask(spark, sf):
    return S.mask_labels(orders(spark, sf), "o_orderkey", "o_orderpriority", REST_RATIO, SEED).select(
        "o_orderkey", "o_orderpriority", "observed")


def q_uniform_mask(spark, sf):
    return S.uniform_mask(orders(spark, sf), "o_orderkey", REST_RATIO, SEED).select("o_orderkey", "observed")


def _stream(spark, sf):
    """Burn-in + masked rest + arrival order: the label stream of a run over `orders`."""
    b = _burn(spark, sf)
    rest = S.mask_labels(b.where(~F.col("burn_in")).drop("observed"), "o_orderkey", "o_orderstatus", REST_RATIO, SEED)
    both = b.where("burn_in").unionByName(rest)
    return S.arrival_order(both, "o_orderkey", "o_orderstatus", SEED)


def q_arrival_order(spark, sf):
    return _stream(spark, sf).select("o_orderkey", "seq", "burn_in")


def q_hide_labels(spark, sf):
    s = S.hide_labels(_stream(spark, sf), "o_orderstatus", "observed")
    return s.select("seq", "o_orderkey", "label_seen", "observed")


def q_replay(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    return S.replay(ev, "event_id", shuffle=True, seed=SEED).select("event_id", "pos")


def q_label_budget(spark, sf):
    out = S.label_budget(_burn(spark, sf), "o_orderkey", "o_orderstatus", BUDGET_PER_CLASS, SEED)
    return out.select("o_orderkey", "o_orderstatus", "observed")


def q_tail_split(spark, sf):
    return S.tail_split(orders(spark, sf), "o_orderkey", "o_orderkey", TAIL_N).select("o_orderkey", "is_test")


def half_labeled(spark, sf):
    """``documents`` with the quality label where there is one, and a ``seq`` only for the labelled."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").withColumn("seq", F.when(F.col("quality").isNotNull(), F.col("doc_id") % 97))


def q_label_mask_nulls(spark, sf):
    return S.mask_labels(half_labeled(spark, sf), "doc_id", "quality", REST_RATIO, SEED).select("doc_id", "quality", "observed")


def q_replay_nulls(spark, sf):
    return S.replay(half_labeled(spark, sf), "doc_id", seq_col="seq").select("doc_id", "seq", "pos")


def q_tail_split_nulls(spark, sf):
    return S.tail_split(half_labeled(spark, sf), "doc_id", "seq", TAIL_N_NULLS).select("doc_id", "seq", "is_test")


def q_stratified_split(spark, sf):
    return S.stratified_split(orders(spark, sf), "o_orderkey", "o_orderstatus", 0.2, 7).select(
        "o_orderkey", "o_orderstatus", "is_test")


def q_one_hot(spark, sf):
    pts = embeddings_points(spark, sf)
    return S.one_hot(pts.where("observed"), "id", "label", classes_of(pts)).select(
        "id", F.col("class").cast("int").alias("class"), "p")


def q_store_counts(spark, sf):
    return S.store_counts(embeddings_points(spark, sf))


def q_labeled_part(spark, sf):
    return S.labeled_part(embeddings_points(spark, sf)).select("id", "label")


def q_scaled_features(spark, sf):
    part = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"))
    s = scale_features(part, PART_DIVISOR)
    return s.select("id", r6(F.col("x")[0]).alias("x0"), r6(F.col("x")[1]).alias("x1"))


# ------------------------------------------------------------------ step 3: kNN and graph
def _graph_out(e):
    return e.select("src", "dst", "dst_obs", r6("d2").alias("d2"), r6("w").alias("w"), F.col("rank").cast("int").alias("rank"))


def _edge_out(df):
    return df.select("src", "dst", r6("d2").alias("d2"), F.col("rank").cast("int").alias("rank"))


def q_knn_exact(spark, sf):
    pts = load_points(spark, sf, "embeddings")
    return _edge_out(knn_join(pts, pts, 3, exclude_self=True))


def q_knn_metric(spark, sf):
    from seedspread.operators.knn import project

    pts = load_points(spark, sf, "embeddings")
    width = len(pts.select("x").first()["x"])
    p = project(pts, metric_diagonal(width))
    return _edge_out(knn_join(p, p, 3, exclude_self=True))


def q_knn_labeled(spark, sf):
    pts = embeddings_points(spark, sf)
    return _edge_out(knn_join(pts.where(~F.col("observed")), pts.where("observed"), K_L))


def q_knn_unlabeled(spark, sf):
    pts = embeddings_points(spark, sf)
    return _edge_out(knn_join(pts.where("observed"), pts.where(~F.col("observed")), K_U))


def q_knn_part(spark, sf):
    pts = load_points(spark, sf, "part")
    return _edge_out(knn_join(pts, pts, 3, exclude_self=True))


def _graph(spark, sf):
    pts = embeddings_points(spark, sf)
    return G.build_graph(pts.select("id", "x", "observed"), K_L, K_U)


def q_knn_graph(spark, sf):
    return _graph_out(_graph(spark, sf))


def q_adjacency(spark, sf):
    a = G.adjacency(_graph(spark, sf))
    return a.select("src", "dst_obs", F.array_join("neighbors", ",").alias("neighbors"), "degree")


def q_reverse_adjacency(spark, sf):
    return G.reverse_adjacency(_graph(spark, sf)).select("node", "src_obs", "src", "in_degree")


def q_radii(spark, sf):
    return G.radii(_graph(spark, sf)).select("src", "dst_obs", r6("radius").alias("radius"), "n_neighbors")


def q_transitions(spark, sf):
    t = G.transitions(G.drop_zero_weights(_graph(spark, sf)))
    return t.select("src", "dst", r6("p").alias("p"))


def q_graph_incremental(spark, sf):
    """K14 + K15: insert `embeddings` in 10 arrival batches; must equal the full build."""
    from seedspread.session import cut_lineage

    pts = embeddings_points(spark, sf)
    ordered = S.replay(pts, "id", shuffle=True, seed=SEED)
    n = pts.count()
    size = max(1, -(-n // 10))
    ordered = cut_lineage(ordered.withColumn("batch", F.floor(F.col("pos") / size).cast("int")))
    cols = ["id", "x", "observed"]
    stored = ordered.where(F.col("batch") == 0).select(*cols)
    edges = cut_lineage(G.build_graph(stored, K_L, K_U))
    for b in range(1, 10):
        new = ordered.where(F.col("batch") == b).select(*cols)
        edges = cut_lineage(G.insert_nodes(edges, stored, new, K_L, K_U))
        stored = cut_lineage(stored.unionByName(new))
    return edges.select("src", "dst", "dst_obs", r6("d2").alias("d2"), r6("w").alias("w"), F.col("rank").cast("int").alias("rank"))


# ------------------------------------------------------------------ step 4: offline propagation
def q_offline_lp(spark, sf):
    _, _, _, _, _, res = _state(spark, sf)
    f = normalize_l1(res.f)
    return f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def q_lp_residuals(spark, sf):
    _, _, _, _, _, res = _state(spark, sf)
    rows = [(i + 1, float(round(r, 6))) for i, r in enumerate(res.residuals)]
    return spark.createDataFrame(rows, "iteration int, change double")


def q_decode_labels(spark, sf):
    pts, _, _, _, _, res = _state(spark, sf)
    return S.decode(normalize_l1(res.f)).select("id", F.col("pred").cast("int").alias("pred"))


def q_two_class_lp(spark, sf):
    """Offline propagation on documents (two classes, naturally half labelled)."""
    from seedspread.session import cut_lineage

    docs = cut_lineage(load_points(spark, sf, "documents"))
    classes = classes_of(docs)
    edges = G.build_graph(docs.select("id", "x", "observed"), K_L, K_U)
    trans = G.transitions(edges)
    y_l = S.one_hot(docs.where("observed"), "id", "label", classes)
    res = offline_propagate(trans, y_l, docs.where(~F.col("observed")).select("id"), classes, max_iter=MAX_ITER, tol=TOL)
    f = normalize_l1(res.f)
    return f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


# ------------------------------------------------------------------ step 5: prediction on a test split
def _split_state(spark, sf):
    train, test = embeddings_split(spark, sf)
    pts, classes, edges, trans, y_l, res = _state(spark, sf, train)
    f = normalize_l1(res.f)
    return train, test, classes, y_l, f


def _proba_out(df, cols):
    return df.select("id", F.col("class").cast("int").alias("class"), *[r6(c).alias(c) for c in cols])


def q_predict_lp(spark, sf):
    train, test, classes, y_l, f = _split_state(spark, sf)
    return _proba_out(predict_proba(test.select("id", "x"), train, f, y_l, classes, K_L, K_U, mode="lp"), ["p"])


def q_predict_combined(spark, sf):
    train, test, classes, y_l, f = _split_state(spark, sf)
    return _proba_out(predict_proba(test.select("id", "x"), train, f, y_l, classes, K_L, K_U), ["p"])


def q_predict_pair(spark, sf):
    train, test, classes, y_l, f = _split_state(spark, sf)
    p = predict(test.select("id", "x"), train, f, y_l, classes, K_L, K_U, mode="pair")
    return p.select("id", F.col("pred_knn").cast("int").alias("pred_knn"), F.col("pred_combined").cast("int").alias("pred_combined"))


# ------------------------------------------------------------------ step 6: metrics
def q_evaluate(spark, sf):
    pts, classes, _, _, _, res = _state(spark, sf)
    truth = pts.where(~F.col("observed")).select("id", "label")
    e = M.evaluate(normalize_l1(res.f), truth, len(classes))
    return e.select("n", "n_invalid", *[r6(c).alias(c) for c in e.columns if c not in ("n", "n_invalid")])


def q_point_stats(spark, sf):
    pts, classes, _, _, _, res = _state(spark, sf)
    s = M.point_stats(normalize_l1(res.f), len(classes))
    return s.select("id", r6("entropy").alias("entropy"), r6("confidence").alias("confidence"), F.col("pred").cast("int").alias("pred"))


def q_test_error_pair(spark, sf):
    train, test, classes, y_l, f = _split_state(spark, sf)
    p = predict(test.select("id", "x"), train, f, y_l, classes, K_L, K_U, mode="pair")
    e = M.test_error(p, test.select("id", "label"))
    return e.select(r6("error_knn").alias("error_knn"), r6("error_combined").alias("error_combined"), "n")


def q_confusion(spark, sf):
    p = q_predict_knn(spark, sf)
    c = M.confusion(p.select("id", "pred"), p.select("id", "label"))
    return c.select(F.col("true").cast("int").alias("true"), F.col("pred").cast("int").alias("pred"), "n", r6("ratio").alias("ratio"))


def q_corrected_samples(spark, sf):
    train, test, classes, y_l, f = _split_state(spark, sf)
    p = predict(test.select("id", "x"), train, f, y_l, classes, K_L, K_U, mode="pair")
    c = M.corrected_samples(p, test.select("id", "label"))
    return c.select("id", F.col("pred_knn").cast("int").alias("pred_knn"), F.col("pred_combined").cast("int").alias("pred_combined"), "label")


def q_entropy_histogram(spark, sf):
    pts, classes, _, _, _, res = _state(spark, sf)
    s = M.point_stats(normalize_l1(res.f), len(classes)).join(pts.select("id", "label"), "id")
    s = s.withColumn("hit", F.col("pred") == F.col("label"))
    h = M.histogram(s, "entropy", "hit")
    return h.select("hit", "bin", "n", r6("ratio").alias("ratio"))


def q_stream_profile(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    m = S.uniform_mask(ev, "event_id", REST_RATIO, SEED)
    return M.stream_profile(m, "event_type", "observed", seq_col="event_id", bucket_size=1000).select(
        F.col("label").alias("event_type"), "observed", "seq_bucket", "n")


QUERIES: dict[str, Query] = {
    # step 1
    "predict_knn": q_predict_knn,
    "test_error": q_test_error,
    # step 2
    "class_sizes": q_class_sizes,
    "burn_in_split": q_burn_in_split,
    "burn_in_split_ordered": q_burn_in_split_ordered,
    "label_mask": q_label_mask,
    "uniform_mask": q_uniform_mask,
    "arrival_order": q_arrival_order,
    "hide_labels": q_hide_labels,
    "replay": q_replay,
    "label_budget": q_label_budget,
    "tail_split": q_tail_split,
    "stratified_split": q_stratified_split,
    "label_mask_nulls": q_label_mask_nulls,
    "replay_nulls": q_replay_nulls,
    "tail_split_nulls": q_tail_split_nulls,
    "one_hot": q_one_hot,
    "store_counts": q_store_counts,
    "labeled_part": q_labeled_part,
    "scaled_features": q_scaled_features,
    # step 3
    "knn_exact": q_knn_exact,
    "knn_metric": q_knn_metric,
    "knn_labeled": q_knn_labeled,
    "knn_unlabeled": q_knn_unlabeled,
    "knn_part": q_knn_part,
    "knn_graph": q_knn_graph,
    "adjacency": q_adjacency,
    "reverse_adjacency": q_reverse_adjacency,
    "radii": q_radii,
    "transitions": q_transitions,
    "graph_incremental": q_graph_incremental,
    # step 4
    "offline_lp": q_offline_lp,
    "lp_residuals": q_lp_residuals,
    "decode_labels": q_decode_labels,
    "two_class_lp": q_two_class_lp,
    # step 5
    "predict_lp": q_predict_lp,
    "predict_combined": q_predict_combined,
    "predict_pair": q_predict_pair,
    # step 6
    "evaluate": q_evaluate,
    "point_stats": q_point_stats,
    "test_error_pair": q_test_error_pair,
    "confusion": q_confusion,
    "corrected_samples": q_corrected_samples,
    "entropy_histogram": q_entropy_histogram,
    "stream_profile": q_stream_profile,
}


# ------------------------------------------------------------------ step 8: one arrival, local propagation
def _arrival(spark, sf, labeled: bool):
    """Stored = every row but the last arrival of one kind (hash order); then insert that row."""
    from seedspread.functions.hashing import order_key
    from seedspread.session import cut_lineage

    pts = cut_lineage(embeddings_points(spark, sf))
    kind = F.col("observed") if labeled else ~F.col("observed")
    # the latest arrival: a top-1 by the arrival key (the limit is the feature)
    new = pts.where(kind).withColumn("_k", order_key("id", SEED, S.SALT_ORDER)).orderBy(
        F.col("_k").desc(), F.col("id").desc()).limit(1).drop("_k")
    new = cut_lineage(new)
    stored = pts.join(new.select("id"), "id", "left_anti")
    return pts, stored, new


def _insert_query(spark, sf, labeled: bool, theta: float | None = None, top_ratio: float | None = None):
    from seedspread.operators.propagate import hop_cap, propagate_local
    from seedspread.plans.fixtures import THETA
    from seedspread.session import cut_lineage

    pts, stored, new = _arrival(spark, sf, labeled)
    classes = classes_of(pts)
    cols = ["id", "x", "observed"]
    edges = cut_lineage(G.build_graph(stored.select(*cols), K_L, K_U))
    trans = G.transitions(edges)
    y_l = S.one_hot(stored.where("observed"), "id", "label", classes)
    res = offline_propagate(trans, y_l, stored.where(~F.col("observed")).select("id"), classes, max_iter=MAX_ITER, tol=TOL)
    f = normalize_l1(res.f)
    edges2 = G.insert_nodes(edges, stored.select(*cols), new.select(*cols), K_L, K_U)
    trans2 = G.transitions(edges2)
    y_l2 = S.one_hot(pts.where("observed"), "id", "label", classes)
    n_unl = pts.where(~F.col("observed")).count()
    out = propagate_local(trans2, y_l2, f, new.select("id", "observed"), classes,
                          theta=THETA if theta is None else theta, max_hops=hop_cap(n_unl, K_U), top_ratio=top_ratio)
    return out.f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def q_online_insert_unlabeled(spark, sf):
    return _insert_query(spark, sf, labeled=False)


def q_online_insert_labeled(spark, sf):
    return _insert_query(spark, sf, labeled=True)


def q_top_ratio_updates(spark, sf):
    return _insert_query(spark, sf, labeled=False, top_ratio=0.5)


QUERIES.update({
    "online_insert_unlabeled": q_online_insert_unlabeled,
    "online_insert_labeled": q_online_insert_labeled,
    "top_ratio_updates": q_top_ratio_updates,
})


# ------------------------------------------------------------------ step 9: streaming
STREAM_FILES = 5
STREAM_BURN_IN_SHARE = 0.5


def run_stream(spark, sf, n_files: int = STREAM_FILES):
    """Replay masked `embeddings` as a file stream (hash arrival order) through the learner."""
    from seedspread.session import cut_lineage, scratch_dir
    from seedspread.streaming.learner import LearnerConfig, StreamLearner, read_stream, start_learner, write_stream_files

    # the train part of the split is streamed; the test part is scored when arrivals cross multiples of eval_every
    pts, test = embeddings_split(spark, sf)
    classes = classes_of(pts)
    rows = cut_lineage(S.replay(pts, "id", shuffle=True, seed=SEED).select(
        F.col("pos").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), "x",
        F.col("label").cast("int").alias("label"), "observed"))
    n = rows.count()
    src = scratch_dir(spark, "stream-src")
    write_stream_files(rows, src, n_files)
    cfg = LearnerConfig(classes=classes, k_labeled=K_L, k_unlabeled=K_U, n_burn_in=int(n * STREAM_BURN_IN_SHARE),
                        eval_every=max(1, n // 2))
    learner = StreamLearner(spark, scratch_dir(spark, "stream-state"), cfg, truth=pts.select("id", "label"),
                            test=test.select("id", "x", "label"))
    q = start_learner(read_stream(spark, src), learner, scratch_dir(spark, "stream-ckpt"))
    q.awaitTermination()
    learner.finish()
    return learner


def q_stream_fit(spark, sf):
    learner = run_stream(spark, sf)
    f = learner.estimates(learner.last_version())
    return f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def q_stream_points(spark, sf):
    """The stored points: what arrived, once each, without the labels that aren't observed."""
    learner = run_stream(spark, sf)
    return learner.points(learner.last_version()).select("seq", "id", F.col("label").alias("label_seen"), "observed")


def q_stream_edges(spark, sf):
    """The graph at the end of the stream: that of a rebuild, however the rows were batched."""
    learner = run_stream(spark, sf)
    return learner.edges(learner.last_version()).select("src", "dst", "dst_obs", r6("d2").alias("d2"), "rank")


def q_stream_metrics(spark, sf):
    learner = run_stream(spark, sf)
    m = spark.read.parquet(learner._p("metrics"))
    return m.select("run", "batch_id", "t", "metric", r6("score").alias("score"))


QUERIES.update({"stream_fit": q_stream_fit, "stream_metrics": q_stream_metrics, "stream_points": q_stream_points, "stream_edges": q_stream_edges})


# ------------------------------------------------------------------ step 10: sweeps and runs
# Fixed values of the sweeps (neighbour and theta values as in the reference's sweep configs).
SWEEP_K = (1, 3, 7, 11, 15, 19)
SWEEP_THETA = (0.0, 0.1, 0.5, 1.0, 1.5, 2.0)
SWEEP_RATIOS = (0.05, 0.1, 0.2)
SWEEP_BUDGETS = (5, 10)          # labels per class, scaled to the size of `embeddings`
N_RUNS = 3                       # seed of run n is 42 * n


def _ev_cols(df, key, key_type="int"):
    return df.select(F.col("g").cast(key_type).alias(key), *[c for c in ("n_labeled",) if c in df.columns],
                     F.col("n_iter").cast("int").alias("n_iter"), "n", "n_invalid",
                     r6("clf_error_mixed").alias("clf_error_mixed"), r6("l1_error_mixed").alias("l1_error_mixed"),
                     r6("cross_ent_mixed").alias("cross_ent_mixed"), r6("entropy_pred_mixed").alias("entropy_pred_mixed"))


def q_sweep_k_labeled(spark, sf):
    from seedspread.operators.sweep import sweep_neighbors

    pts = embeddings_points(spark, sf)
    ev = sweep_neighbors(pts, classes_of(pts), SWEEP_K, "labeled", K_U, MAX_ITER, TOL)
    return _ev_cols(ev, "k_labeled")


def q_sweep_k_unlabeled(spark, sf):
    from seedspread.operators.sweep import sweep_neighbors

    pts = embeddings_points(spark, sf)
    ev = sweep_neighbors(pts, classes_of(pts), SWEEP_K, "unlabeled", K_L, MAX_ITER, TOL)
    return _ev_cols(ev, "k_unlabeled")


def q_sweep_label_ratio(spark, sf):
    from seedspread.operators.sweep import ratio_masks, sweep_masks

    pts = load_points(spark, sf, "embeddings")
    ev = sweep_masks(ratio_masks(pts, SWEEP_RATIOS, SEED), classes_of(pts), K_L, K_U, MAX_ITER, TOL)
    return _ev_cols(ev, "ratio_index").withColumn("ratio", ratio_from_index("ratio_index"))


def ratio_from_index(c):
    return F.element_at(F.array(*[F.lit(r) for r in SWEEP_RATIOS]), F.col(c) + 1)


def q_sweep_labels_per_class(spark, sf):
    from seedspread.operators.sweep import budget_masks, sweep_masks

    pts = load_points(spark, sf, "embeddings")
    masks = budget_masks(pts, SWEEP_BUDGETS, BURN_N_LABELED, BURN_RATIO, SEED)
    ev = sweep_masks(masks, classes_of(pts), K_L, K_U, MAX_ITER, TOL)
    return _ev_cols(ev, "labels_per_class")


def _runs(spark, sf):
    from seedspread.operators.sweep import seeded_masks, sweep_masks
    from seedspread.plans.fixtures import OBS_RATIO

    pts = load_points(spark, sf, "embeddings")
    seeds = [SEED * n for n in range(N_RUNS)]
    return sweep_masks(seeded_masks(pts, seeds, OBS_RATIO), classes_of(pts), K_L, K_U, MAX_ITER, TOL)


def q_default_runs(spark, sf):
    return _ev_cols(_runs(spark, sf), "run")


def q_sweep_theta(spark, sf):
    """One arrival propagated locally for every theta; graph and offline fit shared."""
    from seedspread.operators.propagate import hop_cap, propagate_local
    from seedspread.session import cut_lineage

    pts, stored, new = _arrival(spark, sf, labeled=False)
    classes = classes_of(pts)
    cols = ["id", "x", "observed"]
    edges = cut_lineage(G.build_graph(stored.select(*cols), K_L, K_U))
    y_l = S.one_hot(stored.where("observed"), "id", "label", classes)
    res = offline_propagate(G.transitions(edges), y_l, stored.where(~F.col("observed")).select("id"), classes,
                            max_iter=MAX_ITER, tol=TOL)
    f = cut_lineage(normalize_l1(res.f))
    trans2 = cut_lineage(G.transitions(G.insert_nodes(edges, stored.select(*cols), new.select(*cols), K_L, K_U)))
    y_l2 = S.one_hot(pts.where("observed"), "id", "label", classes)
    n_unl = pts.where(~F.col("observed")).count()
    truth = pts.where(~F.col("observed")).select("id", "label")
    out = None
    for th in SWEEP_THETA:
        r = propagate_local(trans2, y_l2, f, new.select("id", "observed"), classes, theta=th, max_hops=hop_cap(n_unl, K_U))
        ev = M.evaluate(r.f, truth, len(classes)).select(
            F.lit(th).alias("theta"), F.lit(r.hops).alias("hops"), F.lit(int(sum(r.applied_per_hop))).alias("n_updates"),
            r6("clf_error_mixed").alias("clf_error_mixed"), r6("l1_error_mixed").alias("l1_error_mixed"))
        ev = cut_lineage(ev)
        out = ev if out is None else out.unionByName(ev)
    return out


# run statistics: (run, metric, t, score); t = iteration for the propagation change, share of the arrivals for the rest
RUN_STEPS = 4
RUN_METRICS = ("clf_error_mixed", "l1_error_mixed", "cross_ent_mixed", "entropy_pred_mixed", "invalid_ratio")


def run_metrics(spark, sf):
    """Statistics of N_RUNS runs: each is evaluated when a quarter, half, ... of its arrivals are in (``t``),
    and the changes of its last propagation are kept (``lp_change``, ``t`` counts its iterations)."""
    from seedspread.operators.sweep import GROUP, prefixes, run_variants, seeded_masks
    from seedspread.plans.fixtures import OBS_RATIO
    from seedspread.session import materialize

    pts = load_points(spark, sf, "embeddings")
    seeds = [SEED * n for n in range(N_RUNS)]
    points_g = materialize(prefixes(materialize(seeded_masks(pts, seeds, OBS_RATIO)), RUN_STEPS, dict(enumerate(seeds))))
    _, ev, res = run_variants(points_g, classes_of(pts), K_L, K_U, MAX_ITER, TOL)
    width = RUN_STEPS + 1
    rows = [(int(g) // width, "lp_change", i + 1, float(v)) for g, vals in res.residuals.items() if g % width == RUN_STEPS for i, v in enumerate(vals)]
    changes = spark.createDataFrame(rows, "run long, metric string, t int, score double")
    series = ev.select(F.floor(F.col(GROUP) / width).alias("run"), (F.col(GROUP) % width).cast("int").alias("t"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in RUN_METRICS])).alias("m")).select(
        "run", F.col("m.metric").alias("metric"), "t", F.col("m.score").alias("score"))
    return materialize(changes.unionByName(series))


def q_runs_aggregate(spark, sf):
    agg = M.aggregate_runs(run_metrics(spark, sf), n_runs=N_RUNS)
    return agg.select("metric", "t", r6("mean").alias("mean"), r6("std").alias("std"), F.col("n_runs").cast("long").alias("n_runs"))


def q_run_summary(spark, sf):
    """First and last classification error over the runs (the time per step differs from run to run: not returned)."""
    agg = M.aggregate_runs(run_metrics(spark, sf), n_runs=N_RUNS)
    s = M.run_summary(agg, error_metric="clf_error_mixed")
    return s.select(r6("first_error").alias("first_error"), r6("last_error").alias("last_error"))


def q_metric_series(spark, sf):
    agg = M.aggregate_runs(run_metrics(spark, sf), n_runs=N_RUNS)
    s = M.metric_series(agg, ["lp_change", "clf_error_mixed"])
    return s.select("metric", "t", r6("mean").alias("mean"), r6("lower").alias("lower"), r6("upper").alias("upper"))


def q_metric_sizes(spark, sf):
    return M.metric_sizes(run_metrics(spark, sf)).select("run", "metric", F.col("size").cast("long").alias("size"))


def q_sweep_report(spark, sf):
    """Per swept k_labeled value, mean / population std over runs of the estimates' error and of the
    kNN and combined errors on the test split (the runtime differs from run to run: not returned)."""
    from seedspread.operators.sweep import GROUP, seeded_masks, sweep_test_errors
    from seedspread.plans.fixtures import OBS_RATIO
    from seedspread.session import materialize

    train, test = embeddings_split(spark, sf)
    classes = classes_of(train)
    masked = materialize(seeded_masks(train.drop("observed"), [SEED * n for n in range(N_RUNS)], OBS_RATIO), "masks")
    out = sweep_test_errors(masked, test, classes, SWEEP_K, K_U, MAX_ITER, TOL, run_col=GROUP).withColumnRenamed(GROUP, "run")
    rep = M.sweep_report(out)
    shown = [c for c in rep.columns if c not in ("value", "n_runs") and not c.startswith("runtime")]
    return rep.select(F.col("value").cast("int").alias("value"), *[r6(c).alias(c) for c in shown], F.col("n_runs").cast("long").alias("n_runs"))


def q_latest_run(spark, sf):
    """S7 + S8: store each run's statistics under a run key, then load the latest run."""
    from seedspread.session import scratch_dir
    from seedspread.sources.runs import load_latest_run, save_run

    root = scratch_dir(spark, "runs")
    m = run_metrics(spark, sf)
    for n in range(N_RUNS):
        save_run(spark, root, "default", str(n), m.where(F.col("run") == n).drop("run"), {"seed": SEED * n, "k_l": K_L})
    latest = load_latest_run(spark, root, "default")
    return latest.select(F.col("run_id").cast("string").alias("run_id"), "metric", "t", r6("score").alias("score"))


def q_stored_report(spark, sf):
    """S7, M10, M16 over stored sweeps: label ratios are swept twice, with other seeds; each sweep keeps its moments, the report merges them."""
    from seedspread.operators.sweep import GROUP, ratio_masks, run_variants
    from seedspread.session import materialize, scratch_dir
    from seedspread.sources.runs import save_sweep, stored_report

    root = scratch_dir(spark, "sweeps")
    pts = load_points(spark, sf, "embeddings")
    n = len(STORED_RATIOS)
    masks = None
    for run, seed in enumerate(STORED_SEEDS):
        part = ratio_masks(pts, STORED_RATIOS, seed).withColumn(GROUP, F.col(GROUP) + run * n)
        masks = part if masks is None else masks.unionByName(part)
    _, ev, _ = run_variants(materialize(masks), classes_of(pts), K_L, K_U, MAX_ITER, TOL)
    value = F.element_at(F.array(*[F.lit(str(r)) for r in STORED_RATIOS]), (F.col(GROUP) % n + 1).cast("int"))
    scores = materialize(ev.select(F.floor(F.col(GROUP) / n).alias("run"), value.alias("value"), F.lit(0).alias("t"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in ("clf_error_mixed", "l1_error_mixed")])).alias("m")).select("run", "value", "m.metric", "t", "m.score"))
    for part, runs in STORED_PARTS.items():
        save_sweep(root, "label_ratio", part, scores.where(F.col("run").isin(runs)))
    return stored_report(spark, root, "label_ratio").select("value", "metric", "t", "n_runs", r6("mean").alias("mean"), r6("std").alias("std"))


# label ratios swept in two stored parts: seeds of three runs, and the runs of each part
STORED_RATIOS = (0.05, 0.2)
STORED_SEEDS = (SEED, 2 * SEED, 3 * SEED)
STORED_PARTS = {"first": [0, 1], "second": [2]}


QUERIES.update({
    "stored_report": q_stored_report,
    "sweep_k_labeled": q_sweep_k_labeled,
    "sweep_k_unlabeled": q_sweep_k_unlabeled,
    "sweep_label_ratio": q_sweep_label_ratio,
    "sweep_labels_per_class": q_sweep_labels_per_class,
    "sweep_theta": q_sweep_theta,
    "default_runs": q_default_runs,
    "runs_aggregate": q_runs_aggregate,
    "run_summary": q_run_summary,
    "metric_series": q_metric_series,
    "metric_sizes": q_metric_sizes,
    "sweep_report": q_sweep_report,
    "latest_run": q_latest_run,
})


# ------------------------------------------------------------------ sources: text inputs derived from the tables
def q_labeled_text(spark, sf):
    """S3: `embeddings` written as whitespace text (label first, gz), read back by the text source."""
    from seedspread.session import scratch_dir
    from seedspread.sources.datasets import read_labeled_text, write_labeled_text

    path = scratch_dir(spark, "labeled-text")
    write_labeled_text(load_points(spark, sf, "embeddings"), path)
    pts = read_labeled_text(spark, path)
    return pts.select("label", F.size("x").alias("n_features"),
                      r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("x_sum"), r6(F.col("x")[0]).alias("x0"))


def q_paired_text(spark, sf):
    """Features and labels in two text files paired by line number (one header line each)."""
    from seedspread.session import scratch_dir
    from seedspread.sources.datasets import read_paired_text

    root = scratch_dir(spark, "paired-text")
    emb = read_table(spark, sf, "embeddings")
    # both files come from the same unshuffled scan, so their parts hold the same rows in the same order
    feats = emb.select(F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ").alias("value"))
    labs = emb.select(F.col("label").cast("string").alias("value"))
    for name, body in (("data", feats), ("labels", labs)):
        header = spark.createDataFrame([(f"# {name}",)], "value string").coalesce(1)
        header.unionAll(body).write.mode("overwrite").text(f"{root}/{name}")
    pts = read_paired_text(spark, f"{root}/data", f"{root}/labels")
    return pts.select("label", F.size("x").alias("n_features"),
                      r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("x_sum"))


def q_graph_metric(spark, sf):
    """Change the metric (fixed diagonal L) and rebuild the graph."""
    pts = embeddings_points(spark, sf)
    width = len(pts.select("x").first()["x"])
    e = G.rebuild_with_metric(pts.select("id", "x", "observed"), metric_diagonal(width), K_L, K_U)
    return e.select("src", "dst", "dst_obs", r6("d2").alias("d2"), r6("w").alias("w"), F.col("rank").cast("int").alias("rank"))


def q_clip_normalize(spark, sf):
    """M1 on the kNN-part distributions of the hidden rows (zeros clipped to the smallest float)."""
    pts = embeddings_points(spark, sf)
    classes = classes_of(pts)
    hidden = pts.where(~F.col("observed"))
    y_l = S.one_hot(pts.where("observed"), "id", "label", classes)
    p = predict_proba(hidden.select("id", "x"), pts.where("observed"), y_l.limit(0), y_l, classes, K_L, K_U, mode="knn")
    c = M.clip_normalize(p)
    return c.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


QUERIES.update({
    "labeled_text": q_labeled_text,
    "paired_text": q_paired_text,
    "graph_metric": q_graph_metric,
    "clip_normalize": q_clip_normalize,
})


# ------------------------------------------------------------------ step 11: approximate kNN for large inputs
# Fixed values of the approximate queries: with 12 hash tables of 2 random hyperplanes (seed 17),
# over 9 of 10 nearest neighbours of `embeddings` share a bucket.
LSH_TABLES, LSH_BITS, LSH_SEED = 12, 2, 17


def q_knn_approx(spark, sf):
    pts = load_points(spark, sf, "embeddings")
    nn = knn_join(pts, pts, 3, exclude_self=True, method="lsh", lsh_tables=LSH_TABLES, lsh_bits=LSH_BITS, lsh_seed=LSH_SEED)
    return _edge_out(nn)


# With 12 tables of 2 planes, over 9 of 10 nearest neighbours of `embeddings` share a bucket.
APPROX = {"method": "lsh", "lsh_tables": 12, "lsh_bits": 2, "lsh_seed": 17}


def q_graph_approx(spark, sf):
    """K6 with the approximate search."""
    pts = embeddings_points(spark, sf)
    return _graph_out(G.build_graph(pts.select("id", "x", "observed"), K_L, K_U, knn=APPROX))


def q_predict_approx(spark, sf):
    """P1 with the approximate search."""
    train, test = embeddings_split(spark, sf)
    classes = classes_of(train)
    y_l = S.one_hot(train.where("observed"), "id", "label", classes)
    p = predict_proba(test.select("id", "x"), train.select("id", "x", "observed"), None, y_l, classes, K_L, K_U, mode="knn", knn=APPROX)
    return p.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


QUERIES.update({"knn_approx": q_knn_approx, "graph_approx": q_graph_approx, "predict_approx": q_predict_approx})


# ------------------------------------------------------------------ step 12: sweeps of whole streaming runs
STREAM_STEPS = 3                 # micro-batches after the burn-in


def stream_order(burn, rest, seed: int):
    """One run's rows in arrival order: burn-in (D2) first, the masked rest shuffled."""
    both = burn.where("burn_in").unionByName(rest.select(*burn.columns))
    return S.arrival_order(both, "id", "label", seed).select("seq", "id", "x", F.col("label").cast("int").alias("label"), "observed")


def run_variants_stream(spark, sf, graphs: dict, thetas: dict):
    """Replay many runs over the train part of `embeddings` as one stream through the grouped learner.

    ``graphs``: graph -> (seed, mask of the rest, given the burn-in split); ``thetas``: variant -> (graph, theta).
    Returns one row per variant and micro-batch, with the test errors at the end of its run.
    """
    from seedspread.session import materialize, scratch_dir
    from seedspread.streaming.learner import start_learner
    from seedspread.streaming.variants import VariantConfig, VariantLearner, read_steps, write_steps

    train, test = embeddings_split(spark, sf)
    train = train.drop("observed")
    classes = classes_of(train)
    rows = None
    for g, (seed, mask) in graphs.items():
        burn = materialize(S.burn_in_split(train, "id", "label", BURN_N_LABELED, BURN_RATIO, seed), "burn")
        run = stream_order(burn, mask(burn, seed), seed).withColumn("g", F.lit(g).cast("long"))
        rows = run if rows is None else rows.unionByName(run)
    rows = materialize(rows, "runs")
    # every run has the same rows, in its own order; the burn-in of a class doesn't depend on the seed
    n, n_burn = train.count(), burn.where("burn_in").count()
    size = max(1, -(-(n - n_burn) // STREAM_STEPS))
    src = scratch_dir(spark, "variant-stream")
    write_steps(rows, src, [0, *(n_burn + k * size for k in range(STREAM_STEPS + 1))])
    cfg = VariantConfig(classes=classes, k_labeled=K_L, k_unlabeled=K_U, n_burn_in=n_burn, max_iter=MAX_ITER, tol=TOL, run="variants", thetas=thetas)
    learner = VariantLearner(spark, scratch_dir(spark, "variant-state"), cfg, truth=train.select("id", "label"), test=test.select("id", "x", "label"))
    start_learner(read_steps(spark, src), learner, scratch_dir(spark, "variant-ckpt")).awaitTermination()
    series = learner.series().where(F.col("metric").isin("n_labeled", "n_unlabeled", "hops", "n_updates", "clf_error_mixed", "l1_error_mixed", "entropy_pred_mixed"))
    wide = series.groupBy("v", "batch_id").pivot("metric", ["n_labeled", "n_unlabeled", "hops", "n_updates", "clf_error_mixed", "l1_error_mixed", "entropy_pred_mixed"]).agg(F.first("score"))
    out = wide.join(learner.finish(), "v")
    return out.select(
        F.col("v").cast("int").alias("variant"), F.col("batch_id").cast("int").alias("step"), *[F.col(c).cast("long").alias(c) for c in ("n_labeled", "n_unlabeled", "hops", "n_updates")],
        *[r6(c).alias(c) for c in ("clf_error_mixed", "l1_error_mixed", "entropy_pred_mixed", "error_knn", "error_combined")])


def _masked(ratio: float):
    return lambda burn, seed: S.mask_labels(burn.where(~F.col("burn_in")).drop("observed"), "id", "label", ratio, seed)


def q_stream_runs(spark, sf):
    """Runs over seeds, each a whole stream: burn-in, insertions, errors per step, test error."""
    from seedspread.plans.fixtures import THETA

    graphs = {n: (SEED * n, _masked(REST_RATIO)) for n in range(N_RUNS)}
    return run_variants_stream(spark, sf, graphs, {n: (n, THETA) for n in graphs})


def q_stream_theta(spark, sf):
    """One stream and graph, learners with different thresholds."""
    return run_variants_stream(spark, sf, {0: (SEED, _masked(REST_RATIO))}, {k: (0, th) for k, th in enumerate(SWEEP_THETA)})


def q_stream_budgets(spark, sf):
    """Label budgets per class."""
    from seedspread.plans.fixtures import THETA

    graphs = {k: (SEED, lambda burn, seed, b=b: S.label_budget(burn, "id", "label", b, seed)) for k, b in enumerate(SWEEP_BUDGETS)}
    return run_variants_stream(spark, sf, graphs, {k: (k, THETA) for k in graphs})


def q_stream_ratios(spark, sf):
    """Label ratios of the stream, drawn without regard to class."""
    from seedspread.plans.fixtures import THETA

    graphs = {k: (SEED, lambda burn, seed, r=r: S.uniform_mask(burn.where(~F.col("burn_in")).drop("observed"), "id", r, seed)) for k, r in enumerate(SWEEP_RATIOS)}
    return run_variants_stream(spark, sf, graphs, {k: (k, THETA) for k in graphs})


QUERIES.update({"stream_runs": q_stream_runs, "stream_theta": q_stream_theta, "stream_budgets": q_stream_budgets, "stream_ratios": q_stream_ratios})


# ------------------------------------------------------------------ step 13: exact search by pivot cells, ties
PRUNED = {"method": "pruned"}


def tied_parts(spark, sf):
    """`part` with features of a few whole numbers: most distances repeat, also at the last neighbour kept."""
    part = read_table(spark, sf, "part")
    x = F.array((F.col("p_size") % 8).cast("double"), (F.floor(F.col("p_retailprice") / 50) % 8).cast("double"))
    return part.select(F.col("p_partkey").cast("long").alias("id"), x.alias("x"))


def q_knn_ties(spark, sf):
    """K3, K4 where distances are equal: the smaller ids are kept."""
    pts = tied_parts(spark, sf)
    return _edge_out(knn_join(pts, pts, 3, exclude_self=True))


def q_knn_ties_pruned(spark, sf):
    pts = tied_parts(spark, sf)
    return _edge_out(knn_join(pts, pts, 3, exclude_self=True, **PRUNED))


def q_knn_pruned(spark, sf):
    pts = load_points(spark, sf, "part")
    return _edge_out(knn_join(pts, pts, 3, exclude_self=True, **PRUNED))


def q_graph_pruned(spark, sf):
    """K6 through the pruned search (both neighbour kinds at once)."""
    pts = embeddings_points(spark, sf)
    return _graph_out(G.build_graph(pts.select("id", "x", "observed"), K_L, K_U, knn=PRUNED))


def q_predict_pruned(spark, sf):
    """P1 through the pruned search."""
    pts = embeddings_points(spark, sf)
    classes = classes_of(pts)
    hidden = pts.where(~F.col("observed"))
    y_l = S.one_hot(pts.where("observed"), "id", "label", classes)
    pred = predict(hidden.select("id", "x"), pts.where("observed"), None, y_l, classes, K_L, K_U, mode="knn", knn=PRUNED)
    return pred.join(hidden.select("id", "label"), "id").select("id", F.col("pred").cast("int").alias("pred"), "label")


QUERIES.update({"knn_ties": q_knn_ties, "knn_ties_pruned": q_knn_ties_pruned, "knn_pruned": q_knn_pruned, "graph_pruned": q_graph_pruned, "predict_pruned": q_predict_pruned})
