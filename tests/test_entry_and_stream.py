"""Driver contract and the streaming learner (one arrival per batch = sequential algorithm; replay)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import points_df
from seedspread.session import scratch_dir
from seedspread.streaming.learner import LearnerConfig, StreamLearner


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["id", "pred", "label"]


def test_every_query_has_an_oracle_or_is_marked():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    text = {n for n in q if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}  # the optional text operators
    assert set(q) - set(sql) - text <= {"stream_fit", "stream_metrics"}


def _batch(spark, seq, row):
    i, x, y = row
    return spark.createDataFrame([(seq, i, [float(v) for v in x], y, y is not None)],
                                 "seq long, id long, x array<double>, label int, observed boolean")


def test_stream_learner_matches_golden_graph_a_and_replays(spark):
    cfg = LearnerConfig(classes=[0, 1], k_labeled=2, k_unlabeled=2, theta=0.1, n_burn_in=5)
    learner = StreamLearner(spark, scratch_dir(spark, "test-stream"), cfg)
    burn = [(1, [0.0], 0), (2, [2.0], 1), (11, [0.5], None), (12, [1.5], None), (13, [1.2], None)]
    data = [(s, i, [float(v) for v in x], y, y is not None) for s, (i, x, y) in enumerate(burn)]
    learner.process(spark.createDataFrame(data, "seq long, id long, x array<double>, label int, observed boolean"), 0)
    learner.process(_batch(spark, 5, (14, [1.0], None)), 1)
    learner.process(_batch(spark, 6, (3, [1.1], 1)), 2)
    f = learner.estimates(learner.last_version())
    c0 = {r["id"]: r["p"] for r in f.where(F.col("class") == 0).collect()}
    for i, v in {11: 0.427056, 12: 0.154666, 13: 0.172273, 14: 0.312090}.items():
        assert c0[i] == pytest.approx(v, abs=1e-6)
    before = sorted((r["id"], r["class"], round(r["p"], 12)) for r in f.collect())
    # replaying batch 2 (same id) overwrites its own version with the same state
    learner.process(_batch(spark, 6, (3, [1.1], 1)), 2)
    f2 = learner.estimates(learner.last_version())
    assert sorted((r["id"], r["class"], round(r["p"], 12)) for r in f2.collect()) == before
    # a duplicate delivery in a later batch is dropped (idempotent ingest)
    learner.process(_batch(spark, 7, (3, [1.1], 1)), 3)
    assert learner.last_version() == 2


def test_an_id_twice_in_a_batch_counts_once(spark):
    cfg = LearnerConfig(classes=[0, 1], k_labeled=2, k_unlabeled=2, theta=0.1, n_burn_in=5)
    burn = [(1, [0.0], 0), (2, [2.0], 1), (11, [0.5], None), (12, [1.5], None), (13, [1.2], None)]
    schema = "seq long, id long, x array<double>, label int, observed boolean"
    data = [(s, i, [float(v) for v in x], y, y is not None) for s, (i, x, y) in enumerate(burn)]
    states = []
    for copies in (1, 2):
        learner = StreamLearner(spark, scratch_dir(spark, "test-twice"), cfg)
        learner.process(spark.createDataFrame(data * copies, schema), 0)
        learner.process(spark.createDataFrame([(5 + k, 14, [1.0], 1, False) for k in range(copies)], schema), 1)
        f = learner.estimates(1)
        states.append(sorted((r["id"], r["class"], round(r["p"], 9)) for r in f.collect()))
        points = learner.points(1).collect()
        assert len(points) == 6 and {r["label"] for r in points if not r["observed"]} == {None}  # hidden labels stay outside
        arrivals = spark.read.parquet(learner._p("arrivals")).collect()
        assert [(r["id"], r["seq"]) for r in arrivals] == [(14, 5)]
    assert states[0] == states[1]


def test_foreign_or_newer_state_is_refused(spark):
    cfg = LearnerConfig(classes=[0, 1], n_burn_in=50)
    where = scratch_dir(spark, "test-owner")
    learner = StreamLearner(spark, where, cfg)
    learner.process(_batch(spark, 0, (1, [0.0], 0)), 0)
    learner.process(_batch(spark, 1, (2, [1.0], 1)), 1)
    with pytest.raises(ValueError, match="fresh state folder"):
        learner.process(_batch(spark, 0, (1, [0.0], 0)), 0)
    other = StreamLearner(spark, where, LearnerConfig(classes=[0, 1], n_burn_in=50, run="run1"))
    with pytest.raises(ValueError, match="run0"):
        other.process(_batch(spark, 2, (3, [1.0], 1)), 2)


def test_stream_restart_from_checkpoint_gives_same_state(spark):
    from seedspread.streaming.learner import read_stream, start_learner

    rng = np.random.default_rng(5)
    rows = []
    for i in range(24):
        c = i % 2
        x = (rng.standard_normal(2) * 0.3 + (3.0 if c else 0.0)).tolist()
        rows.append((i, 100 + i, x, c, i % 4 == 0))
    schema = "seq long, id long, x array<double>, label int, observed boolean"
    parts = [rows[0:10], rows[10:14], rows[14:19], rows[19:24]]

    def write(folder, chunk):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)

    cfg = LearnerConfig(classes=[0, 1], k_labeled=2, k_unlabeled=2, theta=0.1, n_burn_in=10)

    # uninterrupted run
    src_a = scratch_dir(spark, "src-a")
    for p in parts:
        write(src_a, p)
    la = StreamLearner(spark, scratch_dir(spark, "state-a"), cfg)
    start_learner(read_stream(spark, src_a), la, scratch_dir(spark, "ck-a")).awaitTermination()

    # the same stream, stopped after two files and restarted from its checkpoint
    src_b = scratch_dir(spark, "src-b")
    ck_b = scratch_dir(spark, "ck-b")
    lb = StreamLearner(spark, scratch_dir(spark, "state-b"), cfg)
    for p in parts[:2]:
        write(src_b, p)
    start_learner(read_stream(spark, src_b), lb, ck_b).awaitTermination()
    for p in parts[2:]:
        write(src_b, p)
    start_learner(read_stream(spark, src_b), lb, ck_b).awaitTermination()

    def state(learner):
        f = learner.estimates(learner.last_version())
        return sorted((r["id"], r["class"], round(r["p"], 9)) for r in f.collect())

    assert la.last_version() == lb.last_version() == 3
    assert state(la) == state(lb)
