"""Run store: moments of stored sweeps merge to those of all runs; a part saved again replaces itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedspread.sources.runs import merged, moments, save_sweep, stored_report


def test_merged_parts_equal_all_runs_at_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    # scores far from zero with a small spread: differences of squares would lose it
    rows = [(str(v), m, t, 1e8 + float(rng.normal())) for v in (1, 2) for m in ("a", "b") for t in range(3) for _ in range(7)]
    scores = spark.createDataFrame(rows, "value string, metric string, t int, score double").withColumn("run", F.monotonically_increasing_id() % 5)
    scores = spark.createDataFrame(scores.collect(), scores.schema)
    for p in range(5):
        save_sweep(str(tmp_path), "e", f"p{p}", scores.where(F.col("run") == p))
    save_sweep(str(tmp_path), "other", "p0", scores)
    got = {(r.value, r.metric, r.t): r for r in stored_report(spark, str(tmp_path), "e").collect()}
    for key in {(r[0], r[1], r[2]) for r in rows}:
        x = np.array([r[3] for r in rows if (r[0], r[1], r[2]) == key])
        assert got[key].n_runs == len(x) == 7
        assert got[key].mean == pytest.approx(x.mean(), abs=1e-6) and got[key]["std"] == pytest.approx(x.std(), rel=1e-5)
    assert len(got) == 12


def test_a_part_saved_again_replaces_itself_and_one_run_has_no_std(spark, tmp_path):
    rows = spark.createDataFrame([("5", "err", 0, 0.5), ("5", "err", 1, None)], "value string, metric string, t int, score double")
    for _ in range(2):
        save_sweep(str(tmp_path), "e", "only", rows)
    assert [tuple(r) for r in stored_report(spark, str(tmp_path), "e").collect()] == [("5", "err", 0, 1, 0.5, None)]
    empty = moments(rows.where("false"))
    assert empty.count() == 0 and merged(empty).count() == 0


def test_bucket_count_follows_the_edges():
    from seedspread.operators.propagate import BUCKET_EDGES, MAX_BUCKETS, bucket_count

    assert [bucket_count(n) for n in (0, 1, BUCKET_EDGES, BUCKET_EDGES + 1)] == [1, 1, 1, 2]
    assert bucket_count(10**15) == MAX_BUCKETS
