"""Golden metrics (FIXTURES.md §5) and run aggregation."""

import math

import pytest

from seedspread.operators import metrics as M


def test_golden_three_class_metrics(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 0, 0.0), (2, 1, 1.0), (2, 2, 0.0), (3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)]
    f = spark.createDataFrame(rows, "id long, class int, p double")
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, label int")
    per = {r["id"]: r for r in M.row_metrics(f, truth, 3).collect()}
    assert per[1]["l1"] == pytest.approx(0.7) and per[1]["xent"] == pytest.approx(1.095903, abs=1e-6)
    assert per[1]["entropy"] == pytest.approx(0.937231, abs=1e-6) and per[1]["pred"] == 0 and per[1]["valid"]
    assert per[2]["l1"] == pytest.approx(0.0) and per[2]["xent"] == pytest.approx(0.0) and per[2]["pred"] == 1
    assert per[3]["l1"] == pytest.approx(0.666667, abs=1e-6) and per[3]["xent"] == pytest.approx(1.0)
    assert per[3]["entropy"] == pytest.approx(1.0) and per[3]["pred"] == 0 and not per[3]["valid"]
    ev = M.evaluate(f, truth, 3).first()
    assert ev["clf_error_mixed"] == pytest.approx(2 / 3) and ev["clf_error_valid"] == pytest.approx(0.5)
    assert ev["n_invalid"] == 1 and ev["invalid_ratio"] == pytest.approx(1 / 3)
    # mixed entropy counts an invalid row as 1
    assert ev["entropy_pred_mixed"] == pytest.approx((0.937231 + 0.0 + 1.0) / 3, abs=1e-6)


def test_point_stats_zero_log_zero(spark):
    f = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "id long, class int, p double")
    s = {r["id"]: r for r in M.point_stats(f, 2).collect()}
    assert s[1]["entropy"] == 0.0 and s[1]["confidence"] == 1.0 and s[1]["pred"] == 1
    assert s[2]["entropy"] == pytest.approx(1.0) and s[2]["pred"] == 0  # tie: lowest class


def test_aggregate_runs_population_std_and_ragged(spark):
    m = spark.createDataFrame(
        [(0, "e", 1, 1.0), (1, "e", 1, 3.0), (0, "e", 2, 2.0), (0, "x", 1, 5.0), (1, "x", 1, 5.0)],
        "run long, metric string, t int, score double")
    agg = {(r["metric"], r["t"]): r for r in M.aggregate_runs(m).collect()}
    assert set(agg) == {("e", 1), ("x", 1)}          # ragged step (e, 2) dropped
    assert agg[("e", 1)]["mean"] == 2.0 and agg[("e", 1)]["std"] == pytest.approx(1.0)
    one = M.aggregate_runs(m.where("run = 0"), n_runs=1).collect()
    assert all(r["std"] is None for r in one)


def test_histogram_and_confusion(spark):
    v = spark.createDataFrame([(0.0, True), (0.05, True), (1.0, True), (0.5, False)], "v double, hit boolean")
    h = {(r["hit"], r["bin"]): r["ratio"] for r in M.histogram(v, "v", "hit").collect()}
    assert h[(True, 0)] == pytest.approx(1 / 3) and h[(True, 1)] == pytest.approx(1 / 3) and h[(True, 19)] == pytest.approx(1 / 3)
    assert h[(False, 10)] == 1.0
    pred = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, pred int")
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    c = {(r["true"], r["pred"]): (r["n"], r["ratio"]) for r in M.confusion(pred, truth).collect()}
    assert c[(0, 0)] == (1, 0.5) and c[(0, 1)] == (1, 0.5) and c[(1, 1)] == (1, 1.0)
    assert not math.isnan(c[(1, 1)][1])
