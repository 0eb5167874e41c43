"""Quality metrics and run aggregation (M1-M19) as DataFrame aggregations.

Predictions are long form ``(id, class, p)``; the truth is ``(id, label)``.  Each
row metric is one ``groupBy(id)`` and each summary one global ``agg`` of the
per-row values (partial aggregation, no collect).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The clip bound is the smallest positive float64 (spacing of 0.0).
EPS_64 = 5e-324
HIST_BINS = 20


def clip_normalize(f: DataFrame, eps: float = EPS_64) -> DataFrame:
    """M1: clip to ``[eps, 1-eps]`` and L1-normalise each row."""
    q = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1.0 - eps))
    s = F.sum("q").over(Window.partitionBy("id"))
    return f.withColumn("q", q).withColumn("p", F.col("q") / s).drop("q")


def row_metrics(f: DataFrame, truth: DataFrame, n_classes: int, eps: float = EPS_64,
                group_col: str | None = None) -> DataFrame:
    """Per row: ``valid`` (raw row not all zero), ``pred``, ``true``, ``l1`` (half L1 error),
    ``xent`` (cross-entropy / ln C), ``entropy`` (/ ln C) after M1."""
    gc = [group_col] if group_col else []
    lnc = math.log(n_classes) if n_classes > 1 else 1.0
    q = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1.0 - eps))
    rows = f.join(truth.select("id", F.col("label").alias("true")), "id").withColumn("q", q)
    per = rows.groupBy(*gc, "id", "true").agg(
        F.sum(F.abs("p")).alias("raw"),
        F.sum("q").alias("s"),
        F.collect_list(F.struct("class", "q")).alias("row"),
    )
    # the row holds exactly C entries: bounded by the class list
    per = per.withColumn("row", F.transform("row", lambda e: F.struct(e["class"].alias("class"), (e["q"] / F.col("s")).alias("q"))))
    best = F.array_sort(F.transform("row", lambda e: F.struct((-e["q"]).alias("nq"), e["class"].alias("class"))))[0]["class"]
    y = lambda e: F.when(e["class"] == F.col("true"), F.lit(1.0)).otherwise(F.lit(0.0))
    l1 = F.aggregate("row", F.lit(0.0), lambda acc, e: acc + F.abs(e["q"] - y(e))) / F.lit(2.0)
    xent = -F.aggregate("row", F.lit(0.0), lambda acc, e: acc + y(e) * F.log(e["q"])) / F.lit(lnc)
    ent = -F.aggregate("row", F.lit(0.0), lambda acc, e: acc + e["q"] * F.log(e["q"])) / F.lit(lnc)
    return per.select(*gc, "id", "true", (F.col("raw") != 0).alias("valid"), best.alias("pred"),
                      l1.alias("l1"), xent.alias("xent"), ent.alias("entropy"))


def evaluate(f: DataFrame, truth: DataFrame, n_classes: int, group_col: str | None = None) -> DataFrame:
    """M2-M7: one row of error metrics, over all rows ('mixed') and over valid rows (per group)."""
    gc = [group_col] if group_col else []
    r = row_metrics(f, truth, n_classes, group_col=group_col)
    miss = (F.col("pred") != F.col("true")).cast("double")
    v = F.col("valid")
    out = r.groupBy(*gc).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~v).alias("n_invalid"),
        F.avg(miss).alias("clf_error_mixed"),
        F.avg("l1").alias("l1_error_mixed"),
        F.avg("xent").alias("cross_ent_mixed"),
        F.avg(F.when(v, miss)).alias("clf_error_valid"),
        F.avg(F.when(v, F.col("l1"))).alias("l1_error_valid"),
        F.avg(F.when(v, F.col("xent"))).alias("cross_ent_valid"),
        F.avg(F.when(v, F.col("entropy"))).alias("entropy_pred_valid"),
        F.sum(F.when(v, F.col("entropy"))).alias("_ent_sum"),
    )
    return out.select(
        *gc, "n", "n_invalid", (F.col("n_invalid") / F.col("n")).alias("invalid_ratio"),
        "clf_error_mixed", "l1_error_mixed", "cross_ent_mixed",
        ((F.coalesce(F.col("_ent_sum"), F.lit(0.0)) + F.col("n_invalid")) / F.col("n")).alias("entropy_pred_mixed"),
        "clf_error_valid", "l1_error_valid", "cross_ent_valid", "entropy_pred_valid",
    )


def point_stats(f: DataFrame, n_classes: int) -> DataFrame:
    """M8: entropy (unclipped, 0 ln 0 = 0, / ln C), confidence (max p) and class of each row."""
    lnc = math.log(n_classes) if n_classes > 1 else 1.0
    term = F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(F.lit(0.0))
    return f.groupBy("id").agg(
        (-F.sum(term) / F.lit(lnc)).alias("entropy"),
        F.max("p").alias("confidence"),
        F.min_by(F.col("class"), F.struct(-F.col("p"), F.col("class"))).alias("pred"),
    )


def zero_one(pred: DataFrame, truth: DataFrame, pred_col: str = "pred") -> DataFrame:
    """M2 on decoded predictions: mean and sum of misses."""
    miss = (F.col(pred_col) != F.col("label")).cast("int")
    return pred.join(truth.select("id", "label"), "id").agg(
        F.avg(miss).alias("error"), F.sum(miss).cast("long").alias("misses"), F.count(F.lit(1)).alias("n"))


def test_error(pair_pred: DataFrame, truth: DataFrame) -> DataFrame:
    """M9: test error of the kNN part and of the combined prediction."""
    t = pair_pred.join(truth.select("id", "label"), "id")
    return t.agg(
        F.avg((F.col("pred_knn") != F.col("label")).cast("double")).alias("error_knn"),
        F.avg((F.col("pred_combined") != F.col("label")).cast("double")).alias("error_combined"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(pred: DataFrame, truth: DataFrame, pred_col: str = "pred") -> DataFrame:
    """Counts per (true, predicted) and the share within the true class."""
    c = pred.join(truth.select("id", "label"), "id").groupBy(F.col("label").alias("true"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    return c.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def corrected_samples(pair_pred: DataFrame, truth: DataFrame, n_samples: int | None = None, seed: int = 0) -> DataFrame:
    """Rows the kNN part got wrong and the combined prediction got right; optionally a hash sample of n."""
    from seedspread.functions.hashing import order_key

    c = pair_pred.join(truth.select("id", "label"), "id").where(
        (F.col("pred_knn") != F.col("label")) & (F.col("pred_combined") == F.col("label")))
    if n_samples is None:
        return c
    # a sampling operator: the limit is the feature (at most n rows)
    return c.withColumn("_k", order_key("id", seed)).orderBy("_k", "id").limit(int(n_samples)).drop("_k")


def histogram(values: DataFrame, value_col: str, group_col: str, bins: int = HIST_BINS) -> DataFrame:
    """Share of rows per bin of ``[0, 1]`` (last bin closed), per group (e.g. hit / miss)."""
    v = F.col(value_col)
    b = F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int")
    inside = values.where((v >= 0) & (v <= 1))
    total = values.groupBy(group_col).agg(F.count(F.lit(1)).alias("_tot"))
    counts = inside.groupBy(group_col, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, group_col).select(group_col, "bin", "n", (F.col("n") / F.col("_tot")).alias("ratio"))


def stream_profile(stream: DataFrame, label_col: str = "label", observed_col: str = "observed",
                   seq_col: str | None = None, bucket_size: int | None = None) -> DataFrame:
    """Labelled / unlabelled counts per class (and per arrival bucket)."""
    keys = [F.col(label_col).alias("label"), F.col(observed_col).alias("observed")]
    if seq_col is not None and bucket_size:
        keys.append(F.floor(F.col(seq_col) / bucket_size).cast("long").alias("seq_bucket"))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ run aggregation
def aggregate_runs(metrics: DataFrame, keys: Sequence[str] = ("metric", "t"), n_runs: int | None = None) -> DataFrame:
    """Mean and population std per ``(metric, t)`` over runs; std is null for one run.

    ``metrics``: ``(run, metric, t, score)``.  Steps seen by fewer than all runs
    (ragged series) are dropped.
    """
    if n_runs is None:
        n_runs = metrics.select("run").distinct().count()
    g = metrics.groupBy(*keys).agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.count(F.lit(1)).alias("n_runs"),
    ).where(F.col("n_runs") == F.lit(n_runs))
    if n_runs == 1:
        g = g.withColumn("std", F.lit(None).cast("double"))
    return g


def run_summary(agg: DataFrame, error_metric: str = "clf_error_mixed", time_metric: str = "iter_online_duration",
                keys: Sequence[str] = ()) -> DataFrame:
    """Mean time per step, first and last (mean) classification error."""
    m = F.col("metric")
    return agg.groupBy(*keys).agg(
        F.avg(F.when(m == time_metric, F.col("mean"))).alias("mean_time"),
        F.min_by(F.when(m == error_metric, F.col("mean")), F.when(m == error_metric, F.col("t"))).alias("first_error"),
        F.max_by(F.when(m == error_metric, F.col("mean")), F.when(m == error_metric, F.col("t"))).alias("last_error"),
    )


def metric_series(agg: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The mean curve of chosen metrics with a mean +- std band."""
    sd = F.coalesce(F.col("std"), F.lit(0.0))
    return agg.where(F.col("metric").isin(list(metrics))).select(
        "metric", "t", "mean", (F.col("mean") - sd).alias("lower"), (F.col("mean") + sd).alias("upper"))


def metric_sizes(metrics: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Inventory of the stored statistics: steps per metric."""
    return metrics.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("size"))


def sweep_report(per_run: DataFrame) -> DataFrame:
    """One row per swept value: mean and population std over runs of each summary column.

    ``per_run``: ``(value, run, runtime, est_error, knn_error, combined_error)``.
    """
    cols = ["runtime", "est_error", "knn_error", "combined_error"]
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return per_run.groupBy("value").agg(*aggs, F.count(F.lit(1)).alias("n_runs"))
