"""Run store (S7, S8): statistics and configuration of each run as Parquet tables.

``<root>/metrics/experiment=<e>/run_id=<r>``  (metric, t, score) rows of one run;
``<root>/runs/experiment=<e>/run_id=<r>``     one row: created_at, config (JSON).
Saving a run overwrites its own partitions only, so a re-run replaces itself.

``<root>/moments/experiment=<e>/part=<p>``    (value, metric, t, n, mean, m2) of the runs of one sweep, by swept value.
Count, mean and sum of squared deviations merge: a report over any number of stored sweeps reads a row per sweep,
value, metric and step, whatever the number of runs.
"""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOMENT_KEYS = ("value", "metric", "t")


def save_run(spark: SparkSession, root: str, experiment: str, run_id: str, metrics: DataFrame, config: dict) -> None:
    """Persist a run's statistics and configuration under its run key."""
    base = root.rstrip("/")
    metrics.write.mode("overwrite").parquet(f"{base}/metrics/experiment={experiment}/run_id={run_id}")
    row = spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "config string")
    row.select(F.current_timestamp().alias("created_at"), "config").write.mode("overwrite").parquet(
        f"{base}/runs/experiment={experiment}/run_id={run_id}")


def load_latest_run(spark: SparkSession, root: str, experiment: str) -> DataFrame:
    """Statistics of the most recently saved run of an experiment (partition-pruned read)."""
    base = root.rstrip("/")
    runs = spark.read.parquet(f"{base}/runs").where(F.col("experiment") == experiment)
    latest = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("r")).first()["r"]
    if latest is None:
        raise FileNotFoundError(f"no run of {experiment!r} under {root}")
    m = spark.read.parquet(f"{base}/metrics")
    return m.where((F.col("experiment") == experiment) & (F.col("run_id") == latest)).drop("experiment")


def moments(scores: DataFrame, keys: Sequence[str] = MOMENT_KEYS) -> DataFrame:
    """``(keys, n, mean, m2)`` of ``(keys, score)`` rows: count, mean, sum of squared deviations from it.

    Null scores count for nothing; a key with none but nulls has no row.
    """
    some = scores.where(F.col("score").isNotNull())
    return some.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), (F.var_pop("score") * F.count(F.lit(1))).alias("m2"))


def merged(parts: DataFrame, keys: Sequence[str] = MOMENT_KEYS) -> DataFrame:
    """The moments of all runs together from the moments of parts of them.

    Deviations are taken from the merged mean (one shuffle by ``keys`` serves window and aggregate), not from
    differences of squares, which lose digits.
    """
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    shifted = parts.select(*keys, "n", "m2", F.col("mean").alias("_part"), mean.alias("_all"))
    return shifted.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_all").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("_part") - F.col("_all")) * (F.col("_part") - F.col("_all"))).alias("m2"))


def save_sweep(root: str, experiment: str, part: str, scores: DataFrame) -> None:
    """S7 for a sweep: the moments of ``(value, metric, t, score)`` rows, one per run, under the sweep's key.

    ``value`` is the swept value; saving ``part`` again replaces it.
    """
    rows = moments(scores.select(F.col("value").cast("string").alias("value"), "metric", F.col("t").cast("int").alias("t"), "score"))
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/moments/experiment={experiment}/part={part}")


def stored_report(spark: SparkSession, root: str, experiment: str) -> DataFrame:
    """M10, M16 over all stored sweeps of an experiment: ``(value, metric, t, n_runs, mean, std)``, ``std`` of the population, null for one run."""
    parts = spark.read.parquet(f"{root.rstrip('/')}/moments").where(F.col("experiment") == experiment)
    all_ = merged(parts)
    return all_.select(*MOMENT_KEYS, F.col("n").alias("n_runs"), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.col("n"))).alias("std"))
