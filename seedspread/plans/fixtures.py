"""Shared inputs of the named queries: the test tables turned into points and masks.

Fixed values of the query suite (one place, used by the Spark queries and the SQL oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedspread.operators.sampling import mask_labels, stratified_split
from seedspread.session import materialize
from seedspread.sources.datasets import load_points, read_table

# Fixed values of the query suite.
SEED = 42            # seed of run 0 of the hash orders
OBS_RATIO = 0.2      # observed share per class of `embeddings`
K_L = 3              # labelled neighbours
K_U = 3              # unlabelled neighbours
TOL = 1e-3           # offline propagation tolerance
MAX_ITER = 30        # offline propagation iteration cap
THETA = 0.1          # significance threshold of local propagation
TEST_RATIO = 0.2     # stratified test share for prediction queries
TEST_SEED = 7        # seed of the test split
MAX_CLASSES = 10_000  # class lists are small by definition; bigger ones are refused


def classes_of(df: DataFrame, col: str = "label") -> list:
    """The sorted class list (bounded: at most MAX_CLASSES values reach the driver)."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes for a class list")
    return sorted(r[0] for r in rows)


def embeddings_points(spark: SparkSession, sf_dir: str, seed: int = SEED, ratio: float = OBS_RATIO) -> DataFrame:
    """``embeddings`` as ``(id, x, label, observed)`` with the standard per-class mask.

    Written once as Parquet to the shared folder: every query reads it several times
    (class list, block sizing, joins), and a lost executor must not redo the mask.
    """
    return materialize(mask_labels(load_points(spark, sf_dir, "embeddings"), "id", "label", ratio, seed), "points")


def embeddings_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train points with mask, test points) for prediction queries."""
    pts = load_points(spark, sf_dir, "embeddings")
    split = materialize(stratified_split(pts, "id", "label", TEST_RATIO, TEST_SEED), "split")
    train = materialize(mask_labels(split.where(~F.col("is_test")).drop("is_test"), "id", "label", OBS_RATIO, SEED), "train")
    test = split.where(F.col("is_test")).drop("is_test")
    return train, test


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
