"""Point sources (S1-S4): every loader returns ``(id long, x array<double>, label int)``.

The registry declares, per table, which column is the id, how the feature vector
is formed and which column is the class.  Everything is a projection over a
Parquet scan, so column pruning and filter pushdown reach the files.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from seedspread.functions.vectors import scale


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The 26 ASCII letters that make the document feature vector.
LETTERS = string.ascii_lowercase

# Divisor of the `part` features (p_size, p_retailprice).
PART_SCALE = 1000.0


def letter_profile(text: Column) -> Column:
    """L2-normalised counts of the letters a-z (either case) over the whole text.

    One pass per text: the UTF-8 bytes are counted with ``numpy.bincount`` (an
    ASCII letter is one byte and never occurs inside a multi-byte character), in
    Arrow batches.
    """
    lower = np.frombuffer(LETTERS.encode(), np.uint8)
    upper = np.frombuffer(LETTERS.upper().encode(), np.uint8)

    @pandas_udf("array<double>")
    def _profile(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            c = np.bincount(np.frombuffer(t.encode("utf-8"), np.uint8), minlength=256)
            v = (c[lower] + c[upper]).astype(np.float64)
            n = np.sqrt((v * v).sum())
            out.append(v / n if n > 0 else np.zeros(len(LETTERS)))
        return pd.Series(out)

    return _profile(text)


@dataclass(frozen=True)
class Dataset:
    table: str
    build: Callable[[DataFrame], DataFrame]


def _embeddings(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def _part(df: DataFrame) -> DataFrame:
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return df.select(F.col("p_partkey").alias("id"), scale(x, PART_SCALE).alias("x"),
                     F.lit(None).cast("int").alias("label"))


REGISTRY: dict[str, Dataset] = {
    "embeddings": Dataset("embeddings", _embeddings),
    "part": Dataset("part", _part),
}


def load_points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Load a registered data set as ``(id, x, label)``."""
    if name == "documents":
        return load_documents(spark, sf_dir)
    if name not in REGISTRY:
        raise FileNotFoundError(f"data set {name!r} is not registered")
    ds = REGISTRY[name]
    return ds.build(read_table(spark, sf_dir, ds.table))


def load_documents(spark: SparkSession, sf_dir: str, label_col: str = "quality") -> DataFrame:
    """Documents as letter-profile vectors; the class is ``labels.<label_col>`` where a label row exists.

    Adds ``observed`` = has a label row (naturally half-labelled, two classes).
    """
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), letter_profile(F.col("text")).alias("x"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
    return docs.join(labels, "id", "left").withColumn("observed", F.col("label").isNotNull())


# ---------------------------------------------------------------- S2
def scale_features(points: DataFrame, divisor: float, x_col: str = "x") -> DataFrame:
    return points.withColumn(x_col, scale(x_col, divisor))


# ---------------------------------------------------------------- lines
def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)`` of a text file or folder: lines counted from 0 through the files in name order.

    Files are read in splits; a split's lines come in order, so a line's number is its place
    in the split plus the lines of the splits before it.  Only the splits' counts (one row
    each) are put in order.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(offsets, ["_file", "_at"]).select("value", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"))


# ---------------------------------------------------------------- S3
def read_labeled_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated numbers per line: column 0 is the class, the rest the features (gz is read as is); the id is the line number."""
    lines = numbered_lines(spark, path)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return lines.where(F.length(F.trim("value")) > 0).select(
        F.col("line").alias("id"),
        parts.getItem(0).cast("double").cast("int").alias("label"),
        F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("x"),
    )


def write_labeled_text(points: DataFrame, path: str, compression: str = "gzip") -> None:
    """Inverse of ``read_labeled_text`` (used to derive text inputs from Parquet tables)."""
    line = F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.col("x").cast("array<string>"), " "))
    points.select(line.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


# ---------------------------------------------------------------- S4
def read_paired_text(spark: SparkSession, data_path: str, labels_path: str, header: bool = True) -> DataFrame:
    """Line n of the data file belongs to line n of the labels file; one header line each.

    The pairing is an equi-join on the line numbers (``numbered_lines``).
    """
    def numbered(path: str, name: str) -> DataFrame:
        return numbered_lines(spark, path).where(F.col("line") >= int(header)).withColumnRenamed("value", name)

    data = numbered(data_path, "data")
    labels = numbered(labels_path, "lab")
    feats = F.split(F.trim(F.col("data")), r"\s+").cast("array<double>")
    return data.join(labels, "line").select(
        (F.col("line") - (1 if header else 0)).alias("id"),
        feats.alias("x"),
        F.trim(F.col("lab")).cast("double").cast("int").alias("label"),
    )
