"""Exact ranks without one task per group.

``row_number() over (partition by g order by k)`` sends every row of a group to a
single task; with one class holding a third of all rows that task holds a third of
the data.  ``bucketed_rank`` gives the same numbers in two passes:

1. a *bucket* column that never decreases along the order (leading bits of a hash
   key, or a quantile bin of a numeric key) splits each group into many pieces;
2. ``groupBy(g, bucket).count()`` -- a small table, at most groups x buckets rows --
   gives each piece its offset by a running sum;
3. the row number inside ``(g, bucket)`` plus the offset is the exact rank.

Ties on the order key are broken by the caller's order columns (always end with a
unique id).

``drawn`` marks the first rows of each group without ranking the others: the same count
table says which buckets are taken whole and in which one the quota ends; only the rows
of that bucket are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.functions.hashing import hash_bucket


def bucketed_rank(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    bucket: Column,
    name: str = "rank",
    size_col: str | None = None,
) -> DataFrame:
    """Add ``name`` = exact ``row_number() over (partition by partition_cols order by order_cols)``.

    ``bucket`` must be non-decreasing in ``order_cols`` within a partition, null first.
    Null partition values are one partition, null order keys come where the order
    columns put them.  With
    ``size_col`` the partition's row count is added too (taken from the small
    count table, no extra pass over the data).
    """
    parts = list(partition_cols)
    b = "_rk_bucket"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("_rk_n"))
    running = Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    cols = [*parts, b, F.coalesce(F.sum("_rk_n").over(running), F.lit(0)).alias("_rk_off")]
    if size_col:
        cols.append(F.sum("_rk_n").over(Window.partitionBy(*parts)).alias(size_col))
    offsets = counts.select(*cols)
    # null-safe: a row without a class or an order key is ranked like any other
    keys = {c: f"_rk_on{i}" for i, c in enumerate([*parts, b])}
    offsets = offsets.withColumnsRenamed(keys)
    same = F.lit(True)
    for c, o in keys.items():
        same &= F.col(c).eqNullSafe(F.col(o))
    inner = Window.partitionBy(*parts, b).orderBy(*order_cols)
    return (
        d.join(offsets, on=same)
        .withColumn(name, (F.col("_rk_off") + F.row_number().over(inner)).cast("long"))
        .drop(b, "_rk_off", *keys.values())
    )


def hash_rank(
    df: DataFrame,
    partition_cols: Sequence[str],
    key_col: str,
    id_col: str,
    name: str = "rank",
    size_col: str | None = None,
) -> DataFrame:
    """Exact rank by ``(key_col, id_col)`` where ``key_col`` is a hex hash string."""
    return bucketed_rank(df, partition_cols, [F.col(key_col), F.col(id_col)], hash_bucket(key_col), name, size_col)


def drawn(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column,
    quota: Callable[[Column], Column],
    name: str = "drawn",
    descending: bool = False,
) -> DataFrame:
    """Add ``name`` = the row is among the first ``quota(n)`` of its group of ``n`` rows, by ``order_cols``.

    The same rows as ``bucketed_rank(...) <= quota(n)``, without a sort of all rows: the
    count table says in which bucket of each group the quota ends, only that bucket's rows
    are sorted (with 16 hash bits one row in 65536; rows that tie on a numeric key share a
    bucket), and the row at which it ends is a bound that all rows are compared with.
    ``descending`` turns all order columns.  ``bucket`` and nulls are as in
    ``bucketed_rank``; a quota below 1 draws nothing; rows equal in all order columns are
    drawn together.  A call without ``partition_cols`` finds its bound at once.
    """
    parts, b, at = list(partition_cols), "_dr_bucket", F.struct(*[F.col(c) for c in order_cols])
    d = df.withColumn(b, F.coalesce(bucket, F.lit(-1)))
    counts = d.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("_dr_n"))
    running = Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("_dr_end", F.sum("_dr_n").over(running))
    whole = sums.withColumn("_dr_quota", quota(F.sum("_dr_n").over(Window.partitionBy(*parts))))
    start, end, wanted = F.col("_dr_end") - F.col("_dr_n"), F.col("_dr_end"), F.col("_dr_quota")
    ends_in = (start < wanted) & (end > wanted)
    bounds = [
        F.max(F.when(end <= wanted, F.col(b))).alias("_dr_last"),
        F.max(F.when(ends_in, F.col(b))).alias("_dr_cut"),
        F.max(F.when(ends_in, wanted - start)).alias("_dr_need"),
    ]
    nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*[F.col(c).desc() if descending else F.col(c) for c in order_cols]))
    in_cut = F.col(b) == F.col("_dr_cut")
    if parts:
        keys = [f"_dr_on{i}" for i in range(len(parts))]
        limits = whole.groupBy(*parts).agg(*bounds).withColumnsRenamed(dict(zip(parts, keys, strict=True)))
        joined = d.join(limits, on=_same(parts, keys))
        ends = joined.where(in_cut).withColumn("_dr_nth", nth).where("_dr_nth = _dr_need").select(*keys, at.alias("_dr_at"))
        others = [f"{k}e" for k in keys]
        limits = limits.join(ends.withColumnsRenamed(dict(zip(keys, others, strict=True))), on=_same(keys, others), how="left")
        d, helpers = d.join(limits.drop(*others), on=_same(parts, keys)), keys
    else:
        limit = whole.agg(*bounds).first()
        d, helpers = d.withColumns({c: F.lit(limit[c]).cast("long") for c in ("_dr_last", "_dr_cut")}), []
        end = d.where(in_cut).withColumn("_dr_nth", nth).where(F.col("_dr_nth") == F.lit(limit["_dr_need"])).select(at.alias("_dr_at")).first()
        kind = dict(d.select(at.alias("_dr_at")).dtypes)["_dr_at"]
        d = d.withColumn("_dr_at", F.struct(*[F.lit(v) for v in end["_dr_at"]]).cast(kind) if end else F.lit(None).cast(kind))
    before = (at >= F.col("_dr_at")) if descending else (at <= F.col("_dr_at"))
    taken = F.coalesce(F.col(b) <= F.col("_dr_last"), F.lit(False)) | F.coalesce(in_cut & before, F.lit(False))
    return d.withColumn(name, taken).drop(b, "_dr_last", "_dr_cut", "_dr_need", "_dr_at", *helpers)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of columns."""
    same = F.lit(True)
    for x, y in zip(left, right, strict=True):
        same &= F.col(x).eqNullSafe(F.col(y))
    return same


def with_quantile_bucket(
    df: DataFrame, col: str, out: str, n_buckets: int = 1024, descending: bool = False
) -> DataFrame:
    """Add a bucket column for a numeric order key, cut at approximate quantiles.

    Nulls have a bucket of their own: first in ascending, last in descending order, as
    Spark sorts them.  The boundaries only shape the pieces; the rank itself stays exact.  The
    driver receives at most ``n_buckets - 1`` numbers; the lookup is Spark ML's
    ``Bucketizer`` (binary search in the JVM).
    """
    from pyspark.ml.feature import Bucketizer

    probs = [i / n_buckets for i in range(1, n_buckets)]
    key = F.col(col).cast("double")
    bounds = df.agg(F.percentile_approx(key, probs, 10 * n_buckets).alias("q")).first()["q"]
    bounds = sorted({float(v) for v in (bounds or []) if v is not None})
    tmp = f"{out}_key"
    d = df.withColumn(tmp, key)
    splits = [float("-inf")] + bounds + [float("inf")]
    d = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(d).drop(tmp)
    if descending:
        d = d.withColumn(out, F.lit(len(splits)) - F.col(out))
    null_bucket = len(splits) + 1 if descending else -1
    return d.withColumn(out, F.coalesce(F.when(F.col(col).isNotNull(), F.col(out).cast("int")), F.lit(null_bucket)))


def global_rank(df: DataFrame, order_cols: Sequence[Column | str], bucket: Column, name: str = "rank") -> DataFrame:
    """Exact global row number (no single-task window)."""
    return bucketed_rank(df, [], order_cols, bucket, name)
