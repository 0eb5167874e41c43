"""Splitting, label masking, arrival order and small store operators.

Every random choice is a hash order ``md5('<seed>:<salt><id>'), id`` (see
``functions.hashing``).  Samples are ``drawn``: counts by class and leading hash bits say
which rows are in, and only the rows of one bucket per class are sorted.  Where every row
needs a position (arrival order, replay) it is a ``bucketed_rank``, so that a class holding
a third of the rows is still cut into many tasks.

Rows without a class (null: label not known) are always returned and never drawn:
they are not observed, not in the burn-in and not test rows of a stratified split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.functions.hashing import hash_bucket, order_key
from seedspread.operators.ranking import bucketed_rank, drawn, hash_rank, with_quantile_bucket

# salts of the independent hash orders (fixed values: changing them changes every sample)
SALT_PICK = ""
SALT_OBSERVED = "obs:"
SALT_ORDER = "order:"


def _ranked(df: DataFrame, parts: Sequence[str], id_col: str, seed: int, salt: str, shuffle: bool,
            seq_col: str | None, name: str, size_col: str | None = None) -> DataFrame:
    """Rank within ``parts`` by a hash order (shuffle) or by ``seq_col`` (no shuffle)."""
    if shuffle:
        key = f"_{name}_key"
        return hash_rank(df.withColumn(key, order_key(id_col, seed, salt)), parts, key, id_col, name, size_col).drop(key)
    seq = seq_col or id_col
    b = f"_{name}_qb"
    d = with_quantile_bucket(df, seq, b)
    return bucketed_rank(d, parts, [F.col(seq), F.col(id_col)], F.col(b), name, size_col).drop(b)


def _drawn(df: DataFrame, parts: Sequence[str], id_col: str, seed: int, shuffle: bool, seq_col: str | None,
           quota: Callable[[Column], Column], name: str) -> DataFrame:
    """Mark the first ``quota(n)`` rows of each of ``parts`` in the order of ``_ranked`` (salt ``SALT_PICK``)."""
    if shuffle:
        key = f"_{name}_key"
        d = df.withColumn(key, order_key(id_col, seed, SALT_PICK))
        return drawn(d, parts, [key, id_col], hash_bucket(key), quota, name).drop(key)
    seq = seq_col or id_col
    b = f"_{name}_qb"
    d = with_quantile_bucket(df, seq, b)
    return drawn(d, parts, list(dict.fromkeys([seq, id_col])), F.col(b), quota, name).drop(b)


# ---------------------------------------------------------------- D1
def class_sizes(df: DataFrame, label_col: str = "label", min_size: int | None = None) -> DataFrame:
    """Rows per class; raises if the smallest class has fewer than ``min_size`` rows."""
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    if min_size is not None:
        smallest = sizes.agg(F.min("n").alias("m")).first()["m"]
        if smallest is not None and smallest < min_size:
            raise ValueError(f"smallest class has {smallest} rows < {min_size}")
    return sizes


# ---------------------------------------------------------------- D2
def burn_in_split(
    df: DataFrame,
    id_col: str,
    label_col: str,
    n_labeled_per_class: int,
    ratio_labeled: float,
    seed: int,
    shuffle: bool = True,
    seq_col: str | None = None,
) -> DataFrame:
    """Mark a burn-in set: per class ``n_l + min(int(n_l (1/ratio - 1)), n - n_l)`` rows, ``n_l`` of them observed.

    Adds ``burn_in`` (bool), ``observed`` (bool, false outside the burn-in) and
    ``burn_rank`` (position inside its class, null outside).
    """
    n_l = int(n_labeled_per_class)
    class_sizes(df.where(F.col(label_col).isNotNull()), label_col, min_size=n_l)  # D1 check (one scalar to the driver)
    wanted = F.floor(F.lit(float(n_l)) * (F.lit(1.0) / F.lit(float(ratio_labeled)) - F.lit(1.0)))
    quota = lambda n: F.lit(n_l) + F.least(wanted, n - F.lit(n_l))
    d = _drawn(df, [label_col], id_col, seed, shuffle, seq_col, quota, "burn_in")
    d = d.withColumn("burn_in", F.col("burn_in") & F.col(label_col).isNotNull())
    # positions only for the burn-in rows, a bounded number per class
    by = [order_key(id_col, seed, SALT_PICK) if shuffle else F.col(seq_col or id_col), F.col(id_col)]
    burn = d.where("burn_in").withColumn("burn_rank", F.row_number().over(Window.partitionBy(label_col).orderBy(*by)).cast("long"))
    if shuffle:
        # the observed ones are a second, independent draw inside the burn-in rows
        by = [order_key(id_col, seed, SALT_OBSERVED), F.col(id_col)]
    observed = F.row_number().over(Window.partitionBy(label_col).orderBy(*by)) <= n_l
    rest = d.where("not burn_in").withColumn("observed", F.lit(False)).withColumn("burn_rank", F.lit(None).cast("long"))
    return rest.unionByName(burn.withColumn("observed", observed))


# ---------------------------------------------------------------- D3
def mask_labels(
    df: DataFrame,
    id_col: str,
    label_col: str,
    ratio: float,
    seed: int,
    shuffle: bool = True,
    seq_col: str | None = None,
) -> DataFrame:
    """Per class ``int(n_class * ratio)`` rows observed; adds ``observed``."""
    d = _drawn(df, [label_col], id_col, seed, shuffle, seq_col, lambda n: F.floor(n * F.lit(float(ratio))), "observed")
    return d.withColumn("observed", F.col("observed") & F.col(label_col).isNotNull())


# ---------------------------------------------------------------- D4
def uniform_mask(df: DataFrame, id_col: str, ratio: float, seed: int) -> DataFrame:
    """``int(ratio * N)`` rows observed regardless of class; adds ``observed``."""
    return _drawn(df, [], id_col, seed, True, None, lambda n: F.floor(n * F.lit(float(ratio))), "observed")


# ---------------------------------------------------------------- D5
def arrival_order(df: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    """0-based ``seq``: burn-in rows first (class by class, in burn-in order), then the rest shuffled.

    Needs the ``burn_in`` / ``burn_rank`` columns of ``burn_in_split``.
    """
    key = "_ord_key"
    d = df.withColumn(key, F.when(~F.col("burn_in"), order_key(id_col, seed, SALT_ORDER)))
    # burn-in rows are bounded by the split parameters: one piece; the rest is cut by hash bits
    bucket = F.when(F.col("burn_in"), F.lit(-1)).otherwise(hash_bucket(key))
    order = [F.when(F.col("burn_in"), F.col(label_col)), F.col("burn_rank"), F.col(key), F.col(id_col)]
    d = bucketed_rank(d, [], order, bucket, "_seq")
    return d.withColumn("seq", F.col("_seq") - 1).drop("_seq", key)


# ---------------------------------------------------------------- D6
def hide_labels(df: DataFrame, label_col: str = "label", observed_col: str = "observed") -> DataFrame:
    """What the learner sees: the label where observed, NULL elsewhere (``label_seen``)."""
    return df.withColumn("label_seen", F.when(F.col(observed_col), F.col(label_col)))


# ---------------------------------------------------------------- D7
def replay(df: DataFrame, id_col: str, seq_col: str | None = None, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Position of each row in a replay: by ``seq_col`` (or id), or hash-shuffled; adds 0-based ``pos``."""
    d = _ranked(df, [], id_col, seed, SALT_ORDER, shuffle, seq_col, "_pos")
    return d.withColumn("pos", F.col("_pos") - 1).drop("_pos")


# ---------------------------------------------------------------- D8
def label_budget_ratio(n_labels_per_class: int, n_classes: int, n_burn_in_labeled: int, n_rest: int) -> float:
    """Ratio of observed labels in the rest so that the run sees ``per_class * C`` labels in all."""
    total = n_labels_per_class * n_classes
    ratio = (total - n_burn_in_labeled) / n_rest
    if ratio < 0:
        raise ValueError("burn-in already holds more labels than the budget")
    return ratio


def label_budget(split: DataFrame, id_col: str, label_col: str, n_labels_per_class: int, seed: int) -> DataFrame:
    """D8 on a ``burn_in_split`` result: mask the rest so that the whole run holds the label budget."""
    counts = split.agg(
        F.countDistinct(label_col).alias("c"),
        F.count_if(F.col("observed")).alias("b"),
        F.count_if(~F.col("burn_in")).alias("r"),
    ).first()
    ratio = label_budget_ratio(n_labels_per_class, counts["c"], counts["b"], counts["r"])
    rest = split.where(~F.col("burn_in")).drop("observed")
    return mask_labels(rest, id_col, label_col, ratio, seed)


# ---------------------------------------------------------------- D9 / D10
def one_hot(df: DataFrame, id_col: str, label_col: str, classes: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Long-form one-hot ``(id, class, p)``; a label outside the class list gets all zeros.

    ``keep`` carries extra key columns (e.g. a sweep group) through.
    """
    cls = F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class")
    return df.select(*keep, F.col(id_col).alias("id"), F.col(label_col).alias("_y"), cls).select(
        *keep, "id", "class", (F.col("class") == F.col("_y")).cast("double").alias("p")
    ).na.fill({"p": 0.0})


def decode(f: DataFrame, id_col: str = "id", class_col: str = "class", p_col: str = "p") -> DataFrame:
    """Arg-max class per row of a long-form distribution; the lowest class wins ties."""
    return f.groupBy(id_col).agg(
        F.min_by(F.col(class_col), F.struct(-F.col(p_col), F.col(class_col))).alias("pred")
    )


# ---------------------------------------------------------------- D11 - D13
def first_of_each(new: DataFrame, id_col: str = "id", seq_col: str | None = None) -> DataFrame:
    """One row per id: the first by ``seq_col`` (any order column; equal ones by all columns)."""
    order = [F.col(seq_col).asc_nulls_last()] if seq_col else []
    order += [F.to_json(F.struct(*new.columns))]
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return new.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def ingest(points: DataFrame, new: DataFrame, id_col: str = "id", seq_col: str | None = None) -> DataFrame:
    """Append rows whose id is not stored yet, each new id once (idempotent on replays and duplicates)."""
    return points.unionByName(first_of_each(new.join(points.select(id_col), id_col, "left_anti"), id_col, seq_col))


def store_counts(points: DataFrame, observed_col: str = "observed") -> DataFrame:
    return points.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col(observed_col)).alias("n_labeled"),
        F.count_if(~F.col(observed_col)).alias("n_unlabeled"),
    )


def labeled_part(points: DataFrame, observed_col: str = "observed") -> DataFrame:
    return points.where(F.col(observed_col))


def unlabeled_part(points: DataFrame, observed_col: str = "observed") -> DataFrame:
    return points.where(~F.col(observed_col))


# ---------------------------------------------------------------- S5 / S6
def tail_split(df: DataFrame, id_col: str, seq_col: str, n_test: int) -> DataFrame:
    """Integer test size: the last ``n_test`` rows by ``seq_col`` are test rows (``is_test``)."""
    b = "_tail_qb"
    d = with_quantile_bucket(df, seq_col, b, descending=True)
    return drawn(d, [], list(dict.fromkeys([seq_col, id_col])), F.col(b), lambda n: F.lit(int(n_test)), "is_test", descending=True).drop(b)


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_ratio: float, seed: int) -> DataFrame:
    """Float test size: per class ``int(n_class * ratio)`` hash-picked rows are test rows (``is_test``)."""
    return mask_labels(df, id_col, label_col, test_ratio, seed).withColumnRenamed("observed", "is_test")
