"""Session helpers: a tuned local session for tests/bench and the checkpoint folder rule.

On a cluster the session comes from the caller; nothing here overrides what the
cluster already set.  The only thing the library needs from the session is a
reliable checkpoint folder (``spark.checkpoint.dir``) to cut lineage in loops.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "seedspread") -> SparkSession:
    """Session for tests and the bench (``local[N]``, UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEEDSPREAD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is configured.

    Order: the context's current folder, then ``spark.checkpoint.dir`` from the
    session conf.  If both are unset and the master is local (tests, bench), a
    fresh scratch folder is made.  On a cluster without a configured folder we
    refuse: a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="seedspread-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of writes in this block go when the table is there.

    They stay otherwise until the driver's garbage collector finds them unused, so that a loop
    of small jobs keeps the shuffles of all its steps on disk.  Later steps read the table.
    """
    with _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def buckets_kept(spark: SparkSession) -> Iterator[None]:
    """Scans in this block keep their tables' buckets below a union too.

    Spark looks for uses of the buckets through single-child operators only, and splits the files otherwise.
    """
    with _held(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        yield


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a block; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Cuts lineage like ``cut_lineage``, but later reads prune columns and push filters
    down, and the shuffles of the job don't stay.  ``discard`` removes the files once nothing reads them any more.
    """
    path = scratch_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._materialized_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files behind a table that ``materialize`` returned."""
    path = getattr(df, "_materialized_path", None)
    if path:
        remove_path(df.sparkSession, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder under the shared checkpoint folder for written tables (state, replays).

    Made through Hadoop's file system, whatever its scheme; nothing is local but what the
    checkpoint folder makes so.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target, fs = hadoop_path(spark, path)
    fs.mkdirs(target)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them (for existence checks and removal)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder (nothing if it isn't there)."""
    target, fs = hadoop_path(spark, path)
    fs.delete(target, True)
