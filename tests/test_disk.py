"""What stays on disk after a step: neither its shuffles nor tables that nothing reads any more."""

import os
import time

import numpy as np

from seedspread.operators.knn import knn_join
from seedspread.session import checkpoint_dir, materialize, shuffles_dropped

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.rsplit("/", 1)[-1] for f in blocks.mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle(spark):
    before = _shuffle_files(spark)
    out = materialize(spark.range(0, 5000, 1, 4).selectExpr("id % 97 as k", "id").groupBy("k").sum("id"), "disk-test")
    assert out.count() == 97
    # the count's own shuffle may be there; the table's had 4 maps of 97 keys, removed without waiting
    until = time.time() + 20
    while (left := {f for f in _shuffle_files(spark) - before if f.endswith(".data")}) and len(left) > 2 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2, sorted(left)


def test_the_setting_is_as_before_after_a_write(spark):
    was = spark.conf.get(KEY, None)
    try:
        with shuffles_dropped(spark):
            assert spark.conf.get(KEY) == "true"
            raise RuntimeError
    except RuntimeError:
        pass
    assert spark.conf.get(KEY, None) == was


def test_the_rows_of_a_large_search_go_and_the_neighbours_are_right(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    x[100:] = x[:50]  # copies
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    folder = checkpoint_dir(spark).removeprefix("file:")
    there = lambda: {n for n in os.listdir(folder) if n.startswith("rows-")}
    before = there()
    found = knn_join(pts, pts, 3, exclude_self=True, block_rows=32)
    got = {(r["src"], r["rank"]): r["dst"] for r in found.collect()}
    assert there() == before
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        best = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:3]
        assert [got[i, n + 1] for n in range(3)] == best
