"""The exact search by different vectors, cells and blocks: copies, groups, repeated ids and what is shuffled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedspread.operators import knn
from seedspread.operators.knn import knn_join

SCHEMA = "id long, x array<double>"


def test_equal_vectors_are_searched_once(spark):
    x = np.random.default_rng(2).integers(0, 4, (1500, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    stats = {}
    got = {(r.src, r["rank"]): r.dst for r in knn_join(df, df, 3, exclude_self=True, stats=stats).collect()}
    for i in range(0, 1500, 50):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(1500), d2)) if j != i][:3]
        assert [got[i, k + 1] for k in range(3)] == near
    assert stats == {"visits": 16, "pairs": 256}


def test_groups_of_the_same_vectors_are_one_search(spark):
    x = np.random.default_rng(4).normal(size=(120, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).withColumn("g", F.explode(F.array(*[F.lit(n).cast("long") for n in range(5)])))
    df = df.where((F.col("id") + F.col("g")) % 3 > 0)
    stats = {}
    got = {(r.g, r.src, r["rank"]): r.dst for r in knn_join(df, df, 2, exclude_self=True, group_col="g", stats=stats).collect()}
    assert stats["visits"] == 120 and stats["pairs"] == 120 * 120
    for g in range(5):
        ids = [i for i in range(120) if (i + g) % 3 > 0]
        for i in ids[::7]:
            near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in ids if j != i)[:2]
            assert [got[g, i, 1], got[g, i, 2]] == [j for _, j in near]


def test_without_structure_a_vector_meets_each_block_once(spark):
    """Cells don't help in many dimensions: the visits are bounded by the blocks, not the cells."""
    x = np.random.default_rng(6).normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    for method in ("exact", "pruned"):
        stats = {}
        got = {(r.src, r["rank"]): r.dst for r in knn_join(df, df, 3, exclude_self=True, method=method, block_rows=300, stats=stats).collect()}
        assert len(got) == 2700 and stats["visits"] <= 900 * 3
        for i in range(0, 900, 30):
            d2 = ((x - x[i]) ** 2).sum(axis=1)
            d2[i] = np.inf
            assert [got[i, k + 1] for k in range(3)] == np.argsort(d2)[:3].tolist()


@pytest.mark.parametrize("width", [2, 20])
def test_a_block_keeps_what_counts_whatever_id_is_left_out(width):
    """Against brute force: shared ids, copies, groups, far origins, single and double precision."""
    draw = np.random.default_rng(width)
    for trial in range(30):
        n, m, shared = int(draw.integers(1, 200)), int(draw.integers(1, 20)), trial % 2
        x = np.unique(draw.integers(0, 4, (n, width)).astype(float), axis=0) + [0, 1000][trial % 3 == 0]
        q = np.concatenate([x[draw.integers(0, len(x), m)], draw.normal(size=(3, width))])
        n = len(x)
        lists = lambda k: [sorted(draw.choice(4, int(draw.integers(1, 4)), replace=False).tolist()) for _ in range(k)]
        rg, qg, kind = lists(n), lists(len(q)), draw.integers(0, 2, n).tolist()
        ids = draw.integers(0, n // 2 + 1, n).tolist() if shared else draw.permutation(1000)[:n].tolist()
        copies = draw.integers(1, 3, n).tolist() if shared else [1] * n
        every = lambda values, kind_: pa.array([[v] * len(g) for v, g in zip(values, rg, strict=True)], pa.list_(kind_))
        r = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "rg": pa.array(rg, pa.list_(pa.int64())), "rkind": every(kind, pa.int32()), "rid": every(ids, pa.int64()), "rn": every(copies, pa.int64())})
        asked = pa.table({"v": pa.array([bytes([i]) for i in range(len(q))], pa.binary()), "x": pa.array(q.tolist(), pa.list_(pa.float64())), "groups": pa.array(qg, pa.list_(pa.int64()))})
        search = knn._Search({0: 2, 1: 3}, True)
        got = {}
        for o in knn._found(asked, r, search).to_pylist():
            got.setdefault((o["v"][0], o["g"], o["kind"]), []).append((round(o["d2"], 6), o["dst"]))
        for i, groups in enumerate(qg):
            for g in groups:
                for kd, k in search.k_by_kind.items():
                    rows = sorted((round(float(((q[i] - x[j]) ** 2).sum()), 6), ids[j]) for j in range(n) for _ in range(copies[j]) if kind[j] == kd and g in rg[j])
                    for self_ in {-1, *[d for _, d in rows[:4]]}:
                        left = lambda some: [row for row in some if row[1] != self_][:k]
                        assert left(sorted(got.get((i, g, kd), []))) == left(rows)


def test_a_scarce_kind_does_not_open_the_cells_of_the_others(spark):
    """Few labelled rows lie far from most queries: their wide radii and missing neighbours are no reason to meet all other rows."""
    x = np.random.default_rng(8).normal(size=(900, 2))
    scarce = np.arange(900) % 150 == 0
    df = spark.createDataFrame([(i, v.tolist(), int(s)) for i, (v, s) in enumerate(zip(x, scarce))], SCHEMA + ", kind int")
    stats = {}
    found = knn_join(df, df, {0: 3, 1: 2}, exclude_self=True, kind_col="kind", block_rows=300, stats=stats).collect()
    got = {(r.src, r.kind, r["rank"]): r.dst for r in found}
    assert len(got) == len(found) == 900 * 5 and stats["pairs"] < 900 * 900 / 3
    for i in range(0, 900, 25):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        d2[i] = np.inf
        for kind, k in ((0, 3), (1, 2)):
            assert [got[i, kind, n + 1] for n in range(k)] == np.argsort(np.where(scarce == (kind == 1), d2, np.inf))[:k].tolist()
    # all kinds are scarce: one block each
    both = knn_join(df, df.withColumn("kind", F.col("id").cast("int") % 2), {0: 2, 1: 2}, exclude_self=True, kind_col="kind", block_rows=500).collect()
    assert len(both) == 900 * 4
    for r in both:
        assert r.dst % 2 == r.kind
