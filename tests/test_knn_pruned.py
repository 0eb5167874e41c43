"""Exact searches where distances repeat, by blocks and by pivot cells, against brute force; growth of the cells visited."""

import numpy as np
import pytest

from seedspread.operators.knn import knn_join

SCHEMA = "id long, x array<double>, kind int"


def brute(rows, k, exclude_self=True):
    out = set()
    for i, x, _ in rows:
        for kind, n in k.items():
            near = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), j) for j, y, c in rows if c == kind and not (exclude_self and i == j))
            out |= {(i, j, kind, place + 1) for place, (_, j) in enumerate(near[:n])}
    return out


def data(name):
    draw = np.random.default_rng(3)
    if name == "equal":
        return np.ones((60, 3))
    if name == "grid":
        return draw.integers(0, 4, (200, 2)).astype(float)
    return (draw.normal(size=(9, 4)) * 20)[draw.integers(0, 9, 200)] + draw.normal(size=(200, 4))


@pytest.mark.parametrize("name", ["equal", "grid", "clusters"])
@pytest.mark.parametrize("method", ["exact", "pruned"])
def test_ties_across_blocks_and_unusable_vectors(spark, name, method):
    rows = [(i, x.tolist(), int(i % 3 == 0)) for i, x in enumerate(data(name))]
    odd = [(9001, None, 0), (9002, [float("nan")] * len(rows[0][1]), 1), (9003, [None] * len(rows[0][1]), 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = knn_join(df, df, {0: 3, 1: 2}, exclude_self=True, kind_col="kind", method=method, block_rows=16).collect()
    assert {(r.src, r.dst, r.kind, r["rank"]) for r in got} == brute(rows, {0: 3, 1: 2}) and len(got) == len(set(got))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    one = spark.createDataFrame([(1, [0.0, 1.0])], "id long, x array<double>")
    for method in ("exact", "pruned", "lsh"):
        assert knn_join(none, none, 3, method=method).count() == 0
        assert knn_join(one, none, 3, method=method).count() == 0
        assert knn_join(none, one, 3, method=method).count() == 0
        assert knn_join(one, one, 3, exclude_self=True, method=method).count() == 0


def test_vectors_shuffled_grow_with_the_rows_on_clusters(spark):
    """Four times the rows in four times the clusters: about four times the visits, far from sixteen."""
    seen = []
    for n in (1500, 6000):
        draw = np.random.default_rng(5)
        centre = draw.normal(size=(n // 50, 8)) * 50
        x = centre[draw.integers(0, len(centre), n)] + draw.normal(size=(n, 8))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        stats = {}
        assert knn_join(df, df, 3, exclude_self=True, method="pruned", stats=stats).count() == 3 * n
        seen.append(stats)
    assert seen[1]["visits"] < 6 * seen[0]["visits"] and seen[1]["visits"] < 4 * 6000
    assert seen[1]["pairs"] < 10 * seen[0]["pairs"] and seen[1]["pairs"] < 6000 * 6000 / 10
