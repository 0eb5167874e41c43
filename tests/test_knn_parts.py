"""The block kernel with many groups: what the first rows give bounds the rows after, so a task holds few candidates."""

import tracemalloc

import numpy as np
import pyarrow as pa

from seedspread.operators import knn

GROUPS, N, ASKED, K = 12, 32000, 512, 3


def tables():
    """Vectors without structure in many groups; one of 40 rows of a group is of kind 1."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 16))
    kind = (rng.random((N, GROUPS)) < 1 / 40).astype(int)
    there = rng.random((N, GROUPS)) < 0.6
    members = [np.flatnonzero(t) for t in there]
    r = pa.table({
        "x": pa.array(list(x), pa.list_(pa.float64())),
        "rg": pa.array([m.tolist() for m in members], pa.list_(pa.int64())),
        "rkind": pa.array([kind[i, m].tolist() for i, m in enumerate(members)], pa.list_(pa.int32())),
        "rid": pa.array([[i] * len(m) for i, m in enumerate(members)], pa.list_(pa.int64())),
        "rn": pa.array([[1] * len(m) for m in members], pa.list_(pa.int64())),
    })
    q = pa.table({
        "v": pa.array([b"%d" % i for i in range(ASKED)], pa.binary()),
        "x": pa.array(list(x[:ASKED]), pa.list_(pa.float64())),
        "groups": pa.array([list(range(GROUPS))] * ASKED, pa.list_(pa.int64())),
    })
    return x, kind, there, q, r


def test_a_block_gives_the_nearest_of_each_group_and_kind_in_little_memory():
    x, kind, there, q, r = tables()
    search = knn._Search({0: K, 1: K}, False)
    tracemalloc.start()
    found = knn._found(q, r, search).to_pandas()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 250, f"{peak:.0f} MB"
    got = {(int(v), g, kd): part.sort_values(["d2", "dst"])["dst"].tolist() for (v, g, kd), part in found.groupby(["v", "g", "kind"])}
    for i in range(0, ASKED, 17):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        for g in range(GROUPS):
            for kd in (0, 1):
                rows = np.flatnonzero(there[:, g] & (kind[:, g] == kd))
                assert got[i, g, kd] == rows[np.lexsort((rows, d2[rows]))][:K].tolist()
