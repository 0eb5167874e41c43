"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``functions`` random projections of a vector into
cells of width ``width`` times the root mean square length of all vectors; the cells
make a bucket.  A query visits its own bucket and, in the order of estimated success,
the buckets whose cells differ by one up or down in some projections: the estimate is
the sum of squared distances of the query to the borders it would cross, smallest first,
``probes`` buckets in all.

Table rows and probes of a bucket meet sorted in one partition, where the distance of
each pair is computed in double precision from the vectors as they are, and each probe
keeps its ``k`` nearest.  The tables' finds are merged by query: a row counts once, the
nearest ``k`` stay.  Neither candidates nor pairs are ever written.

Hot buckets: of equal vectors only the ``k + 1`` smallest ids can be among the ``k``
nearest of anything, so only these, each once, are indexed (limited before the shuffle); buckets
with more than ``BLOCK`` rows or probes are dealt to several tasks as blocks of rows
times blocks of probes, without loss.  Queries for which the tables find fewer than
``k`` rows are compared with all rows in the same way, as one bucket in blocks.

Defined cases: null and all-zero vectors, and those with a null, infinite or NaN
component, take no part; vectors of different length are never compared; a row with
the query's own id is no candidate; several candidate rows of one id count as the
nearest of them; several query rows of one id with different vectors are each answered;
equal distances go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedspread.llm.common import col, written

#: Rows, and probes, of a bucket in one task; more are dealt to several.
BLOCK = 8192
#: Pair components that are held at once.
COMPONENTS = 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Hashes:
    """The projections for one vector length, made from the seed alone."""

    def __init__(self, length: int, tables: int, functions: int, width: float, seed: int):
        draw = np.random.default_rng([seed, length])
        self.a = draw.normal(size=(length, tables * functions)) / width
        self.b = draw.uniform(size=tables * functions)
        self.mix = draw.integers(1, 1 << 62, size=functions, dtype=np.int64) * 2 + 1
        self.shape = (-1, tables, functions)
        moves = np.array(sorted(product((0, -1, 1), repeat=functions), key=np.count_nonzero), dtype=np.int64)
        self.moves = moves

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.a + self.b).reshape(self.shape)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        return (cells * self.mix).sum(axis=-1)  # 64 bits, wrapping

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each vector visits in each table: the own one and those most likely to hold near vectors."""
        places = self.places(vectors)
        cells = np.floor(places).astype(np.int64)
        down = places - cells
        cost = (down**2) @ (self.moves == -1).T + ((1 - down) ** 2) @ (self.moves == 1).T
        chosen = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        return self.buckets(cells[:, :, None, :] + self.moves[chosen])


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, length)


def _nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, ids, distances)`` of each query's ``k`` nearest rows, ties to the smaller id."""
    step = max(1, COMPONENTS // max(1, rows.size))
    for at in range(0, len(queries), step):
        distance = np.sqrt(((queries[at : at + step, None, :] - rows[None]) ** 2).sum(axis=-1))
        distance[query_ids[at : at + step, None] == ids[None]] = np.inf
        for j, d in enumerate(distance):
            near = np.flatnonzero(d <= (np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf))
            near = near[np.isfinite(d[near])]
            near = near[np.lexsort((ids[near], d[near]))][:k]
            yield at + j, ids[near], d[near]


def _meet(rows: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``(query_id, query, vec_id, score)``: for each probe the nearest rows of its bucket.

    ``rows`` and ``probes`` have ``length, tab, bucket, id, vector`` (vector: the bytes of its doubles).
    """
    at = ["length", "tab", "bucket"]
    many = lambda t, n: t.groupBy(*at).count().where(F.col("count") > BLOCK).select(*at, F.ceil(F.col("count") / BLOCK).cast("int").alias(n))
    hot = written(many(rows, "row_blocks").join(many(probes, "probe_blocks"), at, "full"), "hot-buckets")
    blocks = {n: F.coalesce(n, F.lit(1)) for n in ("row_blocks", "probe_blocks")}

    def dealt(t: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "vector"), blocks[own]).cast("int").alias(own.split("_")[0] + "_block")
        each = F.explode(F.sequence(F.lit(0), blocks[other] - 1)).alias(other.split("_")[0] + "_block")
        return t.join(hot, at, "left").select(*at, mine, each, F.lit(kind).alias("kind"), "id", "vector").select(*at, "row_block", "probe_block", "kind", "id", "vector")

    group = [*at, "row_block", "probe_block"]
    both = dealt(rows, "row_blocks", "probe_blocks", 0).unionByName(dealt(probes, "probe_blocks", "row_blocks", 1))
    both = both.repartition(*group).sortWithinPartitions(*group, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []  # the rows of the bucket at hand
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(6)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
            out: list[tuple] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                *bucket, kind = keys[a].tolist()
                if bucket != now:
                    now, ids, parts = bucket, [], []
                own_ids, own = batch.column(6).slice(a, b - a).to_numpy(), batch.column(7).slice(a, b - a)
                if kind == 0:
                    ids.append(own_ids), parts.append(_vectors(own, bucket[0]))
                elif ids:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                    for q, near, distance in _nearest(ids[0], parts[0], own_ids, _vectors(own, bucket[0]), k):
                        out.append((np.full(len(near), own_ids[q]), [own[q].as_py()] * len(near), near, distance))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array([v for x in out for v in x[1]], pa.binary()), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))], names=["query_id", "query", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, query binary, vec_id long, score double")
    return found.groupBy("query_id", F.xxhash64("query").alias("query"), "vec_id").agg(F.min("score").alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, tables: int = 12, functions: int = 8, width: float = 2.0, probes: int = 50, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row that ``queries`` selects, by Euclidean distance."""
    doubles = col(vector_col).cast("array<double>")
    part = vectors.where(usable(col(vector_col)) & col(id_col).isNotNull())
    part = part.select(col(id_col).cast("long").alias("id"), doubles.alias("vector"), queries.alias("is_query"))
    scale = part.agg(F.sqrt(F.avg(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0
    cell = width * scale

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            raw = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 for x in lists]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in raw], pa.int32()), batch.column(0), pa.array([x.tobytes() for x in raw], pa.binary())], names=["length", "id", "vector"])

    pack = lambda t: t.select("id", "vector").mapInArrow(packed, "length int, id long, vector binary")
    same = Window.partitionBy("vector").orderBy("id")
    distinct = written(pack(part).distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    asked = written(pack(part.where("is_query")).dropDuplicates(["id", "vector"]), "queries")

    def hashed(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Hashes] = {}
            for batch in batches:
                lengths = batch.column(0).to_numpy()
                for length in np.unique(lengths).tolist():
                    made.setdefault(length, Hashes(length, tables, functions, cell, seed))
                    same = np.flatnonzero(lengths == length)
                    step = 32 if probe else 1024  # the cost of every move is held for so many vectors
                    for at in range(0, len(same), step):
                        rows = batch.take(pa.array(same[at : at + step]))
                        x, own = _vectors(rows.column(2), length), made[length]
                        buckets = own.probed(x, probes) if probe else own.buckets(np.floor(own.places(x)).astype(np.int64))[:, :, None]
                        n, t, p = buckets.shape
                        again = rows.take(pa.array(np.repeat(np.arange(n), t * p)))
                        tab = np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)
                        yield pa.RecordBatch.from_arrays([again.column(0), pa.array(tab), pa.array(buckets.reshape(-1)), again.column(1), again.column(2)], names=["length", "tab", "bucket", "id", "vector"])

        return run

    layout = "length int, tab int, bucket long, id long, vector binary"
    found = written(_best(_meet(distinct.mapInArrow(hashed(False), layout), asked.mapInArrow(hashed(True), layout), k), k), "found")
    enough = found.groupBy("query_id", "query").count().where(F.col("count") >= k)
    short = asked.withColumn("query", F.xxhash64("vector")).join(enough.withColumnRenamed("query_id", "id"), ["id", "query"], "left_anti").drop("query")
    one = [F.col("length"), F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket"), F.col("id"), F.col("vector")]
    short = written(short.select(*one), "short-queries")
    if short.isEmpty():
        final = found
    else:
        rest = short.select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("query"))
        final = found.join(rest, ["query_id", "query"], "left_anti").unionByName(_best(_meet(distinct.select(*one), short, k), k))
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
