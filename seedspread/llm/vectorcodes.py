"""Vectors as short codes: a codebook for each part of a vector, refined with Drake-Hamerly bounds.

Components become integers (``floor(scale * x)``) and vectors are cut into ``parts`` equal
parts; each part position has a codebook of up to ``entries`` entries, which start as that
part of the smallest ids.  A round assigns each part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces entries by the floor of their
members' mean.

Each vector's state is written between the rounds: per part its entry with an upper bound
of the distance, the ``b`` closest other entries in order of their lower bounds, and one
outer lower bound for all that aren't listed.  When entries move, bounds move by as much,
and a part whose upper bound is below them all keeps its entry without a distance being
computed.  Bounds are doubles with a margin; they only ever say that a case is certain.
Each uncertain part is decided in integers: the listed entries whose bounds the distance
reaches, in their order, or all entries where it reaches the outer bound.  ``b`` adapts: it
is the depth that ``1 - MISSES`` of the uncertain parts of the round needed.

A task holds one Arrow batch of rows; sums of a round are added up per task and then by
Spark, so the driver receives one row per codebook entry and count of depths, whatever
the number of vectors.  The sums of errors by label are joined back by broadcast if they are
few, else by a join against a written table, which AQE may split.

Defined cases: rows whose vector is null, empty or holds a null or non-finite component are
dropped; a zero vector is a vector; ids may repeat, rows are coded one by one, and the
entries start from the smallest by id (null last), then components; fewer rows than
entries give that many entries; no rows give none.  Vectors of different length, of a
length that ``parts`` doesn't divide, or with components whose integers exceed 2^28 are an
error, as sums of squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.llm.common import broadcast_if_small, col, forget, slices, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Listed entries: at first, at least, at most; the share of uncertain parts that may need all entries.
FIRST_B, LEAST_B, MOST_B, MISSES = 8, 2, 16, 0.02
LARGEST = 1 << 28
#: Rows that a task computes with at once.
ROWS = 2048
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
_STATE = "row struct<id:{id},label:{label}>, ints binary, code binary, upper binary, near binary, lower binary, outer binary, depth array<int>"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(id, label, ints)`` of the usable rows."""
    named = vectors.select(col(id_col).alias("id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("_v"))
    return named.where(usable(F.col("_v"))).select("id", "label", F.transform("_v", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints"))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each entry."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        diff = x[:, j, None] - book[None, :, j]
        out += diff * diff
    return out


class PartState:
    """Bounds of one part position for a batch: entry, upper bound, listed entries, their lower bounds, outer bound."""

    def __init__(self, code, upper, near, lower, outer):
        self.code, self.upper, self.near, self.lower, self.outer = code, upper, near, lower, outer

    @classmethod
    def full(cls, x: np.ndarray, book: np.ndarray, b: int) -> PartState:
        """All distances, ``b`` entries listed."""
        d2 = _distances(x, book)
        order = np.argsort(d2, axis=1, kind="stable")
        dist = np.sqrt(np.take_along_axis(d2, order[:, : b + 2], axis=1).astype(np.float64))
        near, lower = np.zeros((len(x), b), np.uint8), np.full((len(x), b), np.inf)
        have = min(b, len(book) - 1)
        near[:, :have], lower[:, :have] = order[:, 1 : have + 1], dist[:, 1 : have + 1] * _DOWN
        outer = dist[:, b + 1] * _DOWN if len(book) > b + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.uint8), dist[:, 0] * _UP, near, lower, outer)

    def move(self, moved: np.ndarray) -> None:
        """Widens the bounds by how far the entries moved, and puts the listed entries in order again."""
        self.upper = self.upper + moved[self.code] * _UP
        self.lower = self.lower - moved[self.near] * _UP
        self.outer = self.outer - (moved.max() if len(moved) else 0) * _UP
        order = np.argsort(self.lower, axis=1, kind="stable")
        self.lower, self.near = np.take_along_axis(self.lower, order, axis=1), np.take_along_axis(self.near, order, axis=1)

    def shrink(self, b: int) -> None:
        """Keeps ``b`` listed entries; the outer bound takes in the rest.  Lists grow only where all distances are computed."""
        have = self.near.shape[1]
        if have > b:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b].copy(), self.lower[:, :b].copy()
        elif have < b:
            self.near = np.pad(self.near, ((0, 0), (0, b - have)))
            self.lower = np.pad(self.lower, ((0, 0), (0, b - have)), constant_values=np.inf)

    def decide(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each row by the bounds, in integers where they don't say; returns the depth each row needed (0: none)."""
        b = self.near.shape[1]
        depth = np.zeros(len(x), np.int64)
        least = np.minimum(self.lower[:, 0], self.outer) if b else self.outer
        open_ = np.flatnonzero(self.upper >= least)
        if not len(open_):
            return depth
        own = book[self.code[open_]] - x[open_]
        own2 = (own * own).sum(axis=1)
        self.upper[open_] = np.sqrt(own2.astype(np.float64)) * _UP
        still = self.upper[open_] >= least[open_]
        open_, own2 = open_[still], own2[still]
        depth[open_] = (self.lower[open_] <= self.upper[open_, None]).sum(axis=1)
        far = self.upper[open_] >= self.outer[open_]
        everything, some = open_[far], open_[~far]
        if len(everything):
            depth[everything] = b + 1
            anew = PartState.full(x[everything], book, b)
            self.code[everything], self.upper[everything] = anew.code, anew.upper
            self.near[everything], self.lower[everything], self.outer[everything] = anew.near, anew.lower, anew.outer
        if len(some):
            own2, reach = own2[~far], depth[some]
            for k in range(int(reach.max()) if len(reach) else 0):
                at = np.flatnonzero(reach > k)
                rows = some[at]
                entry = self.near[rows, k]
                diff = book[entry] - x[rows]
                d2 = (diff * diff).sum(axis=1)
                self.lower[rows, k] = np.sqrt(d2.astype(np.float64)) * _DOWN
                better = (d2 < own2[at]) | ((d2 == own2[at]) & (entry < self.code[rows]))
                win, lose = rows[better], at[better]
                # the two change places: the former entry is listed with its exact distance
                self.near[win, k], self.lower[win, k] = self.code[win], np.sqrt(own2[lose].astype(np.float64)) * _DOWN
                self.code[win], own2[lose] = entry[better], d2[better]
                self.upper[win] = np.sqrt(d2[better].astype(np.float64)) * _UP
            order = np.argsort(self.lower[some], axis=1, kind="stable")
            self.lower[some], self.near[some] = np.take_along_axis(self.lower[some], order, axis=1), np.take_along_axis(self.near[some], order, axis=1)
        return depth


def _packed(a: np.ndarray) -> pa.Array:
    """Rows of an array as binaries."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    ends = np.arange(len(a) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def _unpacked(a: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(a.to_pylist()), kind).reshape(len(a), *shape).copy()


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, b: int, had: int, schema: str) -> DataFrame:
    """The state of each row against ``books`` (part, entry, component); from scratch where ``moved`` is None.

    ``depth`` counts, for each depth up to ``had + 1``, how many parts of the row needed it.
    """
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            n = batch.num_rows
            if not n:
                continue
            x = _unpacked(batch.column(1), np.int32, parts, wide).astype(np.int64)
            if moved is not None:
                code, upper, outer = _unpacked(batch.column(2), np.uint8, parts), _unpacked(batch.column(3), np.float64, parts), _unpacked(batch.column(6), np.float64, parts)
                near, lower = _unpacked(batch.column(4), np.uint8, parts, had), _unpacked(batch.column(5), np.float64, parts, had)
            done, depths = [], np.zeros((n, had + 2), np.int32)
            for p in range(parts):
                if moved is None:
                    state = PartState.full(x[:, p], books[p], b)
                else:
                    state = PartState(code[:, p].copy(), upper[:, p].copy(), near[:, p].copy(), lower[:, p].copy(), outer[:, p].copy())
                    state.move(moved[p])
                    depths[np.arange(n), state.decide(x[:, p], books[p])] += 1
                    state.shrink(b)
                done.append(state)
            whole = lambda what: _packed(np.stack([getattr(s, what) for s in done], axis=1))  # noqa: B023, E731
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * (had + 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole("code"), whole("upper"), whole("near"), whole("lower"), whole("outer"), pa.ListArray.from_arrays(ends, pa.array(depths.ravel()))], names=["row", "ints", "code", "upper", "near", "lower", "outer", "depth"])

    return rows.mapInArrow(run, schema)


def _sums(state: DataFrame, parts: int, entries: int, wide: int) -> DataFrame:
    """``(part, entry, n, sums)`` over all rows, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, wide), np.int64), np.zeros(parts * entries, np.int64)
        for batch in slices(batches, ROWS):
            if batch.num_rows:
                x = _unpacked(batch.column(0), np.int32, parts, wide).astype(np.int64)
                at = _unpacked(batch.column(1), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries
                np.add.at(total, at.ravel(), x.reshape(-1, wide))
                count += np.bincount(at.ravel(), minlength=parts * entries)
        used = np.flatnonzero(count)
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * wide)
        yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]), pa.ListArray.from_arrays(ends, pa.array(total[used].ravel()))], names=["part", "entry", "n", "sums"])

    partial = state.select("ints", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(wide)]).alias("sums"))


def _means(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries replaced by the floor of their members' mean; unused ones stay.  One row per used entry reaches the driver."""
    new = books.copy()
    for r in sums.collect():
        new[r.part, r.entry] = [s // r.n for s in r.sums]
    return new


def _next_b(state: DataFrame, had: int) -> int:
    """The depth that all but ``MISSES`` of the uncertain parts needed."""
    total = state.agg(*[F.sum(F.col("depth")[k]).alias(f"d{k}") for k in range(1, had + 2)]).first()
    needed = np.array([x or 0 for x in total], np.int64)
    if not needed.sum():
        return LEAST_B
    if needed[-1] > MISSES * needed.sum():
        return min(MOST_B, 2 * had)
    enough = int(np.searchsorted(np.cumsum(needed), (1 - MISSES) * needed.sum())) + 1
    return max(LEAST_B, min(MOST_B, enough))


def _finished(state: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            if batch.num_rows:
                x, code = _unpacked(batch.column(1), np.int32, parts, wide).astype(np.int64), _unpacked(batch.column(2), np.uint8, parts)
                diff = x - books[np.arange(parts)[None, :], code]
                error = (diff * diff).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(error)], names=["row", "code", "error"])

    return state.select("row", "ints", "code").mapInArrow(run, schema)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error, label_error)`` of each usable row, and the codebooks (part, entry, component).

    ``code`` is a binary of one byte a part; the id and label keep the names of their columns.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    kept = integers(vectors, id_col, vector_col, label_col, scale)
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    empty = spark.createDataFrame([], f"`{id_col}` {id_type}, `{label_col}` {label_type}, code binary, error long, label_error long")
    sizes = kept.agg(F.min(F.size("ints")).alias("lo"), F.max(F.size("ints")).alias("hi"), F.max(F.array_max(F.transform("ints", F.abs))).alias("most")).first()
    if sizes.lo is None:
        return empty, np.zeros((parts, 0, 0), np.int64)
    if sizes.lo != sizes.hi or sizes.lo % parts or (sizes.most or 0) > LARGEST:
        raise ValueError(f"vectors have {sizes.lo} to {sizes.hi} components of up to {sizes.most}; one length divisible by {parts} and at most {LARGEST} are needed")
    wide = sizes.lo // parts
    first = [r.ints for r in kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2).copy()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(flat)], names=["row", "ints"])

    row = f"struct<id:{id_type},label:{label_type}>"
    rows = kept.select(F.struct("id", "label").alias("row"), "ints").mapInArrow(pack, f"row {row}, ints binary")
    schema = _STATE.format(id=id_type, label=label_type)
    b = used = FIRST_B
    state = written(_assigned(rows, books, None, b, b, schema), "code-state")
    for k in range(rounds):
        new = _means(books, _sums(state, parts, books.shape[1], wide))
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64))
        next_b = _next_b(state, used) if k else b
        before, state, books = state, written(_assigned(state, new, moved, next_b, b, schema), "code-state"), new
        forget(before)
        b, used = next_b, b
    done = written(_finished(state, books, f"row {row}, code binary, error long"), "codes")
    forget(state)
    totals = written(done.groupBy(F.col("row.label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = done.join(broadcast_if_small(totals), F.col("row.label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("row.id").alias(id_col), F.col("row.label").alias(label_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
