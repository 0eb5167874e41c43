"""k-nearest-neighbour joins (K1-K4, K7, K8) and the linear metric (K2).

``method="exact"`` and ``"pruned"`` find the same rows in one way (``_cell_join``):

* equal vectors are one: a vector keeps, per group and kind, the least ids that can be among
  the ``k`` best, and is searched once for all its query rows and for all groups that it is in
  (sweep variants mostly hold the same vectors under other masks);
* vectors are dealt to pivot cells, and a query vector sees the cells that the triangle
  inequality leaves open: first the nearest ones, which give it a radius, then the rest within it;
* a query vector with more open cells than the table has blocks of ``block_rows`` vectors
  meets all blocks instead.  So no vector is shuffled more than (vectors / ``block_rows``)
  times, whatever the data, and about twice on clustered data.

A task holds one block of each side: ``block_rows`` query vectors and up to ``WIDE_BLOCKS`` times as many
rows.  Some queries at a time meet the rows part by part (``TILE`` scores); the best so far bound the
next part, and only the best of the block leave it; a ``row_number() <= k`` window merges blocks.

``method="lsh"`` is approximate: see ``_lsh_join``.

Rows whose vector is null or holds a null or NaN take no part, on either side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.session import discard, materialize

DEFAULT_BLOCK_ROWS = 32768
# exact differences that are held at once, in components, and scores of a block of queries
DIFFERENCES = 1 << 22
TILE = 1 << 21
# pivots of the cells: at most so many rows reach the driver and each task
MAX_PIVOTS = 1024
# rows whose distances to all pivots are held at once
SLICE = 1024
# a radius is first estimated from every so many rows of a part
STRIDE = 16
# rows of a block that queries meet at once: at first, and at most
FIRST_PART, PART = 1024, 8192
# queries that meet all rows take so many blocks of them at once: fewer candidates leave the tasks
WIDE_BLOCKS = 4
# from so many components on candidates are picked in single precision, if the norms are in its range
SINGLE_WIDTH, SINGLE_RANGE = 16, (1e-20, 1e30)
# a row without an id takes part under this one
NO_ID = -(1 << 63)
# hash tables of the approximate join and sign bits of a bucket: with these over 9 of 10
# nearest neighbours of `embeddings` share a bucket (tests ask 0.9)
LSH_TABLES, LSH_BITS = 12, 2


def usable(x) -> F.Column:
    """Whether a vector takes part."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))


CANDIDATES = T.StructType([
    T.StructField("v", T.BinaryType()), T.StructField("g", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("dst", T.LongType()), T.StructField("d2", T.DoubleType()),
])


@dataclass(frozen=True)
class _Search:
    """What a search looks for: ``k`` per kind, without the rows of the query's own id or with them."""

    k_by_kind: dict[int, int]
    exclude_self: bool

    @property
    def kinds(self) -> list[int]:
        return [kd for kd, kv in self.k_by_kind.items() if kv > 0]

    def ids(self, kind: int) -> int:
        """Different ids that are kept: one more where the query's own may be among them."""
        return self.k_by_kind[kind] + int(self.exclude_self)

    def only(self, kinds: Iterable[int]) -> _Search:
        """The search of some kinds."""
        return _Search({kd: self.k_by_kind[kd] for kd in kinds}, self.exclude_self)

    @property
    def most(self) -> int:
        return max((self.k_by_kind[kd] for kd in self.kinds), default=0)


def _of_kind(search: _Search, value: Callable[[int], int]) -> F.Column:
    """A column with a kind's value."""
    out = F.lit(0)
    for kd in search.kinds:
        out = F.when(F.col("kind") == kd, F.lit(int(value(kd)))).otherwise(out)
    return out


# ---------------------------------------------------------------- one block of queries, one of rows
def _matrix(column) -> np.ndarray:
    """A column of vectors as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = len(column[0]) if len(column) else 0
    if len(values) != len(column) * width:
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), width)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class _Block:
    """Some rows by vector, with the members (group, kind, id, copies) of each; groups are places in ``groups``."""

    def __init__(self, table: pa.Table, search: _Search, groups: np.ndarray):
        x = _matrix(table["x"])
        lengths, group = _lists(table["rg"])
        kinds = sorted(search.k_by_kind)
        self.kind = np.searchsorted(kinds, _lists(table["rkind"])[1].astype(np.int64))
        # the columns by the kinds that they have members of: each meets the bounds of its own kinds only
        offset = _starts(lengths)[:-1]
        has = np.bitwise_or.reduceat(1 << self.kind, offset)
        order = np.argsort(has, kind="stable")
        self.x, self.offset, self.lengths, has = x[order], offset[order], lengths[order], has[order]
        ends = [*(np.flatnonzero(has[1:] != has[:-1]) + 1).tolist(), len(has)]
        self.spans = [(a, b, [c for c, kd in enumerate(search.kinds) if has[a] >> kinds.index(kd) & 1]) for a, b in zip([0, *ends], ends, strict=False)]
        self.id, self.copies = _lists(table["rid"])[1].astype(np.int64), _lists(table["rn"])[1].astype(np.int64)
        self.group = np.searchsorted(groups, group.astype(np.int64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = np.repeat(place, lengths)
        # a kind of a group: the columns that lead to different ids, so that the n-th nearest of them bounds the n-th id's distance,
        # and all its columns
        self.columns: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        code = self.group * len(search.k_by_kind) + self.kind
        order = np.lexsort((of, self.id, code))
        code, ids, cols = code[order], self.id[order], of[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
        ends = np.flatnonzero(np.concatenate([code[1:] != code[:-1], [True]])) + 1 if len(code) else []
        start = 0
        for end in ends:
            here = cols[start:end]
            # a column once, though it has several ids here
            g, kd = divmod(int(code[start]), len(kinds))
            self.columns[g, kinds[kd]] = np.unique(here[new[start:end]]), np.unique(here)
            start = end
        # the rows' norms as a column more: one product gives the norm expansion but for the query's own
        self.centre = self.x.mean(axis=0)
        moved = self.x - self.centre
        rn = np.einsum("ij,ij->i", moved, moved)
        self.most = rn.max()
        self.single = self.x.shape[1] >= SINGLE_WIDTH and SINGLE_RANGE[0] < self.most < SINGLE_RANGE[1]
        self.wide = np.concatenate([moved, rn[:, None]], axis=1).T.astype(np.float32 if self.single else np.float64)


def _repeats(table: pa.Table) -> bool:
    """Whether an id comes with several vectors in a kind of a group."""
    (lengths, group), kind, ids = _lists(table["rg"]), _lists(table["rkind"])[1], _lists(table["rid"])[1]
    order = np.lexsort((ids, kind, group))
    group, kind, ids = group[order], kind[order], ids[order]
    return bool(((group[1:] == group[:-1]) & (kind[1:] == kind[:-1]) & (ids[1:] == ids[:-1])).any())


def _parts(n: int) -> Iterator[tuple[int, int]]:
    """Starts and sizes of the parts of a block, which grow to ``PART``: the first ones give the radii of the rest."""
    a, size = 0, FIRST_PART
    while a < n:
        yield a, min(size, n - a)
        a += size
        size = min(PART, max(FIRST_PART, a))


def _found(q: pa.Table, r: pa.Table, search: _Search) -> pa.Table:
    """Candidates of the query vectors of a block: per group and kind the best ids and all their rows that can count.

    Some queries at a time meet the rows part by part; what the parts before gave is the radius of the next.
    """
    out: list[pa.Table] = []
    if q.num_rows and r.num_rows:
        all_groups = np.unique(_lists(r["rg"])[1].astype(np.int64))
        parts = [_Block(r.slice(a, n), search, all_groups) for a, n in _parts(r.num_rows)]
        repeats = _repeats(r)
        qx = _matrix(q["x"])
        n_groups, groups = _lists(q["groups"])
        g_start, groups = _starts(n_groups), groups.astype(np.int64)
        width = len(search.kinds)
        if "radii" in q.column_names:
            radii = _lists(q["radii"])[1].astype(np.float64).reshape(len(groups), width)
        else:
            radii = np.full((len(groups), width), np.inf)
        v = q["v"].combine_chunks()
        step = max(1, TILE // min(PART, r.num_rows))
        for a in range(0, len(qx), step):
            b = min(a + step, len(qx))
            some = slice(g_start[a], g_start[b])
            tile = _Tile(qx[a:b], n_groups[a:b], groups[some], radii[some].copy(), all_groups, search, repeats)
            for block in parts:
                tile.meet(block)
            row, group, kind, dst, d2 = tile.rows()
            if len(row):
                out.append(pa.table([v.take(pa.array(row + a)), pa.array(group, pa.int64()), pa.array(kind, pa.int32()), pa.array(dst, pa.int64()), pa.array(d2, pa.float64())],
                                    names=["v", "g", "kind", "dst", "d2"]))
    if out:
        return pa.concat_tables(out)
    return pa.table([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["v", "g", "kind", "dst", "d2"])


class _Tile:
    """Some query vectors, their radii by group and kind, and the best rows met so far.

    The norm expansion only picks candidates: all whose approximate distance is within its rounding
    error of a bound on the last distance that counts, so that ties are decided by the exact distances and ids.
    """

    def __init__(self, qx: np.ndarray, n_groups: np.ndarray, groups: np.ndarray, radii: np.ndarray, all_groups: np.ndarray, search: _Search, repeats: bool):
        self.qx, self.radii, self.search, self.repeats, self.kinds = qx, radii, search, repeats, search.kinds
        self.groups, self.all_groups = groups, all_groups
        # an entry is a query's group: its query, and its place among the rows' groups (-1: not there)
        self.of_query = np.repeat(np.arange(len(qx)), n_groups)
        place = np.searchsorted(all_groups, groups)
        self.place = np.where(all_groups[np.minimum(place, len(all_groups) - 1)] == groups, place, -1)
        self.entry = np.full((len(qx), len(all_groups)), -1, np.int64)
        there = self.place >= 0
        self.entry[self.of_query[there], self.place[there]] = np.flatnonzero(there)
        # the places of the kinds that are searched among all kinds' order
        self.kind_at = np.full(len(search.k_by_kind), -1)
        for c, kd in enumerate(self.kinds):
            self.kind_at[sorted(search.k_by_kind).index(kd)] = c
        self.needs = np.array([search.ids(kd) for kd in self.kinds])
        none = np.zeros(0, np.int64)
        self.best = (none, np.zeros(0), none, none)

    def _limits(self, block: _Block, approx: np.ndarray, qn: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and kind a bound on the distances that can count, and the columns that all queries take."""
        limit = np.full((len(self.qx), len(self.kinds)), -np.inf)
        few = np.zeros(len(block.x), bool)
        known = np.isfinite(self.radii)
        np.maximum.at(limit, self.of_query, np.where(known, self.radii, -np.inf))
        for c, kd in enumerate(self.kinds):
            need = self.needs[c]
            open_ = np.flatnonzero(~known[:, c] & (self.place >= 0))
            for g in np.unique(self.place[open_]):
                if (int(g), kd) not in block.columns:
                    continue
                cols, every = block.columns[int(g), kd]
                if len(cols) <= need:
                    few[every] = True
                    continue
                at = self.of_query[open_[self.place[open_] == g]]
                sample = cols if len(cols) < 4 * STRIDE * need else cols[::STRIDE]
                near = approx[np.ix_(at, sample)]
                np.maximum.at(limit[:, c], at, np.partition(near, need - 1, axis=1)[:, need - 1] + qn[at] + margin[at])
        return limit, few

    def meet(self, block: _Block) -> None:
        """Takes the rows of a part of a block that can be among the best."""
        qx = self.qx
        moved = qx - block.centre
        qn = np.einsum("ij,ij->i", moved, moved)
        wide = block.wide if not block.single or np.abs(qx).max() < SINGLE_RANGE[1] ** 0.25 else block.wide.astype(np.float64)
        # without the query's norm, which moves no bound against another
        approx = np.concatenate([-2.0 * moved, np.ones((len(qx), 1))], axis=1).astype(wide.dtype, copy=False) @ wide
        # moving to the block's centre rounds too, by the components' size before
        size = np.einsum("ij,ij->i", qx, qx) + block.centre @ block.centre
        margin = 16 * np.finfo(np.float64).eps * (qx.shape[1] + 4) * (qn + block.most + size) + 8 * np.finfo(block.wide.dtype).eps * (qx.shape[1] + 4) * (qn + block.most)
        limit, few = self._limits(block, approx, qn, margin)
        most = _upward(limit + (margin - qn)[:, None], wide.dtype)
        mask = np.empty(approx.shape, bool)
        for a, b, kinds in block.spans:
            np.less_equal(approx[:, a:b], most[:, kinds].max(axis=1)[:, None], out=mask[:, a:b])
        mask[:, few] = True
        row, col = np.divmod(np.flatnonzero(mask), mask.shape[1])
        if not len(row):
            return
        d2 = np.empty(len(row))
        step = max(1, DIFFERENCES // max(1, qx.shape[1]))
        for a in range(0, len(row), step):
            diff = qx[row[a : a + step]] - block.x[col[a : a + step]]
            d2[a : a + step] = np.einsum("ij,ij->i", diff, diff)
        # pairs become rows of the members that share a group with the query
        times = block.lengths[col]
        pair = np.repeat(np.arange(len(row)), times)
        member = np.arange(len(pair)) - np.repeat(_starts(times)[:-1], times) + np.repeat(block.offset[col], times)
        at, kind = self.entry[row[pair], block.group[member]], self.kind_at[block.kind[member]]
        keep = (at >= 0) & (kind >= 0)
        pair, member, at, kind = pair[keep], member[keep], at[keep], kind[keep]
        keep = np.isfinite(d2[pair]) & (d2[pair] <= self.radii[at, kind])
        pair, member = pair[keep], member[keep]
        self._take(at[keep] * len(self.kinds) + kind[keep], d2[pair], block.id[member], block.copies[member])

    def _take(self, key: np.ndarray, d2: np.ndarray, dst: np.ndarray, n: np.ndarray) -> None:
        """Ranks new rows with those of before, for the entries and kinds (``key``) that have new ones."""
        if not len(key):
            return
        touched = np.zeros(self.radii.size, bool)
        touched[key] = True
        again = touched[self.best[0]]
        key, d2, dst, n = (np.concatenate([old[again], new]) for old, new in zip(self.best, (key, d2, dst, n), strict=True))
        order = np.lexsort((dst, d2, key))
        key, d2, dst, n = key[order], d2[order], dst[order], n[order]
        needs = self.needs[key % len(self.kinds)]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        length = np.diff(np.append(np.flatnonzero(begin), len(key)))
        if self.repeats:
            # the rank of an id is that of its nearest row; of an id, k rows can count
            times = pd.DataFrame({"key": key, "dst": dst}).groupby(["key", "dst"], sort=False).cumcount().to_numpy()
            first = times == 0
            count = np.cumsum(first)
            rank = count - np.repeat(count[begin] - 1, length)
            last = first & (rank == needs)
            rank = pd.Series(np.where(first, rank, np.iinfo(np.int64).max)).groupby([key, dst]).transform("min").to_numpy()
            keep = (rank <= needs) & (times < self.search.most)
        else:
            rank = np.arange(len(key)) - np.repeat(np.flatnonzero(begin), length) + 1
            last, keep = rank == needs, rank <= needs
        radii = self.radii.reshape(-1)
        radii[key[last]] = np.minimum(radii[key[last]], d2[last])
        self.best = tuple(np.concatenate([old[~again], new[keep]]) for old, new in zip(self.best, (key, d2, dst, n), strict=True))

    def rows(self) -> tuple[np.ndarray, ...]:
        """Query, group, kind, id and distance of the best rows, copies repeated."""
        key, d2, dst, n = (np.repeat(z, self.best[3]) for z in self.best) if (self.best[3] > 1).any() else self.best
        at, kind = np.divmod(key, len(self.kinds))
        return self.of_query[at], self.groups[at], np.array(self.kinds)[kind], dst, d2


def _upward(x: np.ndarray, dtype) -> np.ndarray:
    """The next number of the type that isn't smaller."""
    return np.nextafter(x.astype(dtype), dtype.type(np.inf))


# ---------------------------------------------------------------- joins
def knn_join(
    query: DataFrame,
    ref: DataFrame,
    k: int | Mapping[int, int],
    *,
    exclude_self: bool = False,
    kind_col: str | None = None,
    group_col: str | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    method: str = "exact",
    lsh_tables: int = LSH_TABLES,
    lsh_seed: int = 17,
    lsh_bits: int = LSH_BITS,
    pivots: int | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Exact kNN join.  ``query``/``ref`` have ``(id long, x array<double>)``.

    With ``kind_col`` (an int column of ``ref``) the ``k`` best are kept per kind,
    ``k`` being a mapping kind -> k.  ``exclude_self`` drops pairs with equal ids
    (a table joined with itself).  With ``group_col`` (on both sides) rows only meet
    rows of the same group: many independent joins (e.g. sweep variants) in one plan.
    Returns ``(src, dst, kind, d2, rank)`` (plus the group column) with rank 1..k by
    ``(d2, dst)``; fewer rows where fewer candidates exist.

    ``method="pruned"`` finds the same rows; it deals small tables to cells too (``pivots`` of
    them), where ``"exact"`` takes them as one block.  ``stats``, a dict, receives the numbers of visits and pairs.
    ``method="lsh"`` is the approximate option for inputs where the exact pairs are too many: see ``_lsh_join``.
    """
    if method not in ("exact", "pruned", "lsh"):
        raise ValueError("method is 'exact', 'pruned' or 'lsh'")
    k_by_kind = {int(a): int(b) for a, b in k.items()} if isinstance(k, Mapping) else {0: int(k)}
    search = _Search(k_by_kind, exclude_self)
    if method == "lsh":
        return _lsh_join(query, ref, search, kind_col=kind_col, block_rows=block_rows, tables=lsh_tables, seed=lsh_seed, bits=lsh_bits)
    groups = F.array(F.col(group_col).cast("long")) if group_col else F.array(F.lit(0).cast("long"))
    if group_col:
        query, ref = query.where(F.col(group_col).isNotNull()), ref.where(F.col(group_col).isNotNull())
    kind = F.col(kind_col).cast("int") if kind_col else F.lit(0)
    found = _cell_join(query.select(groups.alias("gs"), "id", "x"), ref.select(groups.alias("gs"), "id", "x", kind.alias("kind")),
                       search, block_rows, pivots, stats, small_cells=method == "pruned")
    return found.withColumnRenamed("g", group_col) if group_col else found.drop("g")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose vector takes part, with the digest of its components (``v``)."""
    for b in batches:
        x = b.column("x")
        lengths = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # a null component is NaN here
        values = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False), np.float64)
        starts, some = _starts(lengths), lengths > 0
        norm = np.zeros(len(lengths))
        if some.any():
            with np.errstate(over="ignore", invalid="ignore"):
                norm[some] = np.add.reduceat(values * values, starts[:-1][some])
        # where the norm is infinite, so are all distances
        keep = x.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(norm)
        raw = memoryview(values.tobytes())
        v = [blake2b(raw[8 * s : 8 * (s + n)], digest_size=16).digest() for s, n in zip(starts[:-1][keep].tolist(), lengths[keep].tolist(), strict=True)]
        kept = b.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(v, pa.binary())], names=[*b.schema.names, "v"])


def _packed(query: DataFrame, ref: DataFrame, search: _Search) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides, written once, and their different vectors.

    A vector (``v``: a digest of its components) has the groups that ask for it (``groups``) and its
    members as reference rows: group, kind, id and copies (those that can count) of the least ids.
    """
    def side(df: DataFrame, asked: bool, kind) -> DataFrame:
        df = df.select(F.lit(asked).alias("asked"), "gs", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("x").cast("array<double>").alias("x"), kind.alias("kind"))
        return df.mapInArrow(_digested, T.StructType([*df.schema.fields, T.StructField("v", T.BinaryType())]))

    refs = side(ref, False, F.col("kind")).where(F.col("kind").isin(search.kinds))
    rows = materialize(side(query, True, F.lit(0)).unionByName(refs), "rows")
    members = rows.where(~F.col("asked")).select("v", F.explode("gs").alias("g"), "kind", "id")
    members = members.groupBy("v", "g", "kind", "id").agg(F.least(F.count(F.lit(1)), F.lit(search.most)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("v", "g", "kind").orderBy("id"))
    members = members.withColumn("rank", rank).where(F.col("rank") <= F.lit(search.most + int(search.exclude_self)))
    members = members.groupBy("v").agg(F.collect_list(F.struct("g", "kind", "id", "n")).alias("m"))
    members = members.select("v", F.col("m.g").alias("rg"), F.col("m.kind").alias("rkind"), F.col("m.id").alias("rid"), F.col("m.n").alias("rn"))
    asked = rows.where("asked").select("v", F.explode("gs").alias("g")).distinct().groupBy("v").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    vectors = rows.groupBy("v").agg(F.first("x").alias("x")).join(members, "v", "left").join(asked, "v", "left")
    return rows, materialize(vectors, "vectors")


def _cell_join(query: DataFrame, ref: DataFrame, search: _Search, block_rows: int, pivots: int | None, stats: dict | None, small_cells: bool) -> DataFrame:
    """``(g, src, dst, kind, d2, rank)`` of ``(gs, id, x)`` and ``(gs, id, x, kind)``; see the module's text.

    A query vector first sees the nearest cells that hold enough rows of each kind, which give it a
    radius per group and kind; then the cells whose bound is within it, or all blocks if those are too many.
    """
    spark = query.sparkSession
    if not search.kinds:
        return spark.createDataFrame([], "g long, src long, dst long, kind int, d2 double, rank int")
    rows, vectors = _packed(query, ref, search)
    per_kind = [F.count_if(F.array_contains("rkind", kd)) for kd in search.kinds]
    n, n_asked, *of_kind = vectors.agg(F.count("rg"), F.count("groups"), *per_kind).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "g long, src long, dst long, kind int, d2 double, rank int")
    asking = _asking(rows)
    if n > block_rows:
        # the vectors are written: of the rows only their ids are read from now on
        asking = materialize(asking, "asking")
        discard(rows)
    n_cells = pivots or (min(MAX_PIVOTS, max(1, math.isqrt(n))) if small_cells or n > block_rows else 1)
    if n_cells == 1:
        asked = vectors.where(F.col("groups").isNotNull()).withColumn("cells", F.array(F.lit(0)))
        near = _met(vectors.withColumn("cell", F.lit(0)), {0: n}, asked, {0: n_asked}, search, block_rows, stats)
        # written: many query rows can share a vector, and meet its few neighbours where they lie
        one = n <= WIDE_BLOCKS * block_rows
        near = materialize(near if one else _merged(near, search), "near")
        discard(vectors)
        return _expanded(near, asking, search, lists=not one)
    # a kind of few rows has no near cells, and its wide radii would open those of the others: all queries meet it in one block
    scarce = {kd: m for kd, m in zip(search.kinds, of_kind, strict=True) if n > block_rows >= m}
    if scarce:
        own = search.only(scarce)
        few = _of_kinds(vectors, scarce)
        few = _met(few.withColumn("cell", F.lit(0)), {0: sum(scarce.values())}, vectors.where(F.col("groups").isNotNull()).select("v", "x", "groups", F.array(F.lit(0)).alias("cells")),
                   {0: n_asked}, own, block_rows, stats)
        few = materialize(_merged(few, own), "few")
        rest = [kd for kd in search.kinds if kd not in scarce]
        if not any(m for kd, m in zip(search.kinds, of_kind, strict=True) if kd in rest):
            discard(vectors)
            return _expanded(few, asking, search, lists=True)
        some = materialize(_of_kinds(vectors, rest), "vectors")
        discard(vectors)
        n = max(m for kd, m in zip(search.kinds, of_kind, strict=True) if kd in rest) if len(rest) == 1 else some.agg(F.count("rg")).first()[0]
        found = _by_cells(some, n, n_cells, search.only(rest), block_rows, stats)
        return _expanded(found.unionByName(few), asking, search, lists=True)
    return _expanded(_by_cells(vectors, n, n_cells, search, block_rows, stats), asking, search, lists=True)


def _of_kinds(vectors: DataFrame, kinds: Iterable[int]) -> DataFrame:
    """The vectors with their members of some kinds only (null where they have none)."""
    m = F.filter(F.arrays_zip("rg", "rkind", "rid", "rn"), lambda e: e["rkind"].isin(list(kinds)))
    some = vectors.select("v", "x", F.when(F.size(m) > 0, m).alias("m"), "groups")
    return some.select("v", "x", *[F.col(f"m.{c}").alias(c) for c in ("rg", "rkind", "rid", "rn")], "groups")


def _by_cells(vectors: DataFrame, n: int, n_cells: int, search: _Search, block_rows: int, stats: dict | None) -> DataFrame:
    """``(v, g, kind, dst, d2s, rank)`` of the ``n`` vectors' nearest, found by cells; the table of vectors goes."""
    cells = Cells(vectors, n_cells, search)
    asked = materialize(_visits(cells, cells.rows.where(F.col("groups").isNotNull()).select("v", "x", "groups"), search, None), "visits")
    near = materialize(_merged(_met(cells.rows, cells.sizes, asked, _per_cell(asked), search, block_rows, stats), search), "near")
    limited = asked.select("v", "x", "groups").join(_radii(near, search), "v", "left")
    blocks = math.ceil(n / block_rows)
    more = materialize(_visits(cells, limited, search, blocks), "more")
    many = _per_cell(more)
    everywhere = many.pop(-1, 0)
    found = near
    if many:
        far = _met(cells.rows, cells.sizes, more.where(F.col("cells")[0] >= 0), many, search, block_rows, stats)
        found = found.select("v", "g", "kind", "dst", F.explode("d2s").alias("d2")).unionByName(far)
    if everywhere:
        # these meet all rows again: what the nearest cells gave is among it
        wide = more.where(F.col("cells")[0] < 0)
        all_rows = _met(vectors.withColumn("cell", F.lit(-1)), {-1: n}, wide, {-1: everywhere}, search, block_rows, stats)
        found = found if many else found.select("v", "g", "kind", "dst", F.explode("d2s").alias("d2"))
        found = found.join(wide.select("v"), "v", "left_anti").unionByName(all_rows)
    if many or everywhere:
        found = materialize(_merged(found, search), "found")
        discard(near)
    for used in (asked, more, cells.rows, vectors):
        discard(used)
    return found


def _per_cell(asked: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _met(rows: DataFrame, size: Mapping[int, int], asked: DataFrame, many: Mapping[int, int], search: _Search, block_rows: int, stats: dict | None) -> DataFrame:
    """Candidates of the visits; cells with many rows or visits are dealt as blocks of rows times blocks of visits."""
    if stats is not None:
        stats["visits"] = stats.get("visits", 0) + sum(many.values())
        stats["pairs"] = stats.get("pairs", 0) + int(sum(m * size[c] for c, m in many.items()))
    # enough blocks to keep every core busy, but of at least 64 visits
    row_blocks = {c: math.ceil(size[c] / (WIDE_BLOCKS * block_rows)) for c in many}
    spread = math.ceil(rows.sparkSession.sparkContext.defaultParallelism / max(1, sum(row_blocks.values())))
    visit_blocks = {c: max(math.ceil(m / block_rows), min(spread, m // 64), 1) for c, m in many.items()}
    table = rows.sparkSession.createDataFrame([(c, row_blocks[c], visit_blocks[c]) for c in many], "cell int, rows int, visits int")
    dealt = F.broadcast(table.coalesce(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.withColumn("cell", F.explode("cells")).join(dealt, "cell")
    q = q.withColumn("qb", F.pmod(F.xxhash64("v"), F.col("visits")).cast("int")).withColumn("rb", each("rows")).drop("cells", "rows", "visits", "rg", "rkind", "rid", "rn")
    # fresh attributes: both sides may come from one table
    r = rows.where(F.col("rg").isNotNull()).select(*[F.col(c).alias(c) for c in ("v", "x", "rg", "rkind", "rid", "rn", "cell")]).join(dealt, "cell")
    r = r.withColumn("rb", F.pmod(F.xxhash64(F.col("v"), F.lit(7)), F.col("rows")).cast("int")).withColumn("qb", each("visits")).select(*[F.col(c).alias(c) for c in ("cell", "qb", "rb", "x", "rg", "rkind", "rid", "rn")])

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return _found(a, b, search)

    return q.groupBy("cell", "qb", "rb").cogroup(r.groupBy("cell", "qb", "rb")).applyInArrow(run, CANDIDATES)


def _merged(cand: DataFrame, search: _Search) -> DataFrame:
    """Per vector, group and kind the nearest ids, each with its distances (``d2s``, ascending; several where an id has several rows)."""
    at = ["v", "g", "kind"]
    ids = cand.repartition(*[F.col(c) for c in at]).groupBy(*at, "dst").agg(F.slice(F.array_sort(F.collect_list("d2")), 1, search.most).alias("d2s"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.col("d2s")[0], "dst")))
    return ranked.where(F.col("rank") <= _of_kind(search, search.ids))


def _radii(near: DataFrame, search: _Search) -> DataFrame:
    """Per vector its groups' distances to the last id that can count, by group and kind in order; infinite where there are fewer."""
    last = [F.max(F.when((F.col("kind") == kd) & (F.col("rank") == search.ids(kd)), F.col("d2s")[0])) for kd in search.kinds]
    per = near.groupBy("v", "g").agg(F.array(*[F.coalesce(x, F.lit(float("inf"))) for x in last]).alias("r"))
    return per.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("g", "r"))).alias("by_group"))


def _asking(rows: DataFrame) -> DataFrame:
    """``(v, g, src)`` of the query rows, once per group."""
    return rows.where("asked").select("v", F.explode("gs").alias("g"), F.col("id").alias("src"))


def _expanded(found: DataFrame, asking: DataFrame, search: _Search, lists: bool) -> DataFrame:
    """The query rows (``asking``) of each vector with its neighbours, themselves left out: ``k`` a row and kind by ``(d2, dst)``."""
    pairs = asking.join(found.drop("rank"), ["v", "g"])
    if search.exclude_self:
        pairs = pairs.where(F.col("src") != F.col("dst"))
    if lists:
        pairs = pairs.withColumn("d2", F.explode("d2s"))
    ranked = pairs.select("g", "src", "dst", "kind", "d2").withColumn("rank", F.row_number().over(Window.partitionBy("g", "src", "kind").orderBy("d2", "dst")))
    # a literal limit lets Catalyst insert the partial WindowGroupLimit
    ranked = ranked.where(F.col("rank") <= F.lit(search.most))
    return ranked.where(F.col("rank") <= _of_kind(search, search.k_by_kind.__getitem__))


class Cells:
    """The cells of a table of vectors: every one belongs to its nearest pivot.

    The driver and each task hold the pivots (at most ``MAX_PIVOTS`` vectors) and, per
    cell, the number of vectors of each kind and their least and largest distance to the pivot.
    """

    def __init__(self, vectors: DataFrame, pivots: int, search: _Search):
        # the pivots are vectors in hash order: a top-k by that order (the limit is the feature)
        chosen = vectors.where(F.col("rg").isNotNull()).select("v", "x").orderBy(F.xxhash64("v", F.lit(11)), "v").limit(pivots).collect()
        self.points = np.array([r["x"] for r in chosen], np.float64)
        self.kinds = search.kinds
        points = self.points

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, at = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                x = _matrix(b.column("x"))
                for a in range(0, len(x), SLICE):
                    d = _to_pivots(x[a : a + SLICE], points)
                    cell[a : a + SLICE] = d.argmin(axis=1)
                    at[a : a + SLICE] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(at)], names=[*b.schema.names, "cell", "at"])

        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("at", T.DoubleType())])
        self.rows = materialize(vectors.mapInArrow(place, schema), "cells")
        p = len(points)
        self.size = np.zeros(p, np.int64)
        self.low, self.high = np.full(p, np.inf), np.full(p, -np.inf)
        self.count = np.zeros((len(self.kinds), p), np.int64)
        per_kind = [F.sum(F.size(F.filter("rkind", lambda c, kd=kd: c == kd))).alias(f"n{n}") for n, kd in enumerate(self.kinds)]
        there = self.rows.where(F.col("rg").isNotNull())
        for r in there.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), *per_kind).collect():
            self.size[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["a"], r["b"]
            self.count[:, r["cell"]] = [r[f"n{n}"] for n in range(len(self.kinds))]
        groups = there.select(F.explode("rg").alias("g")).distinct().count()
        # rows that the first cells hold of each kind: enough for each of the groups, if they are of one size
        self.need = [min(search.ids(kd) * groups, int(self.count[n].sum())) for n, kd in enumerate(self.kinds)]
        self.sizes = {c: int(m) for c, m in enumerate(self.size)}

    def __getstate__(self) -> dict:
        """What tasks get: everything but the table."""
        return {name: value for name, value in self.__dict__.items() if name != "rows"}

    def first(self, d: np.ndarray) -> np.ndarray:
        """The cells by distance of their pivots until all kinds have their rows."""
        out = np.zeros(d.shape, bool)
        nearest = d.argmin(axis=1)
        out[np.arange(len(d)), nearest] = True
        enough = (self.count >= np.array(self.need)[:, None]).all(axis=0)
        poor = np.flatnonzero(~enough[nearest])
        if len(poor):
            order = np.argsort(d[poor], axis=1, kind="stable")
            taken = np.zeros(order.shape, bool)
            for count, n in zip(self.count, self.need, strict=True):
                have = np.cumsum(count[order], axis=1)
                depth = (have < n).sum(axis=1)
                np.logical_or(taken, np.arange(d.shape[1])[None] <= depth[:, None], out=taken)
            there = np.zeros(order.shape, bool)
            np.put_along_axis(there, order, taken, axis=1)
            out[poor] = there
        return out & (self.size > 0)[None]

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have from queries at distances ``d`` of the pivots.

        By the triangle inequality from the cell's ring, and from the border between the
        query's own cell and the other one: its rows are nearer to their pivot than to
        the query's, so half the difference of the query's two distances lies between.
        """
        ring = np.maximum(self.low[None] - d, d - self.high[None])
        border = (d - d.min(axis=1, keepdims=True)) / 2
        out = np.maximum(ring, border) - 1e-12 * d
        return np.where(self.size[None] > 0, out, np.inf)


def _to_pivots(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots by differences (no cancellation), a block of rows at a time."""
    out = np.empty((len(x), len(points)))
    step = max(1, DIFFERENCES // max(1, points.size))
    for a in range(0, len(x), step):
        diff = x[a : a + step, None, :] - points[None]
        out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _visits(cells: Cells, asked: DataFrame, search: _Search, blocks: int | None) -> DataFrame:
    """``(v, x, groups, cells)``: the cells that each query vector has to see.

    Without ``blocks`` the nearest cells; else ``asked`` has the radii found there (``by_group``), and the
    remaining cells within them are taken (``radii``: by group and kind), or ``-1`` if they are more than ``blocks``.
    """
    fields = [T.StructField("v", T.BinaryType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("groups", T.ArrayType(T.LongType()))]
    later = blocks is not None
    if later:
        inf = F.array(*[F.lit(float("inf"))] * len(search.kinds))
        radii = F.flatten(F.transform("groups", lambda g: F.coalesce(F.try_element_at(F.col("by_group"), g), inf)))
        asked = asked.select("v", "x", "groups", radii.alias("radii"))
        fields.append(T.StructField("radii", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                b = whole.slice(a, SLICE)
                d = _to_pivots(_matrix(b.column("x")), cells.points)
                seen = cells.first(d)
                if later:
                    lengths, r = _lists(b.column("radii"))
                    widest = np.sqrt(np.maximum.reduceat(r, _starts(lengths)[:-1])) * (1 + 1e-12)
                    bound = cells.bounds(d)
                    seen = (bound <= widest[:, None]) & ~seen & (cells.size > 0)[None]
                    wide = seen.sum(axis=1) > blocks
                    lists = [[-1] if w else np.flatnonzero(s).tolist() for w, s in zip(wide, seen, strict=True)]
                else:
                    lists = [np.flatnonzero(s).tolist() for s in seen]
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])
                yield out.filter(pa.array([bool(c) for c in lists]))

    return asked.mapInArrow(run, T.StructType([*fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def lsh_planes(tables: int, bits: int, width: int, seed: int) -> np.ndarray:
    """The hyperplanes of the hash tables, ``(tables, bits, width)``.

    Component ``i`` of plane ``n`` (both from 1, planes counted through all tables) is the
    fraction of ``sin(12.9898 n + 78.233 i n + seed) * 43758.5453`` less one half: scattered
    like random numbers, and the same in any language.
    """
    n = np.arange(1, tables * max(bits, 1) + 1, dtype=np.float64)[:, None]
    i = np.arange(1, width + 1, dtype=np.float64)[None]
    u = np.sin(12.9898 * n + 78.233 * i * n + seed) * 43758.5453
    return (u - np.floor(u) - 0.5).reshape(tables, max(bits, 1), width)


def _lsh_join(query: DataFrame, ref: DataFrame, search: _Search, *, kind_col: str | None, block_rows: int,
              tables: int, seed: int, bits: int) -> DataFrame:
    """Approximate kNN: random-hyperplane buckets as candidate groups, exact kernel inside.

    Each of ``tables`` hash tables gives every point a bucket (the signs of
    ``bits`` random projections; about ``rows / 2^bits`` rows share a bucket, 0 bits are the
    exact join).  Rows meet only rows of the same (table, bucket): the join is the grouped one with
    the buckets as groups, but a vector is dealt once with all its buckets.  The candidates of all
    tables are merged into the ``k`` best per row and kind.  Rows whose buckets hold fewer than ``k`` of a kind are
    compared with all rows.  Distances are exact; only recall is approximate.
    """
    k_by_kind = search.k_by_kind
    some = ref.where(usable(F.col("x"))).select("x").first()
    if some is None:
        return query.sparkSession.createDataFrame([], "src long, dst long, kind int, d2 double, rank int")
    width = len(some["x"])
    planes = lsh_planes(tables, bits, width, seed)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.ArrayType(T.LongType()))
    def _buckets(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        xs = np.stack(x.to_numpy()).astype(np.float64, copy=False)
        weights = (1 << np.arange(max(bits, 1))).astype(np.int64)
        out = []
        for t in range(tables):
            sig = ((xs @ planes[t].T) > 0).astype(np.int64) if bits else np.zeros((len(xs), 1), np.int64)
            out.append((sig @ weights) + (t << 32))
        return pd.Series(list(np.stack(out, axis=1)))

    kind = F.col(kind_col).cast("int") if kind_col else F.lit(0)
    bucketed = lambda df, *cols: df.where(usable(F.col("x"))).select(_buckets(F.col("x")).alias("gs"), "id", "x", *cols)
    found = _cell_join(bucketed(query), bucketed(ref, kind.alias("kind")), search, block_rows, None, None, small_cells=False)
    found = found.select("src", "dst", "kind", "d2").dropDuplicates(["src", "dst", "kind"])
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("src", "kind").orderBy("d2", "dst"))).where(F.col("rank") <= F.lit(search.most))
    found = materialize(found.where(F.col("rank") <= _of_kind(search, search.k_by_kind.__getitem__)), "lsh-found")
    counts = [F.count(F.when(F.col("kind") == kd, 1)).alias(f"n{n}") for n, kd in enumerate(k_by_kind)]
    enough = found.groupBy(F.col("src").alias("id")).agg(*counts)
    for n, kv in enumerate(k_by_kind.values()):
        enough = enough.where(F.col(f"n{n}") >= int(kv))
    short = materialize(query.select(F.col("id").cast("long").alias("id"), "x").join(enough.select("id"), "id", "left_anti"), "lsh-short")
    if short.isEmpty():
        return found
    cols_r = ["id", "x"] + ([kind_col] if kind_col else [])
    rest = knn_join(short, ref.select(*cols_r), k_by_kind, exclude_self=search.exclude_self, kind_col=kind_col, block_rows=block_rows)
    return found.join(short.select(F.col("id").alias("src")), "src", "left_anti").unionByName(rest)


def project(points: DataFrame, L, x_col: str = "x", out_col: str = "x") -> DataFrame:
    """Linear metric (K2): replace ``x`` by ``x @ L.T``, once per point (never per pair).

    ``L`` (``features_out x features_in``) is a model parameter, not data: its size is
    checked before it is shipped with the task closure.
    """
    mat = np.asarray(L, dtype=np.float64)
    if mat.ndim != 2 or mat.size > 4_000_000:
        raise ValueError("L must be a 2-D matrix of at most 4M entries")
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def _proj(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        xs = np.stack(x.to_numpy()).astype(np.float64, copy=False)
        return pd.Series(list(xs @ mat.T))

    return points.withColumn(out_col, _proj(F.col(x_col)))
