"""Removal of long word passages that a document with a smaller id has too, by recompression.

A window is ``WINDOW`` consecutive words of one document; each word covered by a window
whose words also start in a document with a smaller id is removed.

Recompression writes a text as a sequence of symbols and shortens it in rounds.  Each
round names runs of one symbol, then pairs of neighbours: a hash bit deals all symbols
into left and right ones, and every left one followed by a right one becomes one symbol.
What is joined depends on the symbols alone, so equal substrings get equal symbols but
at their ends.  A name is a hash of what it stands for (round, kind, parts), so all
tasks give the same name to the same run or pair without asking each other; Spark's rounds
below find out globally which names several documents share.

1. Round one over all words.  A pair symbol with one more word on each side is known from
   these words alone.  Each window chooses the least such name in it (the first of equal
   ones), so equal windows choose alike; consecutive windows mostly choose the same
   occurrence and are one row.  Windows without a pair inside (a run, or a stretch of right
   and then left symbols) are named as a whole.  Names are counted over the corpus; windows
   whose name occurs once have no twin, which leaves little more than what is repeated.
2. The texts that are left are compressed for ``ROUNDS`` rounds, to symbols of some
   forty words.  Each high-level symbol, with the words that the windows starting
   in it reach, is cut out; equal ones are a class, with its smallest document.  Long
   repeats are runs of shared classes, however many documents have them: of a class only
   one text is looked at again.
3. Verification.  Names are not trusted: each window of each class is compared by the
   128-bit digest of its words, and a window's smallest document over all classes decides.
   In documents other than the class's smallest, all its windows are repeated; in
   the smallest, those that a class with a still smaller document has too.
4. Each document gets its repeated windows, and their words are cut out.

Hot passages: names, classes and windows are summed up before the shuffle, and what is
joined back is written first, so AQE may split the rows of one name over tasks.
Texts are compressed before they are shuffled (steps 2 and 4).

Defined cases: null and blank texts have no words; texts of fewer words than a window keep
all; rows with equal ids remove nothing from each other; a null id counts as larger
than every other, and null ids as equal; a text of one repeated word is one run and one
class.  The result has the columns ``keep`` (the id by default), ``n_words``,
``n_removed`` (long) and ``kept`` (binary: the words left, joined by one space, in UTF-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.llm.common import col, forget, slices, written_alone
from seedspread.llm.suffixes import powers, prefix_hashes

WINDOW, ROUNDS = 13, 13
#: Bytes of text that a task works on at once (a longer text is alone).
HELD = 1 << 21
KEY = ["_p_id", "_p_text"]
CLASS = ["d1", "d2"]
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HIGH, _LOW, _NONE = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit name from several, order included."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            out = (out ^ np.asarray(x).astype(np.uint64)) * _M1
            out = (out ^ (out >> np.uint64(30))) * _M2
            out = (out ^ (out >> np.uint64(27))) * _M3
            out = out ^ (out >> np.uint64(31))
    return out


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, and each word's first byte, end and text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    inside = ~_SPACES[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return data, start, end, np.searchsorted(begin, start, side="right") - 1


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name for each word, the same for equal words."""
    prefix, back = prefix_hashes(data), powers(len(data) + 1)[1]
    return mixed((prefix[end] - prefix[start]) * back[start], end - start)


def runs_named(sym: np.ndarray, at: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol in a text become one symbol: names, first words, texts, lengths."""
    if not len(sym):
        return sym, at, text, np.zeros(0, np.int64)
    new = np.concatenate([[True], (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(sym)))
    out = sym[first].copy()
    many = np.flatnonzero(n > 1)
    out[many] = mixed(2 * level, out[many], n[many])
    return out, at[first], text[first], n


def pairs(sym: np.ndarray, text: np.ndarray, level: int) -> np.ndarray:
    """Where a left symbol is followed by a right one in the same text."""
    side = mixed(sym, level) >> np.uint64(63)
    return np.flatnonzero((side[:-1] == 0) & (side[1:] == 1) & (text[1:] == text[:-1]))


def compressed(sym: np.ndarray, text: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after ``rounds`` rounds."""
    at = np.arange(len(sym))
    for level in range(1, rounds + 1):
        sym, at, text, _ = runs_named(sym, at, text, level)
        left = pairs(sym, text, level)
        sym[left] = mixed(2 * level + 1, sym[left], sym[left + 1])
        stays = np.ones(len(sym), bool)
        stays[left + 1] = False
        sym, at, text = sym[stays], at[stays], text[stays]
    return sym, at


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def chosen(names: np.ndarray, text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, first window, windows)`` of the rows of step 1; windows are numbered by their first word."""
    n = len(names) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    sym, at, owner, length = runs_named(names, np.arange(len(names)), text, 1)
    left = pairs(sym, owner, 1)
    begin, end = at[left] - 1, at[left + 1] + length[left + 1] + 1
    # the word before the pair and the one after it belong to the same text
    known = (begin >= 0) & (end <= len(names)) & (end - begin <= window)
    left, begin, end = left[known], begin[known], end[known]
    known = (text[begin] == owner[left]) & (text[end - 1] == owner[left])
    left, begin, end = left[known], begin[known], end[known]
    key = mixed(1, names[begin], sym[left], sym[left + 1], names[end - 1])
    best = np.full(n, _NONE)
    ranked = (key & _HIGH) | np.arange(len(key), dtype=np.uint64)
    for size in np.unique(end - begin).tolist():
        # a known pair of ``size`` words is in the windows that start up to window - size words before it
        some = end - begin == size
        here = np.full(len(names), _NONE)
        here[begin[some]] = ranked[some]
        best = np.minimum(best, _least(here, window - size + 1)[:n])
    found = best != _NONE
    which = np.where(found, (best & _LOW).astype(np.int64), -1)
    name = np.zeros(n, np.uint64)
    name[found] = key[which[found]]
    lone = np.flatnonzero(~found)
    if len(lone):
        name[lone] = mixed(0, *[names[lone + k] for k in range(window)])
    whole = text[:n] == text[window - 1 :]
    # one row for consecutive windows of one text with one choice
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (name[1:] != name[:-1]) | (text[1:n] != text[: n - 1]) | (whole[1:] != whole[:-1])])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, n))
    keep = whole[first]
    return name[first][keep].view(np.int64), first[keep], many[keep]


def _gathered(batches: Iterator[pa.RecordBatch], text: int, press: zstandard.ZstdDecompressor | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of batches with their texts as bytes, about ``HELD`` bytes at a time."""
    for batch in slices(batches):
        texts = [press.decompress(t) for t in batch.column(text).to_pylist()] if press else [(t or "").encode() for t in batch.column(text).to_pylist()]
        at, held = 0, 0
        for k, t in enumerate(texts):
            if held and held + len(t) > HELD:
                yield batch.slice(at, k - at), texts[at:k]
                at, held = k, 0
            held += len(t) + 1
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def _keyed(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """The key of each document, the columns to carry, and the text."""
    row = F.struct(*[col(c) for c in carried]) if carried else F.lit(None).cast("int")
    place = F.coalesce(col(id_col).cast("long"), F.lit((1 << 63) - 1))  # null after all others
    return docs.select(place.alias(KEY[0]), F.xxhash64(F.lit(1), col(text_col)).alias(KEY[1]), row.alias("_p_row"), col(text_col).alias("_p_words"))


def _choices(keyed: DataFrame, window: int) -> DataFrame:
    """``(name, key, start, n)`` of step 1, for every document; ``start`` counts the words of the document."""
    schema = f"name long, {KEY[0]} long, {KEY[1]} long, start int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _gathered(batches, 2):
            data, start, end, text = cut_words(texts)
            name, first, n = chosen(word_names(data, start, end), text, window)
            own = text[first]
            begin = np.searchsorted(text, np.arange(len(texts)))
            owner = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(name), part.column(0).take(owner), part.column(1).take(owner), pa.array((first - begin[own]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["name", *KEY, "start", "n"])

    return keyed.select(*KEY, "_p_words").mapInArrow(run, schema)


def _compressed(keyed: DataFrame) -> DataFrame:
    """The text as compressed UTF-8 bytes."""
    schema = T.StructType([*keyed.schema.fields[:-1], T.StructField("_p_words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            texts = pa.array([press.compress((t or "").encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _members(docs: DataFrame, choices: DataFrame, window: int, rounds: int) -> DataFrame:
    """``(key, start, n, d1, d2, words)`` of step 2: each stretch of candidate windows that starts in one high-level symbol."""
    lists = choices.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("choices"))
    joined = docs.join(lists, KEY).select(*KEY, "_p_words", "choices")
    schema = f"{KEY[0]} long, {KEY[1]} long, start int, n int, d1 long, d2 long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _gathered(batches, 2, zstandard.ZstdDecompressor()):
            data, start, end, text = cut_words(texts)
            begin = np.searchsorted(text, np.arange(len(texts)))
            flat = part.column(3).flatten()
            a = np.repeat(begin, part.column(3).value_lengths().to_numpy()) + flat.field(0).to_numpy()
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, a, 1)
            np.add.at(change, a + flat.field(1).to_numpy(), -1)
            open_ = np.cumsum(change[:-1]) > 0
            _, at = compressed(word_names(data, start, end), text, rounds)
            symbol = np.zeros(len(start), bool)
            symbol[at] = True
            first = np.flatnonzero(open_ & (symbol | np.concatenate([[True], ~open_[:-1]])))
            stops = np.concatenate([np.flatnonzero(symbol | ~open_), [len(start)]])
            last = stops[np.searchsorted(stops, first + 1)]
            raw = data.tobytes()
            cut = [b" ".join(raw[x:y].split()) for x, y in zip(start[first].tolist(), end[last + (window - 2)].tolist(), strict=True)]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cut)), np.int64).reshape(-1, 2)
            own = text[first]
            owner = pa.array(own)
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array((first - begin[own]).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(cut, pa.binary())], names=[*KEY, "start", "n", "d1", "d2", "words"])

    return joined.mapInArrow(run, schema)


def _windows(classes: DataFrame, window: int) -> DataFrame:
    """``(w1, w2, least, class, at)``: the digest of each window of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests, many = [], []
            for t in part.column(2).to_pylist():
                ends = [k for k, x in enumerate(t) if x == 0x20] + [len(t)]
                starts = [0, *(k + 1 for k in ends[:-1])]
                digests += [xxhash.xxh3_128_digest(t[x:y]) for x, y in zip(starts, ends[window - 1 :], strict=False)]
                many.append(len(starts) - window + 1)
            w = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(many)), many))
            at = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *[part.column(k).take(owner) for k in (1, 0)], pa.array(at.astype(np.int32))], names=["w1", "w2", "least", "class", "at"])

    return classes.select("class", "least", "words").mapInArrow(run, "w1 long, w2 long, least long, class long, at int")


def _hits(members: DataFrame, window: int) -> DataFrame:
    """``(key, start, n, windows)`` of each stretch with repeated windows; null stands for all of them."""
    classes = written_alone(members.groupBy(*CLASS).agg(F.min(KEY[0]).alias("least"), F.max(KEY[0]).alias("most"), F.first("words").alias("words")).withColumn("class", F.monotonically_increasing_id()), "passage-classes")
    windows = _windows(classes, window)
    shared = written_alone(windows.groupBy("w1", "w2").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "passage-windows")
    some = windows.join(shared, ["w1", "w2"]).where("lo < least").groupBy("class").agg(F.sort_array(F.collect_list("at")).alias("windows"))
    verdicts = written_alone(classes.select(*CLASS, "class", "least", "most").join(some, "class", "left").where("least < most or windows is not null").select(*CLASS, "least", "windows"), "passage-verdicts")
    met = members.select(*KEY, "start", "n", *CLASS).join(verdicts, CLASS)
    rest = F.when(F.col(KEY[0]) == F.col("least"), F.col("windows"))
    return met.where((F.col(KEY[0]) > F.col("least")) | F.col("windows").isNotNull()).select(*KEY, "start", "n", rest.alias("windows"))


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document's ``n_words``, ``n_removed`` and ``kept`` words beside the columns ``keep``."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in {f.name for f in added}]
    keyed = _keyed(docs, id_col, text_col, keep)
    choices = _choices(keyed, window)
    shared = written_alone(choices.groupBy("name").count().where("count > 1").select("name"), "passage-names")
    texts = _compressed(keyed.select(*KEY, "_p_words"))
    members = written_alone(_members(texts, choices.join(shared, "name"), window, rounds), "passages")
    forget(shared)
    lists = _hits(members, window).groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "windows")).alias("hits"))
    joined = _compressed(keyed).join(lists, KEY, "left").select("_p_row", "_p_words", "hits")
    schema = T.StructType([joined.schema.fields[0], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _gathered(batches, 1, zstandard.ZstdDecompressor()):
            yield pa.RecordBatch.from_arrays([part.column(0), *_removed(found, part.column(2), window)], names=schema.names)

    cut = joined.mapInArrow(run, schema)
    return cut.select(*[F.col("_p_row")[c].alias(c) for c in keep], *[f.name for f in added])


def _removed(texts: list[bytes], hits: pa.ListArray, window: int) -> list[pa.Array]:
    """Words, words removed, and the words left of each text."""
    data, start, end, text = cut_words(texts)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    flat = hits.flatten()
    at = np.repeat(bounds[:-1], hits.value_lengths().fill_null(0).to_numpy()) + flat.field(0).to_numpy()
    windows = flat.field(2)
    whole = windows.is_null().to_numpy(zero_copy_only=False)
    single = np.repeat(at, windows.value_lengths().fill_null(0).to_numpy()) + windows.flatten().to_numpy()
    change = np.zeros(len(start) + 1, np.int64)
    for places, step in ((at[whole], 1), (at[whole] + flat.field(1).to_numpy()[whole] + (window - 1), -1), (single, 1), (single + window, -1)):
        np.add.at(change, places, step)
    gone = np.cumsum(change[:-1]) > 0
    raw, kept = data.tobytes(), []
    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        stay = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join(t.split()) if len(stay) == b - a else b" ".join([raw[x:y] for x, y in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[bounds[1:]] - before[bounds[:-1]]
    return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary())]

