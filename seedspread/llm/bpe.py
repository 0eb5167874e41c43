"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The vocabulary is a rank file (base64 token, rank).  From the ranks the driver builds
one ``tokenizers`` model: every byte is mapped to a printable character, and the merges
are those pairs that the ranks themselves would join last (``merges``).  The model's
JSON is broadcast: its size is that of the vocabulary file, whatever the corpus.

Long texts are encoded in pieces.  A white-space character that follows another
character always begins a match of the split pattern, so a cut there changes no id;
pieces bound the memory that a task needs.

Decoding reverses the byte table per token and joins the bytes before any decoding to
characters, so that a character split over several tokens is whole again.

Defined cases: a null or empty text has no ids, and no ids decode to no bytes; special
tokens have no meaning: their strings in a text are ordinary text.  Output columns
replace input columns of the same name.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.llm.common import col, slices

#: Texts above so many characters are encoded in pieces of about that size.
PIECE_CHARS = 1 << 16
#: So many different matches a worker remembers, of so many characters at most (some 25 MB, 80 MB if all are of that length).
MEMO, MEMO_CHARS = 100_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the
    characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that each longer token is made of, by rank: what is left of its bytes when all earlier merges are done."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def model_json(ranks: dict[bytes, int]) -> str:
    """A ``tokenizers`` model for these ranks; it takes one match of the split pattern at a time."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    name = lambda token: "".join(chars[b] for b in token)
    model = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, [(name(a), name(b)) for a, b in merges(ranks)]))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model.to_str()


def cuts(text: str, size: int = PIECE_CHARS) -> list[int]:
    """Where a text may be cut into pieces of about ``size`` characters without changing an id, 0 and the end included."""
    at, out = 0, [0]
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found or found.end() - 1 >= len(text):
            break
        at = found.end() - 1
        out.append(at)
    return [*out, len(text)]


_CUT = re.compile(r"[^\s\x1c-\x1f][ \n\r\t]")


#: A split pattern of letters, numbers, spaces and the rest, and the same in the classes of the
#: standard ``re``: equal on texts of ``plain`` characters, and several times as fast.
SAME_IN_RE = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""",
}


def plain(char: str) -> bool:
    """Whether ``re`` and the library are sure to class a character alike."""
    kind = unicodedata.category(char)
    if char.isspace():
        return not "\x1c" <= char <= "\x1f"
    return kind[0] == "L" or kind == "Nd" or not (char.isalnum() or kind == "Cn")


class Memo(dict):
    """What ``make`` says of a match, kept if the match is short; emptied when it holds ``MEMO`` matches."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, match: str):
        if len(match) > MEMO_CHARS:
            return self.make(match)
        if len(self) >= MEMO:
            self.clear()
        self[match] = out = self.make(match)
        return out


class Encoder:
    """One model in one Python worker, with the ids of the matches that it met lately."""

    def __init__(self, model: str, pattern: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_str(model).model
        self.library_split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.quick_split = re.compile(SAME_IN_RE[pattern]) if pattern in SAME_IN_RE else None
        self.chars, self.plain = byte_chars(), Memo(plain)
        self.ids, self.offsets = Memo(self._ids), Memo(self._offsets)

    def _tokens(self, match: str) -> list:
        return self.model.tokenize("".join([self.chars[b] for b in match.encode()]))

    def _ids(self, match: str) -> bytes:
        return struct.pack(f"<{len(tokens := self._tokens(match))}I", *[t.id for t in tokens])

    def _offsets(self, match: str) -> np.ndarray:
        """First and last-plus-one character of each token: a token has a mapped character for each of its bytes."""
        char = np.cumsum((np.frombuffer(match.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1
        ends = np.cumsum([len(t.value) for t in self._tokens(match)])
        return np.stack([char[np.concatenate([[0], ends[:-1]])], char[ends - 1] + 1], axis=1)

    def split(self, text: str) -> list[str]:
        if self.quick_split and all(map(self.plain.__getitem__, set(text))):
            return self.quick_split.findall(text)
        return [match for match, _ in self.library_split.pre_tokenize_str(text)]

    def encode(self, text: str, spans: bool = False) -> tuple[bytes, np.ndarray]:
        """Ids as 32-bit integers, and each token's first and last-plus-one character where ``spans`` is set."""
        ids, offsets = [], [np.zeros((0, 2), np.int32)]
        bounds = cuts(text)
        for a, b in zip(bounds, bounds[1:], strict=False):
            matches = self.split(text[a:b])
            ids.append(b"".join(map(self.ids.__getitem__, matches)))
            if spans and matches:
                starts = a + np.cumsum([0, *map(len, matches[:-1])])
                found = [self.offsets[x] for x in matches]
                offsets.append(np.concatenate(found) + np.repeat(starts, list(map(len, found)))[:, None].astype(np.int32))
        return b"".join(ids), np.concatenate(offsets)


class Vocabulary:
    """Ranks and split pattern, with the model that the driver has built from them."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern = pattern
        self.model = spark.sparkContext.broadcast(model_json(read_ranks(path)))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", spans_col: str | None = None, packed_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of each whole text and, if ``spans_col`` is named, each token's start and end in characters (arrays).

    ``packed_col`` names a column for the ids as unsigned 32-bit little-endian integers, one
    after another (binary), the form in which token files hold them.  ``keep`` names the
    input columns to return (all by default).
    """
    model, pattern, spans = vocabulary.model, vocabulary.pattern, spans_col is not None
    lists_added = [ids_col, *([f"{spans_col}_start", f"{spans_col}_end"] if spans else [])]
    added = [*lists_added, *([packed_col] if packed_col else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    narrow = docs.select(*[col(c) for c in keep], F.coalesce(col(text_col), F.lit("")).alias("_encode_text"))
    schema = T.StructType([*[f for f in narrow.schema if f.name in keep], *[T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in lists_added], *([T.StructField(packed_col, T.BinaryType())] if packed_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model.value, pattern)  # one for each task: an idle worker holds nothing
        for part in slices(batches):
            found = [own.encode(x, spans) for x in part.column(part.num_columns - 1).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(x) // 4 for x, _ in found)]).astype(np.int32))
            lists = [np.frombuffer(b"".join(x for x, _ in found), dtype="<i4"), *(np.concatenate([x for _, x in found]).T if spans else ())]
            arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in lists]
            packed = [pa.array([x for x, _ in found], pa.binary())] if packed_col else []
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays, *packed], names=[*keep, *added])

    return narrow.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids of each row stand for (binary).  Null ids decode to no bytes; an unknown id fails the job."""
    model = vocabulary.model
    keep = [c for c in rows.columns if c != bytes_col]
    at = keep.index(ids_col)
    narrow = rows.select(*[col(c) for c in keep])
    schema = T.StructType([*narrow.schema, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        vocabulary = json.loads(model.value)["model"]["vocab"]
        parts = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            parts[k] = bytes(to_byte[c] for c in token)
        for batch in slices(batches):
            out = [b"".join([parts[k] for k in ids]) if ids is not None else b"" for ids in _lists(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, bytes_col])

    return narrow.mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column, one after another."""
    values, ends, missing = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield None if missing[k] else values[ends[k] : ends[k + 1]].tolist()
