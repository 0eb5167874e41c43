"""Near duplicates by SimHash fingerprints, linked through multi-index hashing.

Fingerprints: A-Z are lower-cased, shingles of ``shingle`` words (repeats included;
a shorter text is one shingle) are hashed by XXH64 with seed 42, and a bit of the
fingerprint is 1 if it is set in more than half of the hashes.

Links: the 64 bits are cut into ``segments`` parts.  Fingerprints that differ in at
most ``max_bits`` bits differ in at most ``max_bits // segments`` bits of some part, so
each fingerprint looks up the small Hamming ball around each of its parts in a table of
the parts of all fingerprints, and every match is verified on all 64 bits.  Of two
fingerprints, only the one with a 0 in the lowest differing bit of the part looks
up the other: half the probes, no pair lost.

Probes and table rows of a part value meet sorted in one partition and are compared in
numpy.  A part value that many fingerprints share is dealt to several tasks by a hash
of the table's fingerprints, and its probes go to each of them.  Out of a task come no
pairs but a spanning forest of its links: at most a row for each fingerprint, however
large a group of copies is.  Components are those of all links (``components``).

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any
other; equal texts and repeated rows have equal fingerprints and so one component; the
component id is the smallest id in the component, null only if it has no id but null.
``keep`` names the input columns to return beside the results ``fingerprint`` (long)
and ``component_id``; an input column of such a name isn't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seedspread.llm.common import col, slices, written
from seedspread.llm.components import components

SEED = 42
#: So many hashes are counted at once.
COUNT_BLOCK = 1 << 16
#: Table rows of a part value in one task; more are dealt to several.
BLOCK = 4096
#: Pairs compared at once, links gathered before they are thinned to a forest.
PAIRS, LINKS = 1 << 21, 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the white space that separates words
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), COUNT_BLOCK):
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[k : k + COUNT_BLOCK], stops[k : k + COUNT_BLOCK], strict=True)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(starts))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the fingerprint of each whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "fingerprint"]
    narrow = docs.select(*[col(c) for c in keep], col(text_col).alias("_simhash_text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keep, "fingerprint"])

    return narrow.mapInArrow(run, schema)


def part_masks(segments: int, max_bits: int) -> list[tuple[int, int, int, int]]:
    """``(part, its bits, flipped bits, lowest flipped bit)`` for every probe of a fingerprint, as signed integers."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for j in range(segments):
        at = range(64 * j // segments, 64 * (j + 1) // segments)
        for r in range(max_bits // segments + 1):
            for flips in combinations(at, r):
                out.append((j, signed(sum(1 << b for b in at)), signed(sum(1 << b for b in flips)), signed(1 << flips[0]) if flips else 0))
    return out


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the links ``u - v`` connect, at most one for each node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b):
            np.minimum.at(after, label[side], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _matches(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among sorted rows: each probe (1: unchanged part, 2: flipped bits) against the table rows (0) of its key."""
    owners = np.flatnonzero(probe == 0)
    probes = np.flatnonzero(probe)
    first = np.searchsorted(key[owners], key[probes], "left")
    count = np.searchsorted(key[owners], key[probes], "right") - first
    probes, first, count = probes[count > 0], first[count > 0], count[count > 0]
    bounds = np.cumsum(count)
    at = 0
    while at < len(probes):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        left = np.repeat(probes[at:to], n)
        right = owners[np.repeat(first[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= max_bits
        near &= (probe[left] == 2) | (fp[left] < fp[right])
        yield fp[left[near]], fp[right[near]]
        at = to


def links(nodes: DataFrame, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """``(u, v)``: links that connect the distinct fingerprints ``nodes.fingerprint`` just as all pairs within ``max_bits`` bits do."""
    masks = part_masks(segments, max_bits)
    own = [m for m in masks if m[2] == 0]
    entry = lambda m: F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(m, ("part", "bits", "flip", "low"), strict=True)])
    value = F.expr("(fingerprint ^ m.flip) & m.bits")
    owners = nodes.select("fingerprint", F.explode(F.array(*map(entry, own))).alias("m")).select(F.col("m.part").alias("part"), value.alias("value"), F.lit(0).alias("probe"), "fingerprint")
    wanted = F.filter(F.array(*map(entry, masks)), lambda m: (m["flip"] == 0) | (F.col("fingerprint").bitwiseAND(m["low"]) == 0))
    probes = nodes.select("fingerprint", F.explode(wanted).alias("m")).select(F.col("m.part").alias("part"), value.alias("value"), F.when(F.col("m.flip") == 0, 1).otherwise(2).alias("probe"), "fingerprint")
    hot = written(owners.groupBy("part", "value").count().where(F.col("count") > BLOCK).select("part", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-parts")
    blocks = F.coalesce("blocks", F.lit(1))
    owners = owners.join(hot, ["part", "value"], "left").withColumn("block", F.pmod(F.xxhash64("fingerprint"), blocks).cast("int"))
    probes = probes.join(hot, ["part", "value"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    names = ("part", "value", "block", "probe", "fingerprint")
    meet = owners.select(*names).unionByName(probes.select(*names))
    meet = meet.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the table rows of the last key so far
        us, vs, held = [], [], 0
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(5)]
            if carried is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(carried, rows, strict=True)]
            part, value, block, probe, fp = rows
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(block) != 0)) + 1
            key = np.zeros(len(fp), np.int64)
            key[new] = 1
            key = np.cumsum(key)
            for u, v in _matches(key, probe, fp, max_bits):
                us.append(u), vs.append(v)
                held += len(u)
                if held > LINKS:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
                    if held > LINKS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                        us, vs, held = [], [], 0
            last = (key == key[-1]) & (probe == 0) if len(key) else np.zeros(0, bool)
            carried = [x[last] for x in rows]
        if held:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return meet.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each document: the columns ``keep`` (the id by default), its fingerprint, ``root`` (a fingerprint that names its component) and ``component_id``."""
    taken = ("fingerprint", "root", "component_id")
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in taken]
    prints = written(fingerprints(docs, shingle, text_col, list(dict.fromkeys([*keep, id_col]))), "fingerprints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min(col(id_col)).alias("least_id")), "nodes")
    roots = components(links(nodes, max_bits, segments))
    named = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.select("fingerprint", "root").join(least, "root")
    return prints.join(named, "fingerprint").select(*[col(c) for c in keep], "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near duplicates: of each component the row with the smallest id stays.

    Null ids come last; of rows with one id, that with the smallest text hash stays, and
    of rows equal in id and text, one.  The columns are those of ``docs``.
    """
    key = ["_nd_id", "_nd_t1", "_nd_t2"]
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_nd_row"), col(id_col).alias("_nd_id"), F.xxhash64(F.lit(1), col(text_col)).alias("_nd_t1"), F.xxhash64(F.lit(2), col(text_col)).alias("_nd_t2"))
    marked = near_duplicates(keyed.withColumn("_nd_text", F.col("_nd_row")[text_col]), shingle, max_bits, segments, "_nd_id", "_nd_text", key)
    order = [F.col("_nd_id").asc_nulls_last(), F.col("_nd_t1"), F.col("_nd_t2")]
    first = marked.withColumn("_nd_place", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("_nd_place = 1")
    chosen = first.select(*[F.col(c).alias(f"{c}_") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    kept = keyed.join(chosen, same[0] & same[1] & same[2]).select("_nd_row", *key).dropDuplicates(key)
    return kept.select(*[F.col("_nd_row")[c].alias(c) for c in docs.columns])
