"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (of the UTF-8 bytes of the lower-cased text,
white space drawn together) that occur in it, hashed to ``BUCKETS`` buckets.  On labelled
text, each feature gets the log of the ratio of its smoothed shares among toxic and other
texts; a logistic regression is then fitted on the features times these ratios.  Its
weights times the ratios are one vector, and a text's score is the logistic function of
the sum over its features.

Fitting uses at most ``sample`` labelled rows, those with the smallest hash of their id:
a documented bound, so that their ids can be broadcast and their selected features fit on
the driver.  Spark featurises and counts; scoring is one pass over all documents without
a shuffle.

Defined cases: a null text counts as empty; an empty text gets the score of the
intercept; an id labelled more than once counts as toxic if one label says so; null
labels and labels without a document teach nothing; without both classes the score is
``NO_MODEL`` for every text.  Scores are functions of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.llm.common import col, forget, slices, written

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Bytes that are featurised at once.
BLOCK = 1 << 20
#: Tasks that featurise the sample; each sends two counts a bucket to the driver.
SAMPLE_TASKS = 16
SMOOTHING, MIN_TEXTS, MIN_RATIO = 1.0, 5, 1.0
NO_MODEL = 0.0


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of the n-grams of a text, each once, in order."""
    data = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode(), np.uint8)
    found = np.zeros(BUCKETS, bool)
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK + max(SIZES) - 1].astype(np.uint32)
        h = np.zeros(len(block), np.uint32)
        for n in range(1, max(SIZES) + 1):
            h = h[: len(block) - n + 1] * np.uint32(0x01000193)
            h ^= block[n - 1 :]
            if n in SIZES:
                found[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)] = True
    return np.flatnonzero(found)


@dataclass
class Model:
    """Weight of each bucket and intercept; none of them without both classes in the labels."""

    weights: np.ndarray | None
    intercept: float = 0.0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return NO_MODEL
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[ngrams(text)].sum(dtype=np.float64), -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the third that teaches nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _descend(value_and_slope, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth convex function, by limited-memory BFGS with halved steps."""
    value, slope = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, scales = -slope, []
        for s, y in reversed(steps):
            scales.append((s @ direction) / (s @ y))
            direction = direction - scales[-1] * y
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(scales), strict=True):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        while True:
            new = x + size * direction
            new_value, new_slope = value_and_slope(new)
            if new_value <= value + 1e-4 * size * (slope @ direction) or size < 1e-8:
                break
            size /= 2
        if (new_slope - slope) @ (new - x) > 1e-12:
            steps = [*steps[-(memory - 1) :], (new - x, new_slope - slope)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def _regression(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression; the classes weigh the same in total."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows)
    x = scale[feature]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def value_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, x * w[feature], len(rows)) + w[-1]
        loss = np.logaddexp(0, np.where(y == 1, -z, z)) @ weight + penalty / 2 * (w[:-1] @ w[:-1])
        back = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.bincount(feature, x * back[owner], len(w))
        slope[:-1] += penalty * w[:-1]
        slope[-1] = back.sum()
        return loss, slope

    w = _descend(value_and_slope, np.zeros(len(scale) + 1), rounds)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 30_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", penalty: float = 1e-4, rounds: int = 60) -> Model:
    """A model of ``labels (id, label)`` on the texts of ``docs``, from at most ``sample`` labelled ids."""
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col).cast("int")).alias("label"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labelled")
    texts = docs.select(col(id_col).alias("_id"), col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label")
    texts = written(texts.repartition(SAMPLE_TASKS), "labelled-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(label > 0), ngrams(text)] += 1
                n[label > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["others", "toxic", "seen"])

    total, others, toxic = np.zeros((2, BUCKETS), np.int64), 0, 0
    for row in texts.mapInArrow(count, "others long, toxic long, seen binary").collect():
        total += np.frombuffer(row.seen, np.int32).reshape(2, BUCKETS)
        others, toxic = others + row.others, toxic + row.toxic
    if not others or not toxic:
        return Model(None)
    shares = (total + SMOOTHING) / (np.array([[others], [toxic]]) + 2 * SMOOTHING)
    ratio = np.log(shares[1] / shares[0])
    used = np.flatnonzero((total.sum(axis=0) >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    places = docs.sparkSession.sparkContext.broadcast(place)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(at := places.value[ngrams(t)])[at >= 0].tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "features"])

    rows, y = [], []
    for row in texts.mapInArrow(select, "label int, features binary").collect():
        rows.append(np.frombuffer(row.features, np.int32))
        y.append(int(row.label > 0))
    forget(texts), forget(chosen)
    w, intercept = _regression(rows, np.array(y), ratio[used], penalty, rounds)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, intercept)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (all by default) and the score of each whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*[col(c) for c in keep], col(text_col).alias("_tox_text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField(score_col, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array([shared.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*keep, score_col])

    return narrow.mapInArrow(run, schema)
