"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

``STAGES`` are applied to ``documents`` in order; each stage's result is written as
Parquet to the shared folder and read again as the next one's documents.  All stages but
the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedspread.llm import linededup, mixing, simhash, toxicity
from seedspread.llm.catalog import TOXIC_FROM, token_digests, toxicity_model
from seedspread.llm.common import table, written

_SCORE = "_toxicity_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.scored(docs, toxicity_model(spark, docs, sf_dir), score_col=_SCORE).where(F.col(_SCORE) < TOXIC_FROM).drop(_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return linededup.without_repeats(docs, counts=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return token_digests(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL has no classifier, XXH64 or BPE; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
