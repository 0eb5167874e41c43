"""The queries of this package over the test tables: thin wrappers that read a table, apply an operator and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedspread.llm import bpe, filteraudit, linededup, mixing, neighbors, quality, recompression, repeats, simhash, surrogates, toxicity, urlfilter, vectorcodes
from seedspread.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The key of the queries' surrogates; a user passes a secret one.
SURROGATE_KEY = b"key of the test queries"
#: From this score on a document counts as toxic.
TOXIC_FROM = 0.7


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.fit(docs, labels)


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, VOCABULARY, public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(docs, vocabulary, packed_col="packed", keep=["doc_id"]), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size and the words that the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the three-line passages that an earlier one has."""
    return linededup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return neighbors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _hashed(x: Column, modulo: int) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long") % modulo


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a fetch time: the table has none, so the id stands for a second of 2024."""
    second = F.pmod(F.col("page_id") * 290021, F.lit(366 * 86400))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for the domains and first path segments of ``pages``, chosen and dated by hashes."""
    url = F.col("url")
    domain = F.array_join(F.slice(F.split(urlfilter.host(url), r"\."), -3, 3), ".")
    prefix = F.concat(urlfilter.host(url), F.lit("/"), F.substring_index(urlfilter.path(url), "/", 1))
    found = table(spark, sf_dir, "pages").where("url is not null").select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), domain.alias("pattern")), F.struct(F.lit("prefix").alias("kind"), prefix.alias("pattern")))).alias("p")).select("p.*").distinct()
    entry = lambda name, action, day: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day.alias("day"))
    h = lambda m: _hashed(F.col("pattern"), m)
    domains = F.concat(
        F.when(h(3) == 0, F.array(entry("spam", "add", h(181)), entry("spam", "remove", h(181) + 60), entry("spam", "add", h(181) + 120))).otherwise(F.array()),
        F.when(h(5) == 0, F.array(entry("adult", "add", h(307)))).otherwise(F.array()),
        F.when(h(7) == 0, F.array(entry("trusted", "add", h(101)), entry("trusted", "remove", h(101) + 100))).otherwise(F.array()),
    )
    prefixes = F.when(h(4) == 0, F.array(entry("paths", "add", h(211)), entry("paths", "add", h(211) + 50))).otherwise(F.array())
    dated = found.select("pattern", F.explode(F.when(F.col("kind") == "domain", domains).otherwise(prefixes)).alias("e"))
    return dated.select("e.list", "pattern", "e.action", F.timestamp_seconds(F.lit(1704067200) + F.col("e.day") * 86400).alias("at"))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with surrogates for its personal data and secrets."""
    return surrogates.replaced(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "n_private", "text")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that each page was on when it was fetched, and whether they block it."""
    spells = urlfilter.intervals(list_entries(spark, sf_dir))
    judged = urlfilter.verdicts(captures(spark, sf_dir), spells, allow=["trusted"], keep=["page_id"])
    return judged.select("page_id", F.array_join("lists", ",").alias("lists"), "n_matches", "blocked")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and whether it passes the thresholds of its language and source."""
    judged = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return token_digests(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes in repeated strings of 200 bytes."""
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest id of its component."""
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the windows of 13 words that an earlier one has."""
    cut = recompression.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code and error, and the digest of the codebooks."""
    coded, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each order, by source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_surrogates, op2_mixing, op3_line_dedup, op4_ann, op5_url_filter, op6_quality, op7_byte_bpe, op8_toxicity, op9_suffix_dedup, op10_simhash, op11_recompression, op12_vector_codes, op13_filter_audit)
}
