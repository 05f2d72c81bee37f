"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, langid, licences, lines, mixing, perplexity, quality, search, simhash, toxicity
from quern.llm.oracle import ORACLE_SQL
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to; path and pattern are of the public ranks."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "valid")


def _fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold of five is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs, _fold("doc_id", 5) != 0)
    return langid.classify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, with the verdict of the base policy and of the newest one."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(1).alias("base_failed"), (~quality.fails(3)).alias("kept"), "fail_bits",
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products for every vector whose id is divisible by 20."""
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.clusters(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document under a model of the documents labelled as good, and whether it is kept."""
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels whose fold of three is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _fold("doc_id", 3) != 1)
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of lines that names a license."""
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES = (op1_byte_bpe, op2_language_id, op3_quality_rules, op4_exact_top_k, op5_simhash_near_dedup, op6_kneser_ney_quality, op7_source_mixing, op8_line_dedup, op9_toxicity, op10_license_scan)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
