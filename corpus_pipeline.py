"""A corpus from raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

Nulls: a document without text has no words and goes in the first stage; a null source is a source, null languages and ids stay. Empty
tables pass through. Rows that repeat an id and a text are one document from the near-duplicate stage on; rows that repeat an id alone
are documents of their own. Ties go to the smaller id, then to the smaller hash of the text. Columns beside those of documents pass
through all stages but the last, whatever their names. Every stage works on all rows that its predecessor kept, and takes its decisions
by the operator that it names.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, lines, mixing, quality, simhash
from quern.session import remove, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy of the quality rules accepts."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated lines; those of which nothing is left go. n_chars follows the text."""
    left = lines.dedup(docs, bare=True).filter(F.length("text") > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by words in fives."""
    return simhash.keep_one(docs, rule=simhash.FIVE)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document of the mix: their number, packed ids, and digests of ids and of the decoded bytes."""
    both = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: Fingerprints and tokens cannot be had in SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. What lies between them is kept in the shared folder of spark.checkpoint.dir until the stage
    after it has been written; what the last stage reads stays, as the caller has yet to run it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
