"""Collections and queries made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import TOKEN, Index, from_texts, from_tokens
from quern.session import checkpointed, state, table

#: What is held for each kind of collection and batch of queries, and the state of the table that it was made of.
_kept: dict[tuple[str, str], tuple[object, object]] = {}


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    """Tokens of documents. It is held, as an index is, until the table changes."""
    return _held(spark, sf_dir, "text", "documents", lambda: from_texts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def basket_index(spark: SparkSession, sf_dir: str) -> Index:
    """Orders are documents, parts are terms."""
    return _held(spark, sf_dir, "basket", "lineitem", lambda: from_tokens(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"))))


def page_index(spark: SparkSession, sf_dir: str) -> Index:
    """Tokens of web pages without their tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return _held(spark, sf_dir, "pages", "pages", lambda: from_texts(pages, "page_id", "text"))


def _made_once(spark: SparkSession, sf_dir: str, kind: str, source: str, build, forget):
    """What build makes of a table, held until the table changes or another folder is asked for; then forget gets the old one."""
    app = spark.sparkContext.applicationId
    now = sf_dir, state(spark, f"{sf_dir}/{source}.parquet")
    was, held = _kept.get((app, kind), (None, None))
    if was != now:
        if held is not None:
            forget(held)
        held = build()
        _kept[app, kind] = now, held
    return held


def _held(spark: SparkSession, sf_dir: str, kind: str, source: str, build) -> Index:
    return _made_once(spark, sf_dir, kind, source, lambda: build().keep(), lambda index: index.drop())


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid) of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))


def text_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, term, qtf): every term of each benchmark item, also those that no document holds.

    Written once, as a batch of queries is a file.
    """
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.split(F.lower("text"), TOKEN)).alias("term")).filter("term <> ''")
    return _made_once(spark, sf_dir, "asked", "benchmark", lambda: checkpointed(words.groupBy("qid", "term").agg(F.count("*").alias("qtf"))), lambda _: None)


def basket_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, term, qtf): every order asks for the orders that are most like it."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("term")).agg(F.count("*").alias("qtf"))
