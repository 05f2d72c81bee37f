"""Boolean queries: relational division for AND, distinct documents for OR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.index import Index, marked


def _matches(index: Index, query_terms: DataFrame, by_shard: bool = False) -> tuple[list[str], DataFrame, DataFrame]:
    """Group keys, (qid, doc_id, terms met, freqs), and the distinct terms. Terms count once, however often a query has them."""
    wanted = query_terms.select("qid", "term").distinct()
    met = index.postings.join(wanted, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("n_met"), F.sum("freq").alias("freqs"))
    if by_shard:
        return ["qid", "shard_id"], met.withColumn("shard_id", index.shard(F.col("doc_id"))), wanted
    return ["qid"], met, wanted


def _counted(queries: DataFrame, found: DataFrame, with_freqs: bool) -> DataFrame:
    """A row for every query, also for empty ones and those without a match."""
    counts = found.groupBy("qid").agg(F.count("*").alias("n"), F.sum("freqs").alias("freqs"))
    both = queries.select("qid").distinct().join(counts, "qid", "left")
    names = ["n", "freqs"] if with_freqs else ["n"]
    return both.select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def whole_candidates(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, doc_id, needed): documents that may hold every term of a query, for many short queries over short documents.

    A query meets the list of its rarest term only, and there the documents whose marks hold its own; few others do.
    """
    wanted = index.dealt(query_terms.select("qid", "term").distinct(), "qid")
    order = Window.partitionBy("qid").orderBy(F.coalesce("df", F.lit(0)), "term")
    rarest = marked(wanted, "qid").join(index.terms.select("term", "df"), "term", "left").withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    asks = rarest.select("qid", "term", F.col("n_terms").alias("needed"), F.col("mark1").alias("asks1"), F.col("mark2").alias("asks2"))
    lists = marked(index.postings.select("term", "doc_id"), "doc_id").drop("n_terms")
    return lists.join(asks, "term").filter("(asks1 & ~mark1) = 0 and (asks2 & ~mark2) = 0").select("qid", "doc_id", "needed")


def _held_whole(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, doc_id, freqs) of documents with every term: candidates met with all of them."""
    wanted = query_terms.select("qid", "term").distinct()
    met = whole_candidates(index, query_terms).join(wanted, "qid").join(index.postings, ["term", "doc_id"])
    return met.groupBy("qid", "doc_id").agg(F.count("*").alias("n_met"), F.first("needed").alias("needed"), F.sum("freq").alias("freqs")).filter("n_met = needed")


def and_count(index: Index, queries: DataFrame, query_terms: DataFrame, with_freqs: bool = False, short: bool = False) -> DataFrame:
    """Documents that hold every term. A term that no document holds leaves none; so does a query without terms.

    short is for many short queries over short documents, where pairs of both with a term in common are far more than either.
    """
    if short:
        return _counted(queries, _held_whole(index, query_terms), with_freqs)
    _, met, wanted = _matches(index, query_terms)
    needed = wanted.groupBy("qid").agg(F.count("*").alias("needed"))
    return _counted(queries, met.join(needed, "qid").filter("n_met = needed"), with_freqs)


def or_count(index: Index, queries: DataFrame, query_terms: DataFrame, with_freqs: bool = False) -> DataFrame:
    """Documents that hold any term."""
    return _counted(queries, _matches(index, query_terms)[1], with_freqs)


def sharded_and_count(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, shard_id, n): AND within each document range that has a match; the counts of a query add up to its AND count."""
    keys, met, wanted = _matches(index, query_terms, by_shard=True)
    needed = wanted.groupBy("qid").agg(F.count("*").alias("needed"))
    return met.join(needed, "qid").filter("n_met = needed").groupBy(*keys).agg(F.count("*").alias("n"))
