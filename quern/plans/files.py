"""Registered queries over files: what is written in each format and read back again.

Files lie in the shared folder and go when a query is done; its result is checkpointed before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators import boolean, cache, features, index as ix, ranked, schedule
from quern.operators.index import Index
from quern.plans.workload import basket_index, text_index, text_queries, text_query_terms
from quern.session import checkpointed, scratch
from quern.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Queries of a batch, and digits of results.
BATCH, DIGITS = 16, 6


def filed(f: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    """Registers a query that also gets a folder of its own."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, f.__name__) as folder:
            return checkpointed(f(spark, sf_dir, folder))

    QUERIES[f.__name__] = run
    return run


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def _numbered(own: Index) -> DataFrame:
    """(term, term_id), numbered in the order of terms."""
    return checkpointed(files.dense_terms(own.terms))


def numbered_collection(own: Index) -> Index:
    """The collection with terms and documents numbered from 0 without gaps, in their own order."""
    docs = _numbered_docs(own)
    postings = own.postings.join(_numbered(own), "term").join(docs, "doc_id").select(F.col("term_id").alias("term"), F.col("number").alias("doc_id"), "freq")
    return Index(checkpointed(postings), docs.select(F.col("number").alias("doc_id"), "len"), parts=own.parts)


def _numbered_docs(own: Index) -> DataFrame:
    """docs with their number from 0 without gaps, in their own order."""
    docs = files.dense_terms(own.docs.select(F.col("doc_id").alias("term"))).select(F.col("term").alias("doc_id"), F.col("term_id").alias("number"))
    return checkpointed(own.docs.join(docs, "doc_id"))


@filed
def collection_file(spark, sf_dir, folder):
    """The basket collection through the three files of a collection and back."""
    files.write_collection(numbered_collection(basket_index(spark, sf_dir)), f"{folder}/c")
    return files.binary_collection(spark, f"{folder}/c").postings


@filed
def collection_sizes_file(spark, sf_dir, folder):
    own = basket_index(spark, sf_dir)
    files.write_sequences(_numbered_docs(own).select(F.lit(0).alias("seq"), F.col("number").alias("pos"), F.col("len").alias("value")), f"{folder}/c.sizes")
    read = files.binary_sequences(spark, f"{folder}/c.sizes").select(F.col("pos").alias("doc_id"), F.col("value").alias("len"))
    return _rounded(Index(own.postings, read).lengths, "norm_len")


def _query_lists(spark, sf_dir) -> DataFrame:
    """(qid, terms): the numbers of each benchmark item's known words in order, queries numbered from 0."""
    own = text_index(spark, sf_dir)
    known = text_query_terms(spark, sf_dir).join(_numbered(own), "term").groupBy("qid").agg(F.sort_array(F.collect_list("term_id")).alias("terms"))
    order = files.dense_terms(text_queries(spark, sf_dir).select(F.col("qid").alias("term"))).select(F.col("term").alias("qid"), F.col("term_id").alias("place"))
    return order.join(known, "qid", "left").select(F.col("place").alias("qid"), F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))


@filed
def query_files(spark, sf_dir, folder):
    """Queries as lines apart by tabs and by blanks, read in batches."""
    lists = checkpointed(_query_lists(spark, sf_dir))
    files.write_queries(lists, f"{folder}/tabs")
    files.write_queries(lists, f"{folder}/blanks", " ")
    read = [files.query_file(spark, f"{folder}/{kind}", by).withColumn("kind", F.lit(kind)) for kind, by in (("tabs", "\t"), ("blanks", r"\s+"))]
    return files.batches(read[0].union(read[1]).select("kind", "qid", F.col("pos").cast("long").alias("pos"), "term"), BATCH)


def _sizes(own: Index) -> DataFrame:
    return schedule.list_bytes(own).join(_numbered(own), "term").select(F.col("term_id").alias("term"), F.col("list_bytes").alias("length"))


@filed
def list_length_file(spark, sf_dir, folder):
    own = text_index(spark, sf_dir)
    files.write_lengths(_sizes(own), f"{folder}/lengths", own.n_docs)
    return files.list_lengths(spark, f"{folder}/lengths")


def _blocks(own: Index) -> DataFrame:
    return own.blocks.join(_numbered(own), "term").drop("term").withColumnRenamed("term_id", "term")


@filed
def list_head_file(spark, sf_dir, folder):
    own = text_index(spark, sf_dir)
    files.write_heads(_blocks(own), f"{folder}/heads", f"{folder}/lengths", own.n_docs)
    return files.list_heads(spark, f"{folder}/heads", f"{folder}/lengths")


@filed
def block_max_file(spark, sf_dir, folder):
    files.write_block_maxima(_blocks(text_index(spark, sf_dir)), f"{folder}/maxima")
    return _rounded(files.block_maxima(spark, f"{folder}/maxima"), "max_weight")


@filed
def split_info_file(spark, sf_dir, folder):
    """A list that ends before the shard has the place after its last block."""
    own = text_index(spark, sf_dir)
    ends = own.blocks.groupBy("term").agg(F.count("*").alias("n"))
    rows = ix.shard_splits(own).join(ends, "term").join(_numbered(own), "term").select(F.col("term_id").alias("term"), "shard_id", F.coalesce("split_block", "n").cast("long").alias("split_block"))
    files.write_split_info(rows, f"{folder}/splits")
    return files.split_info(spark, f"{folder}/splits", own.shards)


@filed
def block_endpoint_file(spark, sf_dir, folder):
    own = text_index(spark, sf_dir)
    ends = schedule.block_endpoints(own).join(_numbered(own), "term").select(F.col("term_id").alias("seq"), F.col("block_id").alias("pos"), F.col("endpoint").alias("value"))
    files.write_sequences(ends, f"{folder}/endpoints")
    return files.binary_sequences(spark, f"{folder}/endpoints").select(F.col("seq").alias("term"), F.col("pos").alias("block_id"), F.col("value").alias("endpoint"))


@filed
def posting_score_file(spark, sf_dir, folder):
    """The score of every posting for a single occurrence of its term, kept in 32 bits."""
    own = text_index(spark, sf_dir)
    units = own.terms.select("term", F.col("df").alias("length"), own.unit_weight(F.col("df")).alias("unit")).join(_numbered(own), "term")
    rows = own.positioned.join(units, "term").select(F.col("term_id").alias("seq"), F.col("ordinal").alias("pos"), "length", (F.col("unit") * F.col("weight")).alias("value"))
    files.write_sequences(rows, f"{folder}/scores", "<f4")
    read = files.binary_sequences(spark, f"{folder}/scores", "<f4")
    return read.select(F.col("seq").alias("term"), F.col("pos").alias("ordinal"), F.round("value", DIGITS).alias("score"))


def _per_query(spark, sf_dir, value: str) -> DataFrame:
    places = files.dense_terms(text_queries(spark, sf_dir).select(F.col("qid").alias("term")))
    return places.select("term_id", F.expr(value).alias("value"))


@filed
def thread_file(spark, sf_dir, folder):
    """Numbers of threads, a line for each query, and the classes that they are."""
    files.write_lines(_per_query(spark, sf_dir, "1 + term % 8"), f"{folder}/threads", "term_id")
    return files.numbered_values(spark, f"{folder}/threads", "threads", "int").select("qid", "threads", files.thread_label(F.col("threads")).alias("label"))


def _info(own: Index, ids: DataFrame) -> DataFrame:
    unit = own.unit_weight(F.col("df"))
    return own.terms.join(own.thresholds(), "term").join(ids, "term").select("term_id", "df", F.col("thresh").alias("topk_score"), (unit * F.col("max_weight")).alias("max_score"))


@filed
def term_info_file(spark, sf_dir, folder):
    own = text_index(spark, sf_dir)
    files.write_lines(_info(own, _numbered(own)).withColumn("value", F.concat_ws(",", "df", "topk_score", "max_score")), f"{folder}/info", "term_id")
    return _rounded(files.term_info(spark, f"{folder}/info"), "topk_score", "max_score")


@filed
def term_info_inconsistent(spark, sf_dir, folder):
    """Stated term data of which every hundredth row is made wrong, in one column or another; those rows are found."""
    own = text_index(spark, sf_dir)
    ids = _numbered(own)
    wrong = lambda c, turn, by: F.when(F.col("term_id") % 300 == turn, F.col(c) + by).otherwise(F.col(c))
    rows = _info(own, ids).withColumns({"df": wrong("df", 0, 1), "topk_score": wrong("topk_score", 100, 0.5), "max_score": wrong("max_score", 200, 0.5)})
    files.write_lines(rows.withColumn("value", F.concat_ws(",", "df", "topk_score", "max_score")), f"{folder}/info", "term_id")
    stated = files.term_info(spark, f"{folder}/info").withColumnRenamed("term", "term_id").join(ids, "term_id").drop("term_id")
    return features.inconsistent(own, stated).select("term")


@filed
def threshold_files(spark, sf_dir, folder):
    """Thresholds of terms, and of terms by shard."""
    own = text_index(spark, sf_dir)
    ids = _numbered(own)
    files.write_lines(own.thresholds().join(ids, "term").withColumn("value", F.col("thresh")), f"{folder}/terms", "term_id")
    by_shard = own.thresholds(by_shard=True).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("shard_id", "thresh"))).alias("s"))
    files.write_lines(by_shard.join(ids, "term").withColumn("value", F.array_join(F.transform("s.thresh", lambda x: x.cast("string")), "\t")), f"{folder}/shards", "term_id")
    both = files.shard_thresholds(spark, f"{folder}/shards").withColumnRenamed("thresh", "shard_thresh")
    return _rounded(both.join(files.numbered_values(spark, f"{folder}/terms", "thresh", key="term"), "term"), "thresh", "shard_thresh")


@filed
def frozen_index(spark, sf_dir, folder):
    """A ranked query over a collection that was saved and loaded."""
    text_index(spark, sf_dir).save(f"{folder}/index")
    return ranked.topk(Index.load(spark, f"{folder}/index"), text_query_terms(spark, sf_dir))


@filed
def counts_file(spark, sf_dir, folder):
    counts = boolean.and_count(text_index(spark, sf_dir), text_queries(spark, sf_dir), text_query_terms(spark, sf_dir))
    files.write_counts(counts, f"{folder}/counts")
    return files.numbered_values(spark, f"{folder}/counts", "n", "long", "place")


@filed
def scores_file(spark, sf_dir, folder):
    """The scores of ranked queries as lines, from the exhaustive plan and from that with bounds of blocks."""
    own, asked, queries = text_index(spark, sf_dir), text_query_terms(spark, sf_dir), text_queries(spark, sf_dir)
    read = []
    for strategy in ("exhaustive", "bmw"):
        files.write_scores(ranked.topk(own, asked, strategy=strategy), queries, f"{folder}/{strategy}")
        lines = files.numbered_lines(spark, f"{folder}/{strategy}")
        read.append(lines.select(F.lit(strategy).alias("strategy"), F.col("line").alias("place"), F.posexplode(F.split("value", " ")).alias("at", "score")))
    return read[0].union(read[1]).select("strategy", "place", "at", F.col("score").try_cast("double").alias("score"))


@filed
def features_file(spark, sf_dir, folder):
    """The 54 features of every query, sample times among them, as a file without names; read back as (place, at, value)."""
    files.write_lines(_per_query(spark, sf_dir, "term % 7 * 0.25"), f"{folder}/times", "term_id")
    places = files.dense_terms(text_queries(spark, sf_dir).select(F.col("qid").alias("term"))).select(F.col("term").alias("real"), F.col("term_id").alias("qid"))
    times = files.numbered_values(spark, f"{folder}/times", "time").join(places, "qid").select(F.col("real").alias("qid"), "time")
    files.write_features(features.query_features(text_index(spark, sf_dir), text_query_terms(spark, sf_dir), times), f"{folder}/features")
    lines = files.numbered_lines(spark, f"{folder}/features")
    return lines.select(F.col("line").alias("place"), F.posexplode(F.split("value", ",")).alias("at", "value")).select("place", "at", F.round(F.col("value").try_cast("double"), DIGITS).alias("value"))


@filed
def reordered_file(spark, sf_dir, folder):
    """Queries written in another order, the longest first, and read in that order."""
    lists = checkpointed(_query_lists(spark, sf_dir))
    order = files.dense_terms(lists.select(F.struct(-F.size("terms"), "qid").alias("term"))).select(F.col("term.qid").alias("qid"), F.col("term_id").alias("position"))
    files.write_reordered(order, lists, f"{folder}/order")
    return files.query_file(spark, f"{folder}/order", "\t").select(F.col("qid").alias("position"), F.col("pos").cast("long").alias("pos"), "term")


@filed
def stats_lines(spark, sf_dir, folder):
    """What is known of every document's length, as lines of JSON."""
    files.stats_json(text_index(spark, sf_dir).docs.select("doc_id", "len")).write.text(f"{folder}/stats")
    return spark.read.text(f"{folder}/stats")


@filed
def ranked_tf_idf(spark, sf_dir, folder):
    """A ranked query with another scorer."""
    own = text_index(spark, sf_dir)
    return ranked.topk(Index(own.postings, own.docs, scorer=scoring.TfIdf()), text_query_terms(spark, sf_dir))


def _accesses(spark, sf_dir) -> DataFrame:
    """(seq, key, bytes): every list that the queries read, in the order of queries and terms."""
    own, asked = text_index(spark, sf_dir), text_query_terms(spark, sf_dir)
    sizes = schedule.list_bytes(own.only(asked)).join(_numbered(own), "term").select("term", "term_id", "list_bytes")
    rows = asked.join(sizes, "term")
    return files.dense_terms(rows.select(F.struct("qid", "term_id", "list_bytes").alias("term"))).select(F.col("term_id").alias("seq"), F.col("term.term_id").cast("string").alias("key"), F.col("term.list_bytes").alias("bytes"))


@filed
def lru_trace(spark, sf_dir, folder):
    """Whether each of the first hundred accesses of a cache finds its list, with a planner that fetches every third list ahead."""
    rows = _accesses(spark, sf_dir).filter("seq < 100")
    order = Window.orderBy("seq")
    ahead = rows.withColumn("next", F.lead("key", 2).over(order)).withColumn("next_bytes", F.lead("bytes", 2).over(order))
    asked = rows.select((F.col("seq") * 2).alias("seq"), "key", "bytes", F.lit(False).alias("prefetch"))
    fetched = ahead.filter("seq % 3 = 0 and next is not null").select((F.col("seq") * 2 + 1).alias("seq"), F.col("next").alias("key"), F.col("next_bytes").alias("bytes"), F.lit(True).alias("prefetch"))
    own = asked.union(fetched).withColumn("config", F.lit("ahead")).withColumn("budget", F.lit(2_000).cast("long"))
    return cache.simulate(own, trace=True).select("seq", "hit")
