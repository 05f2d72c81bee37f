"""Registered queries over streams: a log that lies in files, read until its end, and results that every batch writes to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.files import _accesses, filed, QUERIES as FILED
from quern.plans.workload import text_index, text_query_terms
from quern.streaming import log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Bytes of the cache that lives across batches.
BUDGET = 20_000


def streamed(f) -> Query:
    QUERIES[f.__name__] = filed(f)
    del FILED[f.__name__]
    return QUERIES[f.__name__]


def _log(rows: DataFrame, folder: str, *by: str, parts: int = 2) -> DataFrame:
    """rows as a stream of files, one in a batch."""
    rows.repartition(parts, *by).write.parquet(f"{folder}/log")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


def _written(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to a folder named by its number, so that a repeated batch takes the place of the first."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/{batch}")


def _finished(df: DataFrame, folder: str, mode: str) -> DataFrame:
    df.writeStream.foreachBatch(_written(folder)).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out/*")


@streamed
def streamed_topk(spark, sf_dir, folder):
    """Ranked results of a query log, batch by batch."""
    asked = text_query_terms(spark, sf_dir).select("qid", "term", F.explode(F.array_repeat(F.lit(1), F.col("qtf").cast("int"))).alias("one")).drop("one")
    stream = _log(asked, folder, "qid")
    log.ranked_batches(stream, text_index(spark, sf_dir), _written(folder), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


@streamed
def streamed_list_lengths(spark, sf_dir, folder):
    """The list length of every term that the log asks for: a stream joined with a table."""
    stream = _log(text_query_terms(spark, sf_dir).select("qid", "term"), folder, "qid")
    return _finished(log.and_counts(stream, text_index(spark, sf_dir)), folder, "append")


@streamed
def streamed_cache(spark, sf_dir, folder):
    """Hits and misses of a cache whose lists stay from batch to batch; the log is cut in the middle, in the order of its time."""
    rows = _accesses(spark, sf_dir).withColumn("config", F.lit("stream"))
    half = rows.count() // 2
    rows.filter(F.col("seq") < half).coalesce(1).write.parquet(f"{folder}/log")
    rows.filter(F.col("seq") >= half).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    steps = _finished(log.cached_hits(stream, BUDGET), folder, "update")
    return steps.groupBy("config").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"), F.max("miss_bytes").alias("miss_bytes"))


@streamed
def streamed_event_counts(spark, sf_dir, folder):
    """Events of each type by hour. A window that a later batch adds to is written again, and counts only grow."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "event[s].parquet"))
    counts = log.windowed_terms(rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("term")), "ts", "1 hour", "1 hour")
    steps = _finished(counts, folder, "update")
    return steps.groupBy(F.col("start").cast("timestamp_ntz").alias("hour"), F.col("term").alias("event_type")).agg(F.max("n").alias("n"))
