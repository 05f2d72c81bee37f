"""A query log as a stream: ranked results for each micro-batch, counts by event time, and a cache that lives across batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.cache import ListCache
from quern.operators.index import Index
from quern.operators.ranked import topk
from quern.session import ship


def and_counts(log: DataFrame, index: Index) -> DataFrame:
    """(qid, term, n): for each term event of the log (qid, term, ...) its list's length; a stream joined with a table."""
    return log.join(index.terms.select("term", "df"), "term").select("qid", "term", F.col("df").alias("n"))


def windowed_terms(log: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """(start, term, n): how often terms are asked for in windows of event time; rows later than the delay are left out."""
    rows = log.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "term").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "term", "n")


def ranked_batches(log: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, **options) -> StreamingQuery:
    """Runs topk() for the queries (qid, term) of each micro-batch and hands the result to sink with the batch's number.

    The checkpoint makes every query arrive at the sink at least once, and the number tells a repeated batch.
    """

    def run(rows: DataFrame, batch: int) -> None:
        asked = rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        sink(topk(index, asked, k), batch)

    writer = log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def cached_hits(log: DataFrame, budget: int) -> DataFrame:
    """(config, hits, misses, miss_bytes) so far, after each micro-batch of accesses (config, seq, key, bytes).

    The cache of a configuration is its state: the held lists with their bytes, in the order of their last use.
    """
    ship(log.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = ListCache(budget)
        if state.exists:
            keys, sizes, cache.hits, cache.misses, cache.miss_bytes = state.get
            cache.held.update(zip(keys, sizes, strict=True))
            cache.used = sum(sizes)
        for rows in batches:
            rows = rows.sort_values("seq")
            for name, size in zip(rows["key"], rows["bytes"], strict=True):
                cache.get(name, int(size))
        state.update((list(cache.held), list(cache.held.values()), cache.hits, cache.misses, cache.miss_bytes))
        yield pd.DataFrame({"config": [key[0]], "hits": [cache.hits], "misses": [cache.misses], "miss_bytes": [cache.miss_bytes]})

    held = "keys array<string>, sizes array<bigint>, hits long, misses long, miss_bytes long"
    return log.groupBy("config").applyInPandasWithState(run, "config string, hits long, misses long, miss_bytes long", held, "update", GroupStateTimeout.NoTimeout)
