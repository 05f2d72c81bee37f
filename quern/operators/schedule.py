"""Tasks, reads and look-ahead of a query run, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.sizes import DISK_BLOCK, read_unit, vbyte_bytes
from quern.operators.index import Index, parts_of, shard_splits
from quern.session import checkpointed


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all earlier rows of a total order, without sorting everything in one task.

    Rows are dealt by range; each range adds up its own, and the ranges' totals, a row for each partition, are added up.
    """
    dealt = checkpointed(df.repartitionByRange(parts_of(df), *order).withColumn("__range", F.spark_partition_id()))
    before = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = before.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(before, "__range")
    return met.withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def list_bytes(index: Index) -> DataFrame:
    """(term, df, n_blocks, list_bytes): a df, for each block its last document and, but for the first, its place, and the blocks."""
    rows = index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_blocks"), F.sum("bytes").alias("payload"))
    return rows.select("term", "df", "n_blocks", (vbyte_bytes(F.col("df")) + 8 * F.col("n_blocks") - 4 + F.col("payload")).alias("list_bytes"))


def list_offsets(index: Index) -> DataFrame:
    """list_bytes() with `offset`, where the list begins if lists follow each other in the order of terms."""
    return running_total(list_bytes(index), [F.col("term")], "list_bytes", "offset")


def block_endpoints(index: Index) -> DataFrame:
    """(term, block_id, endpoint): bytes of the list up to the end of the block."""
    order = Window.partitionBy("term").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    return index.blocks.select("term", "block_id", F.sum("bytes").over(order).alias("endpoint"))


def reads(index: Index, fixed_unit: int | None = None) -> DataFrame:
    """(term, shard_id, list_length, read_offset, skip, read_unit, read_length): what a shard reads of a list.

    It begins with the block before whose end the shard begins, ends with the block in which the next shard begins, and is
    aligned to disk blocks. Lists that end before the shard have no row.
    """
    splits = shard_splits(index)
    ends = block_endpoints(index)
    sizes = list_offsets(index).select("term", "offset").join(ends.groupBy("term").agg(F.max("endpoint").alias("whole")), "term")
    order = Window.partitionBy("term").orderBy("shard_id")
    spans = splits.withColumn("next_split", F.lead("split_block").over(order)).filter("split_block is not null")
    starts = ends.select("term", (F.col("block_id") + 1).alias("split_block"), F.col("endpoint").alias("start"))
    stops = ends.select("term", F.col("block_id").alias("next_split"), F.col("endpoint").alias("stop"))
    met = spans.join(starts, ["term", "split_block"], "left").join(stops, ["term", "next_split"], "left").join(sizes, "term")
    start = F.coalesce("start", F.lit(0))
    rows = met.select("term", "shard_id", (F.coalesce("stop", "whole") - start).alias("list_length"), (F.col("offset") + start).alias("at"))
    rows = rows.withColumn("read_offset", F.expr(f"at div {DISK_BLOCK} * {DISK_BLOCK}")).withColumn("skip", F.col("at") - F.col("read_offset")).withColumn("read_unit", read_unit(F.col("list_length"), fixed_unit))
    return rows.withColumn("read_length", F.expr("(list_length + skip + read_unit - 1) div read_unit * read_unit")).drop("at")


def shard_scores(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, shard_id, shard_score): the best k-th score that a term of the query has within the shard."""
    added = query_terms.groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    met = added.join(index.only(added).thresholds(by_shard=True), "term")
    return met.groupBy("qid", "shard_id").agg(F.max(F.col("thresh") * F.col("qtf")).alias("shard_score"))


def tasks(scores: DataFrame, assigned: DataFrame, scale: int = 6) -> DataFrame:
    """(qid, task_no, shard_ids): a query's shards, best first, dealt in turn to as many tasks as assigned(qid, threads) says."""
    order = Window.partitionBy("qid").orderBy(F.round("shard_score", scale).desc(), "shard_id")
    dealt = scores.join(assigned, "qid").withColumn("turn", F.row_number().over(order) - 1).withColumn("task_no", (F.col("turn") % F.col("threads")).cast("int"))
    lists = dealt.groupBy("qid", "task_no").agg(F.sort_array(F.collect_list(F.struct("turn", "shard_id"))).alias("s"))
    return lists.select("qid", "task_no", F.col("s.shard_id").alias("shard_ids"))


def lookahead(query_terms: DataFrame, ahead: int) -> DataFrame:
    """(qid, term, n, rank): how many of the query itself and the next ahead - 1 ones hold the term, the most wanted lists first."""
    wanted = query_terms.select("qid", "term").distinct()
    seen_from = wanted.select(F.explode(F.sequence(F.col("qid") - (ahead - 1), F.col("qid"))).alias("qid"), "term")
    counts = seen_from.join(wanted.select("qid").distinct(), "qid", "left_semi").groupBy("qid", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "term")))


def warmup(sizes: DataFrame, budget: int) -> DataFrame:
    """(term, list_bytes, before): the largest lists, taken while what came before is less than the budget."""
    total = running_total(sizes.select("term", "list_bytes"), [F.col("list_bytes").desc(), F.col("term")], "list_bytes", "before")
    return total.filter(F.col("before") < budget)


#: Hundredths, and tenths of them, at which latencies are reported.
QUANTILES = (25.0, 50.0, 75.0, 95.0, 99.0, 99.9)


def latency_quantiles(rows: DataFrame, value: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(quantile, latency): the value at place floor(p * n / 100) of the sorted ones, without interpolation; the mean at 0.

    Equal values are counted first, so only distinct ones are put in order, by range.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("latency")).agg(F.count("*").alias("n"))
    placed = checkpointed(running_total(counts, [F.col("latency")], "n", "before"))
    n, total = placed.agg(F.sum("n"), F.sum(F.col("n") * F.col("latency"))).first()
    if not n:
        return placed.select(F.lit(0.0).alias("quantile"), "latency").limit(0)
    places = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(min(int(round(q * 10)) * n // 1000, n - 1)).alias("place")) for q in quantiles])
    hit = placed.select("latency", "before", "n", F.explode(places).alias("q")).filter("q.place >= before and q.place < before + n")
    mean = placed.sparkSession.range(1).select(F.lit(0.0).alias("quantile"), F.lit(total / n).alias("latency"))
    return hit.select("q.quantile", "latency").union(mean)


def throughput(n_queries: Column, elapsed_us: Column) -> Column:
    """Queries a second."""
    return n_queries / elapsed_us * 1e6
