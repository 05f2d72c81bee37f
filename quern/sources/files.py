"""Readers of collections, queries and side files, and writers of results.

Text is read through Spark's own source and lines are numbered where they lie, so a file is cut among tasks however long it is; binary
files are read by byte ranges (see binary.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.codecs import vbyte
from quern.operators.index import Index
from quern.operators.schedule import running_total
from quern.session import checkpointed, ship
from quern.sources.binary import binary, joined, length_of, opened, write_binary


def binary_sequences(spark: SparkSession, path: str, dtype: str = "<u4") -> DataFrame:
    """(seq, pos, value): sequences of little-endian numbers, each after its length in 32 bits.

    Empty sequences are skipped and not counted; a last one that the file cuts short ends with the file.
    """
    return binary(spark, path, "sequences", dtype)


def binary_collection(spark: SparkSession, prefix: str, **more) -> Index:
    """The collection in prefix.docs, prefix.freqs and prefix.sizes; a term's number is its place among the non-empty lists."""
    found = binary_sequences(spark, f"{prefix}.docs")
    n_docs = found.filter("seq = 0").agg(F.count("*"), F.max("value")).first()
    if n_docs[0] != 1:
        raise ValueError("the first sequence must hold the number of documents, and nothing else")
    docs = found.filter("seq > 0").select((F.col("seq") - 1).alias("term"), "pos", F.col("value").alias("doc_id"))
    freqs = binary_sequences(spark, f"{prefix}.freqs").select(F.col("seq").alias("term"), "pos", F.col("value").alias("freq"))
    sizes = binary_sequences(spark, f"{prefix}.sizes").filter("seq = 0").select(F.col("pos").alias("doc_id"), F.col("value").alias("len"))
    return Index(docs.join(freqs, ["term", "pos"]).select("term", "doc_id", "freq"), sizes, **more)


def write_sequences(values: DataFrame, path: str, dtype: str = "<u4") -> None:
    """Writes rows (seq, pos, value) as one file of length-prefixed sequences, in the order of seq and pos.

    Tasks write parts of about equal size, which a long sequence may span. Rows may have the `length` of their sequence.
    """
    if "length" not in values.columns:
        values = values.join(values.groupBy("seq").agg(F.count("*").alias("length")), "seq")
    met = values.withColumn("length", F.when(F.col("pos") == 0, F.col("length")))
    write_binary(met.select("seq", "pos", "length", "value"), path, dtype, "seq", "pos")


def write_collection(index: Index, prefix: str) -> None:
    """Writes a collection whose terms and documents are numbered from 0 without gaps as prefix.docs, prefix.freqs and prefix.sizes."""
    spark = index.docs.sparkSession
    rows = index.positioned.select(F.col("term").alias("seq"), F.col("ordinal").alias("pos"), "doc_id", "freq")
    # Both files are made of the same places and lengths.
    rows = checkpointed(rows.join(index.terms.select(F.col("term").alias("seq"), F.col("df").alias("length")), "seq"))
    count = spark.createDataFrame([(-1, 0, 1, index.n_docs)], "seq long, pos long, length long, value long")
    write_sequences(count.union(rows.select(F.col("seq").cast("long"), F.col("pos").cast("long"), "length", F.col("doc_id").cast("long"))), f"{prefix}.docs")
    write_sequences(rows.select("seq", "pos", "length", F.col("freq").alias("value")), f"{prefix}.freqs")
    write_sequences(index.docs.select(F.lit(0).alias("seq"), F.col("doc_id").alias("pos"), F.col("len").alias("value")), f"{prefix}.sizes")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, or of a folder's files in the order of their names, numbered from 0.

    A task numbers the lines of the stretches of files that it reads; a table with a row for each stretch says where each begins.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    starts = checkpointed(stretches.select("file", "at", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return rows.join(starts, ["file", "at"]).select((F.col("start") + F.col("id") - F.col("least")).alias("line"), "value")


def query_file(spark: SparkSession, path: str, delimiter: str = r"\s+") -> DataFrame:
    """(qid, pos, term): a query a line, numbers apart by white space or, with "\\t", by tabs; other words are left out."""
    parts = F.filter(F.transform(F.split("value", delimiter), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull() & (x >= 0))
    return numbered_lines(spark, path).select(F.col("line").cast("long").alias("qid"), F.posexplode(parts).alias("pos", "term"))


def write_queries(queries: DataFrame, path: str, delimiter: str = "\t") -> None:
    """Writes queries (qid, terms) in the order of qid, a line each."""
    queries.orderBy("qid").select(F.array_join(F.transform("terms", lambda x: x.cast("string")), delimiter).alias("value")).write.text(path)


def query_terms(rows: DataFrame) -> DataFrame:
    """(qid, term, qtf) of rows (qid, term)."""
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of the batch that their query is in."""
    return rows.withColumn("batch_id", F.expr(f"qid div {size}"))


def list_lengths(spark: SparkSession, path: str, has_count: bool = True) -> DataFrame:
    """(term, length, offset) from unsigned 32-bit lengths, after the number of documents if there is one."""
    rows = binary(spark, path, "array", skip=4 * has_count).select(F.col("pos").alias("term"), F.col("value").alias("length"))
    return running_total(rows, [F.col("term")], "length", "offset").select("term", "length", "offset")


def write_lengths(lengths: DataFrame, path: str, n_docs: int | None = None) -> None:
    """Writes (term, length) in the order of terms, after n_docs if it is given."""
    rows = lengths.select(F.col("term").cast("long").alias("term"), F.col("length").cast("long").alias("value"))
    if n_docs is not None:
        rows = rows.union(rows.sparkSession.createDataFrame([(-1, n_docs)], "term long, value long"))
    write_binary(rows, path, "<u4", "term")


#: Heads that a task decodes.
HEADS = 1 << 14


def list_heads(spark: SparkSession, path: str, lengths: str) -> DataFrame:
    """(term, df, block_id, last_doc, start) of a file of heads, given the file of their lengths after the number of documents.

    A head is the number of postings in groups of seven bits, the last document of every block, and the start of every block but
    the first. A task reads the lengths of its own heads and then those.
    """
    ship(spark)
    n = length_of(lengths) // 4 - 1
    sums = binary(spark, lengths, "array", skip=4).select(F.expr(f"pos div {HEADS}").alias("chunk"), "value").groupBy("chunk").agg(F.sum("value").alias("bytes"))
    chunks = running_total(sums, [F.col("chunk")], "bytes", "at").select("chunk", "at").repartition(max(1, -(-n // HEADS)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for chunk, at in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                with opened(lengths) as f:
                    f.seek(4 + 4 * chunk * HEADS)
                    own = np.frombuffer(f.read(4 * min(HEADS, n - chunk * HEADS)), "<u4").astype(np.int64)
                with opened(path) as f:
                    f.seek(at)
                    for i, size in enumerate(own.tolist()):
                        data = f.read(size)
                        stop = next(k for k, b in enumerate(data) if b & 128) + 1
                        df = sum((b & 127) << 7 * k for k, b in enumerate(data[:stop]))
                        numbers = np.frombuffer(data[stop:], "<u4").astype(np.int64)
                        blocks = (len(numbers) + 1) // 2
                        starts = np.concatenate([[0], numbers[blocks:]])
                        columns = [np.full(blocks, chunk * HEADS + i), np.full(blocks, df), np.arange(blocks), numbers[:blocks], starts]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["term", "df", "block_id", "last_doc", "start"])

    return chunks.mapInArrow(run, "term long, df long, block_id long, last_doc long, start long")


def write_heads(blocks: DataFrame, path: str, lengths: str, n_docs: int) -> None:
    """Writes the heads of blocks (term, block_id, n, last_doc, bytes), and the file of their lengths."""
    ship(blocks.sparkSession)
    held = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list(F.struct("block_id", "last_doc", "bytes"))).alias("b"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            heads = []
            for df, last, size in zip(*[batch.column(i).to_pylist() for i in range(1, 4)], strict=True):
                heads.append(vbyte([df]) + np.array([*last, *np.cumsum(size[:-1]).tolist()], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["term", "head"])

    made = checkpointed(held.select(F.col("term").cast("long").alias("term"), F.col("df").cast("long").alias("df"), "b.last_doc", "b.bytes").mapInArrow(run, "term long, head binary"))
    write_binary(made, path, "bytes", "term")
    write_lengths(made.select("term", F.octet_length("head").alias("length")), lengths, n_docs)


def block_maxima(spark: SparkSession, path: str) -> DataFrame:
    """(term, block_id, max_weight, last_doc) of a file of a number, the first block of each term and the number of blocks, then every
    block's largest weight and last document; each array comes after its length in 64 bits."""
    with opened(path) as f:
        f.seek(8)
        n_starts = int.from_bytes(f.read(8), "little")
        f.seek(16 + 8 * n_starts)
        n = int.from_bytes(f.read(8), "little")
    at = 24 + 8 * n_starts
    starts = binary(spark, path, "array", "<u8", skip=16, count=n_starts).select(F.col("pos").alias("term"), F.col("value").alias("at"))
    weights = binary(spark, path, "array", "<f4", skip=at, count=n).select("pos", F.col("value").alias("max_weight"))
    docs = binary(spark, path, "array", "<u4", skip=at + 4 * n + 8, count=n).select("pos", F.col("value").alias("last_doc"))
    # The block of a term begins where its start is; starts and blocks are merged in ranges, and a running count says whose block it is.
    marks = starts.filter(F.col("term") < n_starts - 1).groupBy("at").agg(F.max("term").alias("term"))
    met = weights.join(docs, "pos").join(marks, F.col("pos") == F.col("at"), "left").withColumn("begins", F.when(F.col("term").isNotNull(), 1).otherwise(0).cast("long"))
    counted = running_total(met, [F.col("pos")], "begins", "before").withColumn("run", F.col("before") + F.col("begins"))
    runs = counted.filter("begins = 1").select("run", F.col("term").alias("its_term"), F.col("pos").alias("from"))
    return counted.join(runs, "run").select(F.col("its_term").alias("term"), (F.col("pos") - F.col("from")).alias("block_id"), "max_weight", "last_doc")


def write_block_maxima(blocks: DataFrame, path: str) -> None:
    """Writes blocks (term, block_id, max_weight, last_doc) of terms from 0 without gaps in the format that block_maxima() reads."""
    counts = blocks.groupBy("term").agg(F.count("*").alias("n"))
    starts = checkpointed(running_total(counts, [F.col("term")], "n", "value").select(F.col("term").cast("long").alias("term"), F.col("value").cast("long").alias("value"), "n"))
    n_terms, n = starts.agg(F.count("*"), F.sum("n")).first()
    write_binary(starts.select("term", "value").union(starts.sparkSession.createDataFrame([(n_terms, n or 0)], "term long, value long")), f"{path}.starts", "<u8", "term")
    write_binary(blocks.select("term", "block_id", F.col("max_weight").alias("value")), f"{path}.weights", "<f4", "term", "block_id")
    write_binary(blocks.select("term", "block_id", F.col("last_doc").alias("value")), f"{path}.last", "<u4", "term", "block_id")
    for name, numbers in (("head", (0, n_terms + 1)), ("count", (n or 0,)), ("again", (n or 0,))):
        with opened(f"{path}.{name}", "wb") as f:
            f.write(np.array(numbers, "<u8").tobytes())
    joined([f"{path}.{x}" for x in ("head", "starts", "count", "weights", "again", "last")], path)


#: Fixed value: the records of a file of splits, a block and an offset that nothing reads.
SPLIT = "split_block:<u4|offset:<i8"


def split_info(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """(term, shard_id, split_block): for every shard after the other the first block of each term; it may lie behind the last one."""
    n_terms = length_of(path) // 12 // shards
    return binary(spark, path, "array", SPLIT).select(F.expr(f"pos % {n_terms}").alias("term"), F.expr(f"cast(pos div {n_terms} as int)").alias("shard_id"), "split_block")


def write_split_info(splits: DataFrame, path: str) -> None:
    """Writes (term, shard_id, split_block) in the format that split_info() reads."""
    write_binary(splits.select("shard_id", "term", "split_block", F.lit(0).cast("long").alias("offset")), path, SPLIT, "shard_id", "term")


def term_info(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, topk_score, max_score): a term a line, in the order of the file."""
    part = lambda i, kind: F.try_element_at(F.split("value", ","), F.lit(i)).try_cast(kind)
    return numbered_lines(spark, path).select(F.col("line").alias("term"), part(1, "long").alias("df"), part(2, "double").alias("topk_score"), part(3, "double").alias("max_score"))


def numbered_values(spark: SparkSession, path: str, name: str, kind: str = "double", key: str = "qid") -> DataFrame:
    """(key, name): a number a line: thread counts, sample times, thresholds of terms."""
    return numbered_lines(spark, path).select(F.col("line").alias(key), F.trim("value").try_cast(kind).alias(name))


def shard_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(term, shard_id, thresh): a term a line, a tab between shards."""
    rows = numbered_lines(spark, path).select(F.col("line").alias("term"), F.posexplode(F.split(F.regexp_replace("value", r"\t+$", ""), "\t")).alias("shard_id", "v"))
    return rows.select("term", "shard_id", F.col("v").try_cast("double").alias("thresh"))


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Writes the column value as lines, in the order of the columns that order names; tasks write one range each."""
    rows.orderBy(*order).select(F.col("value").cast("string")).write.text(path)


def thread_label(threads: Column) -> Column:
    """1, 2, 4 and 8 threads as classes 0 to 3; null for others."""
    return F.when(threads.isin(1, 2, 4, 8), F.log2(threads).cast("int"))


def write_counts(counts: DataFrame, path: str) -> None:
    """A count a line, in the order of queries."""
    counts.orderBy("qid").select(F.col("n").cast("string").alias("value")).write.text(path)


def write_scores(ranked: DataFrame, queries: DataFrame, path: str) -> None:
    """The scores of a query, best first and apart by blanks, a line for each query; empty for those without results."""
    lines = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(-F.col("rank"), F.col("score").alias("score"))), asc=False).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["score"].cast("string")), " ")
    queries.select("qid").distinct().join(lines, "qid", "left").orderBy("qid").select(F.coalesce(text, F.lit("")).alias("value")).write.text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows without a header, in the order of queries."""
    features.orderBy("qid").drop("qid").write.csv(path)


def write_reordered(order: DataFrame, queries: DataFrame, path: str) -> None:
    """Appends the queries (qid, terms) in their new order, terms apart by tabs."""
    met = order.join(queries, "qid").orderBy("position")
    met.select(F.array_join(F.transform("terms", lambda x: x.cast("string")), "\t").alias("value")).write.mode("append").text(path)


def stats_json(row: DataFrame) -> DataFrame:
    """A line of JSON for each row."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def dense_terms(terms: DataFrame) -> DataFrame:
    """(term, term_id): numbers without gaps in the order of terms, dealt by range and not in one task."""
    return running_total(terms.select("term").distinct().withColumn("one", F.lit(1).cast("long")), [F.col("term")], "one", "term_id").select("term", "term_id")
