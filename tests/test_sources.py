"""Files in the formats of collections, queries and results."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from quern.operators import ranked
from quern.sources import files
from quern.sources.binary import BinaryReader
from quern.streaming import log


def sequences(path, *lists, cut=0):
    data = b"".join(struct.pack(f"<{len(x) + 1}I", len(x), *x) for x in lists)
    path.write_bytes(data[: len(data) - cut])


def test_binary_collection(spark, tmp_path):
    sequences(tmp_path / "c.docs", [4], [0, 2, 3], [], [1, 4_000_000_000])
    sequences(tmp_path / "c.freqs", [1, 2, 1], [], [5, 1])
    sequences(tmp_path / "c.sizes", [3, 1, 4, 2])
    index = files.binary_collection(spark, str(tmp_path / "c"))
    assert sorted(index.postings.collect()) == [(0, 0, 1), (0, 2, 2), (0, 3, 1), (1, 1, 5), (1, 4_000_000_000, 1)]
    assert sorted(index.docs.collect()) == [(0, 3), (1, 1), (2, 4), (3, 2)]


def test_short_and_wrong_files(spark, tmp_path):
    sequences(tmp_path / "s", [1, 2], [3, 4, 5], cut=4)
    got = files.binary_sequences(spark, str(tmp_path / "s")).select("seq", "value").orderBy("seq", "pos").collect()
    assert got == [(0, 1), (0, 2), (1, 3), (1, 4)]
    for name in ("docs", "freqs", "sizes"):
        sequences(tmp_path / f"w.{name}", [1, 2])
    with pytest.raises(ValueError):
        files.binary_collection(spark, str(tmp_path / "w"))


def test_written_sequences_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 8), (0, 0, 5), (1, 0, 7)], "seq int, pos int, value long")
    files.write_sequences(rows, str(tmp_path / "x"))
    got = files.binary_sequences(spark, str(tmp_path / "x")).select("seq", "value").orderBy("seq", "pos").collect()
    assert got == [(0, 5), (1, 7), (1, 8)] and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_ranges_cut_files_anywhere(tmp_path):
    """Files of sequences of all lengths, some cut short, read in ranges of all sizes, against one pass over the bytes."""
    rng = random.Random(1)
    for _ in range(100):
        lists = [[rng.randrange(1000) for _ in range(rng.choice((0, 1, 3, 20, 200)))] for _ in range(rng.randrange(1, 20))]
        sequences(tmp_path / "r", *lists, cut=rng.choice((0, 0, 2, 5, 9)))
        data, want, at, seq = (tmp_path / "r").read_bytes(), [], 0, 0
        while at + 4 <= len(data):
            n = min(int.from_bytes(data[at : at + 4], "little"), (len(data) - at - 4) // 4)
            want += [(seq, p, int.from_bytes(data[at + 4 + 4 * p : at + 8 + 4 * p], "little")) for p in range(n)]
            seq, at = seq + (n > 0), at + 4 + 4 * n
        for part in (16, 40, 100, 1 << 20):
            reader = BinaryReader({"path": str(tmp_path / "r"), "kind": "sequences", "dtype": "<u4", "part": str(part)})
            pieces = reader.partitions()
            assert [x for p in pieces for b in reader.read(p) for x in zip(*[c.to_pylist() for c in b.columns])] == want
            assert part > 40 or len(pieces) >= len(data) // (2 * part + 8)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"part-{i}").write_text("".join(f"{i}-{k}\n" for k in range(500 * i + 10)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "t"))
        rows = got.orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in rows] == list(range(10 + 510 + 1010)) and [r.value for r in rows] == [f"{i}-{k}" for i in range(3) for k in range(500 * i + 10)]


def test_query_files(spark, tmp_path):
    (tmp_path / "q").write_text("3 1 2\n\n7  7 x -4\n")
    got = files.query_file(spark, str(tmp_path / "q")).orderBy("qid", "pos").collect()
    assert [(r.qid, r.term) for r in got] == [(0, 3), (0, 1), (0, 2), (2, 7), (2, 7)]
    assert (2, 7, 2) in files.query_terms(files.query_file(spark, str(tmp_path / "q"))).collect()
    (tmp_path / "t").write_text("3\t1\n9\n")
    assert files.query_file(spark, str(tmp_path / "t"), "\t").count() == 3


def test_side_files(spark, tmp_path):
    (tmp_path / "l").write_bytes(struct.pack("<4I", 99, 5, 6, 7))
    assert sorted(files.list_lengths(spark, str(tmp_path / "l")).collect()) == [(0, 5, 0), (1, 6, 5), (2, 7, 11)]
    (tmp_path / "i").write_text("3,1.5,2.5\n4,0,1\n")
    assert sorted(files.term_info(spark, str(tmp_path / "i")).collect()) == [(0, 3, 1.5, 2.5), (1, 4, 0.0, 1.0)]
    (tmp_path / "n").write_text("1\n4\n")
    assert sorted(files.numbered_values(spark, str(tmp_path / "n"), "threads", "int").collect()) == [(0, 1), (1, 4)]
    (tmp_path / "h").write_text("0.5\t1\t\n2\t3\n")
    assert sorted(files.shard_thresholds(spark, str(tmp_path / "h")).collect()) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0)]
    labels = spark.createDataFrame([(x,) for x in (1, 2, 4, 8, 3)], "t int").select(files.thread_label(F.col("t"))).collect()
    assert [r[0] for r in labels] == [0, 1, 2, 3, None]


def read(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_sinks(spark, tmp_path):
    files.write_counts(spark.createDataFrame([(1, 5), (0, 3)], "qid long, n long"), str(tmp_path / "counts"))
    assert read(tmp_path / "counts") == ["3", "5"]
    top = spark.createDataFrame([(0, 2, 8, 1.5), (0, 1, 9, 2.5)], "qid long, rank int, doc_id long, score double")
    files.write_scores(top, spark.createDataFrame([(0,), (1,)], "qid long"), str(tmp_path / "scores"))
    assert read(tmp_path / "scores") == ["2.5 1.5", ""]
    order = spark.createDataFrame([(0, 1), (1, 0)], "position long, qid long")
    queries = spark.createDataFrame([(0, [3, 4]), (1, [5])], "qid long, terms array<long>")
    for _ in range(2):
        files.write_reordered(order, queries, str(tmp_path / "order"))
    assert sorted(read(tmp_path / "order")) == ["3\t4", "3\t4", "5", "5"]
    files.write_features(spark.createDataFrame([(1, 2.0), (0, 1.0)], "qid long, a double"), str(tmp_path / "features"))
    assert read(tmp_path / "features") == ["1.0", "2.0"]
    assert files.stats_json(spark.createDataFrame([(1, "x")], "n int, s string")).first()[0] == '{"n":1,"s":"x"}'


def test_streams(spark, tmp_path):
    from quern.operators.index import from_tokens

    index = from_tokens(spark.createDataFrame([(d, t) for d in range(20) for t in range(d % 4)], "doc_id long, term long"))
    asked = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "qid long, term long")
    asked.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "log"))
    got = []
    log.ranked_batches(stream, index, lambda df, n: got.extend(df.collect()), str(tmp_path / "c1")).awaitTermination()
    want = ranked.topk(index, asked.groupBy("qid", "term").agg(F.count("*").alias("qtf"))).collect()
    assert sorted(got) == sorted(want)

    def finish(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(finish(log.and_counts(stream, index), "lengths", "append")) == [(0, 1, 10), (0, 2, 5), (1, 1, 10)]
    rows = spark.createDataFrame([("a", i, f"k{i % 3}", 10) for i in range(9)], "config string, seq long, key string, bytes long")
    rows.write.parquet(str(tmp_path / "accesses"))
    cached = log.cached_hits(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "accesses")), 100)
    assert finish(cached, "hits", "update")[-1] == ("a", 6, 3, 30)
    timed = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 01:10:00", 2)], "at string, term long").withColumn("at", F.col("at").cast("timestamp"))
    timed.write.parquet(str(tmp_path / "timed"))
    windows = log.windowed_terms(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed")), "at", "1 hour", "10 minutes")
    assert sorted(r.n for r in finish(windows, "windows", "complete")) == [1, 2]
