"""Quality by the perplexity of an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

The counts of 5-grams of bytes are a table, five bytes packed into a long; the continuation counts of the shorter orders, the
discounts, the totals of contexts and the probabilities come from it by aggregations and equality joins on contexts and
suffixes. All trusted text is counted, and the tables grow with it.

For scoring, the model is cut into shards, ranges of the last two bytes of the context, which every order above two that a byte needs
shares. Ranges are chosen by the counts of their rows, so that a shard has at most SHARD rows, or those of a single pair of bytes, which
are at most 2**24. Shards are joined with the documents one after the other: a shard is sent to the executors, a pass over the documents
adds up the logarithms of the bytes that belong to it, the sums are written, and the shard goes. While the model fits one shard there
is one pass. So the documents' counts are never shuffled, and memory is bounded by the largest shard.

A document is kept if its perplexity is no more than the limit of its language: the QUANTILE among trusted documents of that language
that the model was not trained on. Languages that have fewer than one in 1 - QUANTILE, and documents without a language, take the
quantile over all of them. Means are smoothed, since short texts vary more.

Null and empty texts have no perplexity and are not kept. Without trusted text every byte is equally likely, and there is no
limit. Repeated rows are scored alike; each counts as trusted text if its label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import by_rows, dealt
from quern.session import checkpointed, ship

ORDER = 5
PAD = b"\n" * (ORDER - 1)
#: Rows of the model that are sent at once, and distinct 5-grams that a counting task holds before it emits them.
SHARD, HELD = 1_500_000, 1_000_000
#: Trusted keys up to which they, and not the texts, are sent to find the trusted texts.
FEW_KEYS = 500_000
QUANTILE = 0.995
#: Bytes with the mean of trusted text that are added to every document's mean.
SMOOTHING = 100


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each byte of the texts, one after the other, and the number of bytes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    a = np.frombuffer(b"".join(x for r in raw for x in (PAD, r)), np.uint8).astype(np.int64)
    if len(a) < ORDER:
        return np.empty(0, np.int64), lengths
    n = len(a) - ORDER + 1
    g = np.zeros(n, np.int64)
    for k in range(ORDER):
        g = g << 8 | a[k : k + n]
    own = np.ones(n, bool)  # without the windows that end in a later text's padding
    at = np.cumsum(lengths[:-1] + len(PAD))
    for k in range(len(PAD)):
        own[at + k - len(PAD)] = False
    return g[own], lengths


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(gram, n) over all texts of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                more, n = np.unique(grams(batch.column(0).slice(at, 256).to_pylist())[0], return_counts=True)
                both, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])

    return dealt(docs.select(text)).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, for counts of one, two, and more."""
    n = dict(counts.filter("n <= 4").groupBy("n").agg(F.count("*")).collect())
    one, two, three, four = (n.get(i, 0) for i in range(1, 5))
    if not (one and two):
        return [0.5, 0.5, 0.5]
    y = one / (one + 2 * two)
    raw = [1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three if three else 1.5]
    return [min(max(d, 0.01), k + 0.9) for k, d in enumerate(raw)]


def model(docs: DataFrame, text: str) -> DataFrame:
    """(length, back, gram, value): the probability of the last byte of each seen n-gram after its others, for length 1 to 5,
    and, where back is true, the weight of the shorter context after a context of that length."""
    counts = checkpointed(counted(docs, text))
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders[k] = checkpointed(orders[k + 1].select(low.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    known: DataFrame | None = None
    tables = []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = orders[k].withColumn("context", F.shiftright("gram", 8)).withColumn("cut", cut)
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed")).select("context", "total", (F.col("freed") / F.col("total")).alias("weight"))
        rows = rows.join(sums, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "weight")
        if known is None:
            done = rows.select("gram", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            short = known.select(F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
            done = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(short, "suffix").select("gram", (F.col("own") + F.col("weight") * F.col("shorter")).alias("p"))
        known = checkpointed(done)
        tables.append(known.select(F.lit(k).alias("length"), F.lit(False).alias("back"), "gram", F.col("p").alias("value")))
        tables.append(sums.select(F.lit(k - 1).alias("length"), F.lit(True).alias("back"), F.col("context").alias("gram"), F.col("weight").alias("value")))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


class Table:
    """Longs and doubles in an open hash table, looked up by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several for a slot, the last one stays
            placed = free & (self.keys[slot] == keys[left])
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        slot = self._slot(keys)
        out = np.full(len(keys), default)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out


class Shard:
    """The rows of the model for contexts that end in some pairs of bytes; probabilities of 5-grams by backing off."""

    def __init__(self, rows: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]):
        self.p = {k: Table(*rows[k, False]) for k in range(1, ORDER + 1)}
        self.back = {k: Table(*rows[k, True]) for k in range(ORDER)}

    def logs(self, g: np.ndarray) -> np.ndarray:
        p = np.full(len(g), np.nan)
        weight, left, key = np.ones(len(g)), np.arange(len(g)), g
        for k in range(ORDER, 0, -1):
            got = self.p[k].get(key, -1.0)
            hit = got >= 0
            p[left[hit]] = weight[left[hit]] * got[hit]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            weight[left] *= self.back[k - 1].get(key >> 8, 1.0)
            key = key & ((1 << 8 * (k - 1)) - 1)
        p[left] = weight[left] / 256
        return np.log(p)


#: The shard that this Python worker uses now.
_shards: dict[str, Shard] = {}


def _pair() -> Column:
    """The last two bytes of the context of a row of the model; null for rows that all shards have."""
    pair = F.when(F.col("back"), F.col("gram")).otherwise(F.shiftright("gram", 8)).bitwiseAND(F.lit(0xFFFF))
    return F.when(F.col("length") >= F.when(F.col("back"), 2).otherwise(3), pair)


def shard_ranges(counts: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of pairs, which cover all of them, with at most `most` rows each; a pair that has more is a range of its own."""
    cuts, held = [0], 0
    for pair in sorted(counts):
        if held and held + counts[pair] > most:
            cuts.append(pair)
            held = 0
        held += counts[pair]
    return list(zip(cuts, [*cuts[1:], 1 << 16], strict=True))


def _collected(part: DataFrame) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Grams and values of a shard by length and kind."""
    got = part.select("length", "back", "gram", "value").toArrow()
    length, back, gram, value = (got.column(i).to_numpy() for i in range(4))
    return {(k, b): (gram[own], value[own].astype(np.float32)) for k in range(ORDER + 1) for b in (False, True) if (own := (length == k) & (back == b)) is not None}


def sums(docs: DataFrame, known: DataFrame, key: str, text: str, carry: tuple[str, ...] = (), most: int = SHARD) -> DataFrame:
    """key, the columns in carry, `n_bytes` and `log`, the sum of the logarithms, of every row.

    A carried column that is called like one of these is left out.
    """
    placed = known.withColumn("pair", _pair())
    counts = {r["pair"]: r["count"] for r in placed.filter("pair is not null").groupBy("pair").count().collect()}
    shards = shard_ranges(counts, most)
    passes = []
    for low, high in shards:
        sent = docs.sparkSession.sparkContext.broadcast(_collected(placed.filter(F.col("pair").isNull() | ((F.col("pair") >= low) & (F.col("pair") < high)))))

        def work(texts: list[str | None], sent=sent, low=low, high=high, name=uuid4().hex) -> list[list]:
            if name not in _shards:
                _shards.clear()
                _shards[name] = Shard(sent.value)
            shard = _shards[name]
            total = np.zeros(len(texts))
            g, lengths = grams(texts)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for at in range(0, len(g), 1 << 20):
                part = g[at : at + (1 << 20)]
                if high - low == 1 << 16:
                    logs = shard.logs(part)
                else:
                    pair = part >> 8 & 0xFFFF
                    own = (pair >= low) & (pair < high)
                    logs = np.zeros(len(part))
                    logs[own] = shard.logs(part[own])
                whole = np.concatenate([[0.0], np.cumsum(logs)])
                cut = np.clip(ends - at, 0, len(part))
                total += whole[cut[1:]] - whole[cut[:-1]]
            return [lengths.tolist(), total.tolist()]

        done = by_rows(docs, [text], [key, *carry], work, "n_bytes long, log double")
        if len(shards) == 1:
            return done
        passes.append(checkpointed(done))
        sent.unpersist()
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    # Rows that are equal in every column are added up together, and dealt out again.
    names = [c for c in out.columns if c != "log"]
    added = out.groupBy(*names).agg((F.sum("log") * len(shards) / F.count("*")).alias("log"), F.expr(f"count(*) div {len(shards)}").alias("copies"))
    return added.select(*out.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", most: int = SHARD) -> DataFrame:
    """key, lang, `n_bytes`, `perplexity` of a byte, `limit` and `kept` of every row.

    Trusted are the documents with a label of quality 1. Four fifths of them by hash train the model, the others set the limits.
    """
    trusted = labels.filter(F.col(quality) == 1).select(F.col(key).alias("key")).filter("key is not null").distinct()
    fold = F.crc32(F.col("key").cast("string")) % 5
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("version"))
    teachers = checkpointed(trusted.filter(fold != 0))
    teachers = F.broadcast(teachers) if teachers.count() <= FEW_KEYS else teachers
    known = model(named.select("key", "text").join(teachers, "key", "left_semi"), "text")
    scored = checkpointed(sums(named, known, "key", "text", ("lang", "version"), most))
    marks = trusted.filter(fold == 0).withColumn("judge", F.lit(True))
    mean = -F.col("log") / F.col("n_bytes")
    both = scored.join(marks, "key", "left").withColumn("mean", F.when(F.col("n_bytes") > 0, mean))
    judges = both.filter("judge and mean is not null")
    typical = judges.agg(F.sum("log"), F.sum("n_bytes")).first()
    centre = -typical[0] / typical[1] if typical[1] else 0.0
    smooth = F.round((F.col("mean") * F.col("n_bytes") + centre * SMOOTHING) / (F.col("n_bytes") + SMOOTHING), 3)
    # Rounded, so that the exact quantiles need a bounded number of distinct values.
    quantile = F.percentile("smooth", F.lit(QUANTILE)).alias("limit")
    rounded = judges.withColumn("smooth", smooth)
    # Of fewer documents than this the quantile would be the largest, whatever it is.
    enough = F.count("*") >= round(1 / (1 - QUANTILE))
    by_lang = rounded.filter("lang is not null").groupBy(F.col("lang").alias("its_lang")).agg(quantile, enough.alias("enough")).filter("enough").drop("enough")
    general = rounded.agg(quantile).first()[0]
    out = both.withColumn("smooth", smooth).join(by_lang, F.col("lang") == F.col("its_lang"), "left")
    limit = F.coalesce("limit", F.lit(general).cast("double"), F.lit(float("inf")))
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), "n_bytes", F.exp("mean").alias("perplexity"), F.exp(limit).alias("limit"), F.coalesce(F.col("smooth") <= limit, F.lit(False)).alias("kept"))
