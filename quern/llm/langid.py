"""Language identification by the nearest of several centroids per language.

A text is the vector of its hashed letter n-grams (one to three, with word ends), weighted by TF-IDF and normalised. Document
frequencies are counted over all training documents. The centroids come from spherical k-means within each language, over at
most MOST_TRAINING rows altogether, chosen by hash. A text gets the language of the centroid with the largest cosine, which is
also its score; it is rejected if the cosine is less than that of nearly all training rows of that centroid.

Null texts and texts without a letter are `und` with score 0, and so is everything if nothing could be learned. Rows are
classified one by one: repeated rows get equal results. Very long texts are counted slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import by_rows, dealt
from quern.session import ship

UNKNOWN = "und"
BITS, SIZE = 13, 1 << 13
CLUSTERS, ROUNDS, MOST_TRAINING = 4, 12, 6000
#: Share of a centroid's training rows that may be farther away than the limit of rejection.
TAIL = 0.002
SLICE = 1 << 20

_letter = regex.compile(r"\p{L}").search
_others = regex.compile(r"[^\p{L}]+").sub
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    if not text or not _letter(text):
        return None
    out = np.zeros(SIZE, np.int64)
    plain = f" {_others(' ', text.lower())} "
    for at in range(0, len(plain), SLICE):
        part = np.frombuffer(plain[at : at + SLICE + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        own = min(SLICE, len(plain) - at)
        grams = part + np.uint64(1)
        for n in range(3):
            if n:
                grams = grams[:-1] * _ODD + part[n:]
            hashed = (grams[:own] ^ (grams[:own] >> np.uint64(29))) * _MIX
            out += np.bincount((hashed >> np.uint64(64 - BITS)).astype(np.intp), minlength=SIZE)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # language of each centroid
    limit: np.ndarray  # of each centroid

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text)
        if found is None or not len(self.centroids):
            return UNKNOWN, 0.0, True
        v = weighted(found, self.idf)
        near = self.centroids @ v
        at = int(near.argmax())
        return self.languages[self.owner[at]], float(min(max(near[at], 0.0), 1.0)), bool(near[at] < self.limit[at])


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of (1 + ln tf) * idf."""
    v = np.zeros(len(found), np.float32)
    there = np.flatnonzero(found)
    v[there] = (1 + np.log(found[there])) * idf[there]
    return v / np.linalg.norm(v)


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those taken before, so it depends on nothing random."""
    centres = [rows.sum(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        near = np.max(np.stack([rows @ (c / np.linalg.norm(c)) for c in centres]), axis=0)
        centres.append(rows[int(near.argmin())])
    unit = np.stack([c / np.linalg.norm(c) for c in centres])
    for _ in range(ROUNDS):
        own = (rows @ unit.T).argmax(axis=1)
        unit = np.stack([s / np.linalg.norm(s) for j in range(len(unit)) if (s := rows[own == j].sum(axis=0)).any()])
    return unit


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that have each n-gram, over all of docs; at most SIZE + 1 rows reach the driver."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                found = counts(value.as_py())
                if found is not None:
                    total += found > 0
                    n += 1
        there = np.flatnonzero(total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*there.tolist(), -1], pa.int64()), pa.array([*total[there].tolist(), n], pa.int64())], names=["gram", "n"])

    rows = dealt(docs.select(text)).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(SIZE), 0
    for gram, k in rows:
        if gram < 0:
            n = k
        else:
            out[gram] = k
    return out, n


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_TRAINING) -> Model:
    """Learns from the rows where learn holds and the language is known; an error if there are more than most // 8 languages."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most // 8 + 1).collect()}
    if len(sizes) > most // 8:
        raise ValueError(f"more than {most // 8} languages: the sample has no room for eight rows of each, so give a larger most")
    share = max(8, most // max(1, len(sizes)))
    draw = (F.xxhash64(F.lit("langid"), "key").bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, share / n)))]) if sizes else None
    if rate is None:
        return Model([], np.zeros(SIZE), np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64), np.zeros(0))
    frequency, n = _frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + frequency)) + 1
    picked = rows.withColumn("draw", draw).filter(F.col("draw") < rate[F.col("lang")]).withColumn("turn", F.col("draw") / rate[F.col("lang")])

    def features(texts: list[str]) -> list[list]:
        out: list[list] = [[], []]
        for found in map(counts, texts):
            there = np.empty(0, np.int64) if found is None else np.flatnonzero(found)
            out[0].append(there.astype("<u2").tobytes())
            out[1].append((np.empty(0) if found is None else found[there]).astype("<u4").tobytes())
        return out

    sample = by_rows(picked, ["text"], ["lang", "turn"], features, "grams binary, counts binary").orderBy("turn", "lang").limit(most + most // 8).collect()
    languages = sorted({r["lang"] for r in sample if r["grams"]})
    centroids, owner, limit = [], [], []
    for i, language in enumerate(languages):
        vectors = []
        for r in sample:
            if r["lang"] == language and r["grams"]:
                found = np.zeros(SIZE, np.int64)
                found[np.frombuffer(r["grams"], "<u2")] = np.frombuffer(r["counts"], "<u4")
                vectors.append(weighted(found, idf))
        matrix = np.stack(vectors)
        unit = cluster(matrix, CLUSTERS)
        near = matrix @ unit.T
        own = near.argmax(axis=1)
        for j, c in enumerate(unit):
            centroids.append(c)
            owner.append(i)
            mine = near[own == j, j]
            limit.append(0.8 * float(np.quantile(mine, TAIL)) if len(mine) else 0.0)
    return Model(languages, idf, np.array(centroids, np.float32).reshape(-1, SIZE), np.array(owner, np.int64), np.array(limit))


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in carry, `lang_pred`, `score` and `rejected` of every row.

    The model that is broadcast has at most CLUSTERS * (MOST_TRAINING / 8) centroids of SIZE numbers; it doesn't grow with the table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return by_rows(docs, [text], [key, *carry], lambda texts: list(map(list, zip(*map(sent.value.classify, texts), strict=True))), "lang_pred string, score double, rejected boolean")
