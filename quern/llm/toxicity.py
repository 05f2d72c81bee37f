"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, pairs of neighbours and pairs with one word between them, hashed to 2**BITS places; each
counts once. Training passes over at most MOST_TRAINING labelled rows, chosen by hash, a few times; of these the first that have
MOST_PLACES features together, so that the driver's memory is bounded however long texts are. Every place has its own learning rate, and the L1 penalty keeps most weights at exactly zero, so the model that is broadcast is a short list.

Null and empty texts have no features and get the score of the intercept, like any text without a weighted feature. Without
labels all weights are zero. Labels that are null are left out; a document that is labelled 0 and 1 counts as both. Where a labelled
key names several rows, one of them is learned from: that whose text has the smallest hash. Rows are scored one by one; a carried
column called `score` is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import by_rows

BITS = 22
MOST_TRAINING, MOST_PLACES = 12_000, 32_000_000
ALPHA, BETA, L1, L2 = 8.0, 1.0, 8.0, 0.0
PASSES = 10
#: Weight of a toxic row; there are fewer of them, and they are what is looked for.
POSITIVE = 2.0
#: Words whose hashes a Python worker remembers.
MOST_WORDS = 500_000

_words = regex.compile(r"\w+").findall
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    """64-bit FNV hashes of words, whatever the process."""

    def __missing__(self, word: str) -> int:
        h = 0xCBF29CE484222325
        for b in word.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def features(text: str | None) -> np.ndarray:
    """The places of a whole text's features, with repeats."""
    found = _words(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    grams = np.concatenate([h * _A, (h[:-1] * _A + h[1:]) * _B, (h[:-2] * _B + h[2:]) * _C])
    return ((grams ^ (grams >> np.uint64(31))) * _C >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@dataclass
class Model:
    places: np.ndarray  # in order
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        got = features(text)
        at = np.searchsorted(self.places, got) if len(got) < 64 else None
        if at is None:
            table = self.__dict__.get("table")
            if table is None:
                table = self.__dict__["table"] = np.zeros(1 << BITS, np.float32)
                table[self.places] = self.weights
            there = np.unique(got[table[got] != 0])
        else:
            at[at == len(self.places)] = 0
            there = np.unique(got[self.places[at] == got]) if len(self.places) else got[:0]
        return sigmoid(self.intercept + float(self.weights[np.searchsorted(self.places, there)].sum()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> Model:
    """Learns from (distinct places, label), one row after the other."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    for _ in range(passes):
        for places, label in rows:
            zi, ni = z[places], n[places]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            w0 = -z0 * ALPHA / (BETA + math.sqrt(n0))
            g = (sigmoid(w0 + float(w.sum())) - label) * (POSITIVE if label else 1.0)
            z[places] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[places] = ni + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / ALPHA * w0
            n0 += g * g
    places = np.flatnonzero(np.abs(z) > L1)
    weights = (np.sign(z[places]) * L1 - z[places]) / ((BETA + np.sqrt(n[places])) / ALPHA + L2)
    return Model(places, weights, -z0 * ALPHA / (BETA + math.sqrt(n0)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_TRAINING, places: int = MOST_PLACES) -> Model:
    """Learns from the labelled rows for which learn, a condition on the labels' key, holds.

    The labels are limited to `most` before they are broadcast to the texts. Features reach the driver one partition after the other,
    in the order in which they are learned from, and only the first `places` of them.
    """
    known = labels.filter(learn & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    turn = F.xxhash64(F.lit("toxicity"), F.col("key"))
    picked = known.filter("key is not null").orderBy(turn, "key", "label").limit(most)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    once = texts.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = by_rows(once, ["text"], ["key", "label"], lambda t: [[np.unique(features(x)).astype("<u4").tobytes() for x in t]], "places binary")
    got, held = [], 0
    for r in rows.orderBy(turn, "key", "label").toLocalIterator():
        held += len(r["places"]) // 4
        if got and held > places:
            break
        got.append((hash_order(r["key"]), r["label"], r["places"]))
    return ftrl([(np.frombuffer(p, "<u4").astype(np.int64), label) for _, label, p in sorted(got)])


def hash_order(key: object) -> int:
    """An order of training that doesn't follow the table's, the same in every run."""
    return _Hashes()[str(key)]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in carry and `score`, between 0 and 1, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return by_rows(docs, [text], [key, *carry], lambda texts: [[sent.value.score(t) for t in texts]], "score double")
