"""Scorers: how a posting and a query term weigh. Any object with these two methods will do."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    def doc_weight(self, freq: Column, norm_len: Column) -> Column: ...

    def query_weight(self, df: Column, n_docs: int) -> Column: ...


@dataclass(frozen=True)
class Bm25:
    """BM25 with lengths relative to the mean. The weight of a query term is for one occurrence; it grows in proportion."""

    b: float = 0.5
    k1: float = 1.2
    floor: float = 1e-6

    def doc_weight(self, freq: Column, norm_len: Column) -> Column:
        f = freq.cast("double")
        return f / (f + self.k1 * (1 - self.b + self.b * norm_len))

    def query_weight(self, df: Column, n_docs: int) -> Column:
        rarity = F.ln((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))
        return F.greatest(F.lit(self.floor), rarity) * (1 + self.k1)


@dataclass(frozen=True)
class TfIdf:
    """Damped frequencies, cut down for long documents, times the logarithm of how rare a term is."""

    def doc_weight(self, freq: Column, norm_len: Column) -> Column:
        return (1 + F.ln(freq.cast("double"))) / F.sqrt(norm_len)

    def query_weight(self, df: Column, n_docs: int) -> Column:
        return F.ln(1 + F.lit(float(n_docs)) / df)
