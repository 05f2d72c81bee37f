"""Cutting increasing sequences into parts that cost least.

A list is cut into pieces of PIECE values, whatever its length, and the cheapest cuts of every piece are found exactly: the least cost
of its first j values is the least, over all places i before j, of the cost of the first i and of one part from i to j. All pieces of
a batch take a step together, as rows of one array. Where the last part of a piece and the first of the next are cheaper as one part,
they become one, so the cuts of lists of one piece are the best there are, and those of longer lists differ from them near borders only.

A part's universe reaches from after the part before to its last value; the first one begins at its first value, and a list of a single
part has the universe of the collection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.sizes import indexed_bits_of_all
from quern.operators.index import Index, spread
from quern.session import checkpointed, ship

#: Values of a piece, values that are worked on together, and bits that a part costs besides its own.
PIECE, TOGETHER, FIXED = 512, 1 << 20, 64

Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]


def part_cost(universe: np.ndarray, n: np.ndarray) -> np.ndarray:
    return indexed_bits_of_all(universe, n) + FIXED


def cheapest_cuts(values: np.ndarray, before: np.ndarray, whole: np.ndarray, universe: int, cost: Cost = part_cost) -> list[tuple[list[int], int]]:
    """Ends of the parts, and what they cost together, for each row of values.

    before is the value before the row's first one, or one less than that; whole says whether the row is a whole list. Of equally
    cheap cuts those count whose last part begins first.
    """
    rows, n = values.shape
    base = np.concatenate([before[:, None], values[:, :-1]], axis=1) + 1
    best, came = np.zeros((rows, n + 1), np.int64), np.zeros((rows, n + 1), np.int64)
    for j in range(1, n + 1):
        span, count = values[:, j - 1 : j] - base[:, :j] + 1, np.broadcast_to(np.arange(j, 0, -1), (rows, j))
        price = best[:, :j] + cost(span, count)
        if j == n:
            price[:, 0] = np.where(whole, cost(np.full(rows, universe), np.full(rows, n)), price[:, 0])
        came[:, j] = price.argmin(axis=1)
        best[:, j] = price[np.arange(rows), came[:, j]]
    out = []
    for r in range(rows):
        cuts, at = [], n
        while at:
            cuts.append(at)
            at = int(came[r, at])
        out.append((cuts[::-1], int(best[r, n])))
    return out


def _pieces(index: Index, piece: int) -> DataFrame:
    """(term, piece, whole, before, v) of every list."""
    rows = index.positioned.select("term", F.expr(f"ordinal div {piece}").alias("piece"), "ordinal", "doc_id", "prev_doc")
    first = F.min_by("doc_id", "ordinal")
    before = F.when(F.col("piece") == 0, first - 1).otherwise(F.min_by("prev_doc", "ordinal"))
    held = rows.groupBy("term", "piece").agg(F.sort_array(F.collect_list("doc_id")).alias("v"), before.alias("before"))
    counts = index.terms.select("term", (F.col("df") <= piece).alias("whole"))
    return held.join(counts, "term").select("term", "piece", "whole", "before", "v")


def partition(index: Index, cost: Cost = part_cost, piece: int = PIECE) -> DataFrame:
    """(term, part, n, first_doc, last_doc, cost) for the lists of a collection."""
    ship(index.docs.sparkSession)
    universe, kind = index.universe, dict(index.postings.dtypes)["term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, before = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            lists = batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            for n in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == n)
                for at in range(0, len(same), max(1, TOGETHER // n)):
                    own = same[at : at + max(1, TOGETHER // n)]
                    values = flat[starts[own][:, None] + np.arange(n)]
                    cuts = [c for c, _ in cheapest_cuts(values, before[own], whole[own], universe, cost)]
                    row = np.repeat(np.arange(len(own)), [len(c) for c in cuts])
                    ends = np.concatenate([np.array(c) for c in cuts])
                    begins = np.concatenate([np.array([0, *c[:-1]]) for c in cuts])
                    base = np.where(begins > 0, values[row, np.maximum(begins, 1) - 1], before[own][row]) + 1
                    columns = [ends - begins, values[row, begins], values[row, ends - 1], base]
                    names = batch.column(0).take(pa.array(own[row])), batch.column(1).take(pa.array(own[row])), pa.array(begins)
                    yield pa.RecordBatch.from_arrays([*names, *[pa.array(c.astype(np.int64)) for c in columns]], names=["term", "piece", "at", "n", "first_doc", "last_doc", "base"])

    cut = spread(_pieces(index, piece)).mapInArrow(run, f"term {kind}, piece long, at long, n long, first_doc long, last_doc long, base long")
    return _priced(_joined(checkpointed(cut), index, cost), index, cost)


def _costs(rows: DataFrame, cost: Cost, name: str, universe: str, n: str) -> DataFrame:
    """rows with the cost of one part of n values below universe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, k = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (universe, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost(u, k).astype(np.int64))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"{name} long"]))


def _joined(parts: DataFrame, index: Index, cost: Cost) -> DataFrame:
    """Parts with `run`: those of one run are one part. Only parts at the borders of pieces are looked at."""
    order = Window.partitionBy("term").orderBy("piece", "at")
    tight = _costs(parts.withColumn("span", F.col("last_doc") - F.col("base") + 1), cost, "own", "span", "n")
    pairs = tight.withColumn("prev_n", F.lag("n").over(order)).withColumn("prev_own", F.lag("own").over(order)).withColumn("prev_base", F.lag("base").over(order))
    border = pairs.withColumn("both_span", F.coalesce(F.col("last_doc") - F.col("prev_base") + 1, "span")).withColumn("both_n", F.col("n") + F.coalesce("prev_n", F.lit(0)))
    tried = _costs(border, cost, "both", "both_span", "both_n")
    at_border = (F.col("at") == 0) & (F.col("piece") > 0)
    marked = tried.withColumn("new", F.when(at_border & (F.col("both") <= F.col("own") + F.col("prev_own")), 0).otherwise(1))
    return marked.withColumn("run", F.sum("new").over(order)).select("term", "run", "n", "first_doc", "last_doc", "base", "own")


def _priced(parts: DataFrame, index: Index, cost: Cost) -> DataFrame:
    """One row for each run, numbered; a run that costs more than its parts stays apart."""
    runs = parts.groupBy("term", "run").agg(F.sum("n").alias("all_n"), F.max("last_doc").alias("all_last"), F.min("base").alias("all_base"), F.sum("own").alias("apart"))
    runs = _costs(runs.withColumn("all_span", F.col("all_last") - F.col("all_base") + 1), cost, "together", "all_span", "all_n")
    met = parts.join(runs, ["term", "run"])
    group = F.when(F.col("together") <= F.col("apart"), F.lit(0)).otherwise(F.col("first_doc"))
    done = met.groupBy("term", "run", group.alias("g")).agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.min("base").alias("base"))
    every = Window.partitionBy("term")
    listed = done.withColumn("parts", F.count("*").over(every)).withColumn("part", (F.row_number().over(every.orderBy("first_doc")) - 1).cast("int"))
    sized = listed.withColumn("span", F.when(F.col("parts") == 1, F.lit(index.universe)).otherwise(F.col("last_doc") - F.col("base") + 1))
    return _costs(sized, cost, "cost", "span", "n").select("term", "part", "n", "first_doc", "last_doc", "cost")
