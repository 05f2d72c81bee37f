"""Exact top-k inner products by columnar branch and bound.

Vectors become integers. Rows are dealt into blocks of bounded bytes by the size of their norm, the largest first, as these can have
the largest products. The first block gives every query a score that k rows are sure to reach. By Cauchy and Schwarz a query then
needs only the blocks whose norms, times its own, pass that score; pairs of blocks that no query needs are never made. Within a pair
of blocks the rows lie dimension by dimension: the scores of some queries are accumulated a few dimensions at a time, after each step
the product of the norms of what is left of query and row bounds the rest, and rows that can reach the k-th best of none of these
queries are dropped and the others compacted.

Vectors that are null, empty, or hold a null or non-finite component, and rows without an id take no part. Only vectors of the same
length are compared. Ties go to the smaller id. Rows that repeat an id are separate candidates, but never of a query with that id; a
query id that occurs more than once asks once for each row, and the k best of all are returned.

Components may be of any size. Bounds count the error of doubles, and where that is half a unit or more, what is left at the end is
multiplied with integers of any length; a score beyond 64 bits is returned as the largest or smallest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed, ship

#: Dimensions of a step, norm classes to an octave, and those that queries are sorted into by what they need.
STEP, CLASSES, COARSE = 8, 16, 4
#: Queries that are worked on together.
TOGETHER = 64
#: Most bytes of a block of rows and of one of queries, fewest rows of a block, blocks that a table has at least if it can, and rows by
#: which every query is tried first. Blocks of queries are as large as they may be, as the rows are sent to each of them.
ROW_BYTES, QUERY_BYTES, FEW_ROWS, BLOCKS, FIRST = 16 << 20, 4 << 20, 256, 16, 1024
LONG = 1 << 63


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale)


def _matrix(table: pa.Table, scale: int) -> np.ndarray:
    rows = table.column("v").combine_chunks()
    return _integers(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), scale)


def _exactly(q: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products of whole numbers that doubles hold, but cannot multiply."""
    own = [int(x) for x in q]
    return [min(max(sum(a * int(b) for a, b in zip(own, row, strict=True)), -LONG), LONG - 1) for row in rows]


def best(queries: np.ndarray, q_ids: np.ndarray, reached: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, row id, score) of the k best rows of every query, but for those below the score that it has reached
    already; in no special order."""
    with np.errstate(over="ignore", invalid="ignore"):
        order = np.argsort(-np.square(rows).sum(axis=0), kind="stable")  # heavy dimensions first
        tall = np.ascontiguousarray(rows.T[order])
        mass = np.sqrt(np.array([np.square(tall[at + STEP :]).sum(axis=0) for at in range(0, len(order), STEP)]))
        error = max(2.0**-50, len(order) * 2.0**-52) * np.sqrt(np.square(queries).sum(axis=1)) * np.sqrt(np.square(rows).sum(axis=1).max())
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(queries), TOGETHER):
            some = slice(at, at + TOGETHER)
            left, score, stay = _survivors(queries[some][:, order], q_ids[some], reached[some], error[some], tall, mass, ids, k)
            for n in range(len(stay)):
                own = np.flatnonzero(stay[n])
                if error[at + n] < 0.5:
                    whole = np.rint(score[n, own]).astype(np.int64)
                else:
                    whole = np.array(_exactly(queries[at + n], rows[left[own]]), np.int64)
                names = ids[left[own]]
                top = np.lexsort((names, ~whole))[:k]  # ~ turns the order around, also of the smallest number
                for part, values in zip(out, (np.full(len(top), at + n), names[top], whole[top]), strict=True):
                    part.append(values)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _survivors(queries: np.ndarray, q_ids: np.ndarray, reach: np.ndarray, error: np.ndarray, tall: np.ndarray, mass: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that any of the queries cannot do without, their scores, and which of them each query needs.

    The k-th best lower bound of every query is found anew at half of the dimensions, at three quarters, and at the end.
    """
    steps = len(mass)
    known = np.isfinite(error)
    reach = np.where(known, reach, -np.inf)
    left, score, own = np.arange(tall.shape[1]), np.zeros((len(queries), tall.shape[1])), q_ids[:, None] == ids[None, :]
    for s in range(steps):
        at = s * STEP
        block = tall[at : at + STEP]
        score += queries[:, at : at + STEP] @ (block if len(left) == len(ids) else block[:, left])
        slack = np.sqrt(np.square(queries[:, at + STEP :]).sum(axis=1))[:, None] * mass[s][left][None, :] + error[:, None]
        if len(left) > k and s + 1 in (steps // 2, 3 * steps // 4, steps):
            low = np.where(own, -np.inf, score - slack)
            reach = np.where(known, np.maximum(reach, np.partition(low, len(left) - k, axis=1)[:, len(left) - k]), reach)
        stay = (score + slack >= reach[:, None]) | ~known[:, None]
        stay &= ~own
        alive = stay.any(axis=0)
        if alive.sum() < 0.9 * len(left) or s + 1 == steps:
            left, score, own, stay = left[alive], score[:, alive], own[:, alive], stay[:, alive]
    return left, score, stay


def _dealt(vectors: DataFrame, is_query: Column, scale: int, key: str, vector: str) -> DataFrame:
    """(dims, class, part, first, row, id, asks, norm, v) of every row that takes part, each in one block of one class of norms."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    # Integers as doubles: beyond 2**52 a double is whole already.
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + F.pow(whole(x.cast("double") * scale), 2)))
    known = vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("asks"), v.alias("v"), F.when(good, norm).alias("norm"), F.size(v).alias("dims")).filter("id is not null and norm is not null")
    # A norm beyond all doubles is in the highest class, so it is never bounded away.
    known = known.withColumn("class", F.when(F.col("norm") == 0, F.lit(-1)).otherwise(F.floor(F.log2(F.least("norm", F.lit(1e300))) * CLASSES)).cast("int"))
    counts = known.groupBy("dims", "class").agg(F.count("*").alias("n"))
    every, above = Window.partitionBy("dims"), Window.partitionBy("dims").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    per = F.least(F.greatest(F.lit(ROW_BYTES) / (8 * F.col("dims")), F.lit(1)), F.greatest(F.lit(FEW_ROWS), F.sum("n").over(every) / BLOCKS))
    sized = counts.select("dims", "class", F.ceil(per).alias("per"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), "n").withColumn("parts", F.ceil(F.col("n") / F.col("per")))
    numbered = known.withColumn("row", F.monotonically_increasing_id())
    met = numbered.join(sized.select("dims", "class", "per", "before", "parts"), ["dims", "class"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return met.select("dims", "class", "part", (F.col("before") + F.col("part") * F.col("per") < FIRST).alias("first"), "row", "id", "asks", "norm", "v")


def _query_blocks(asked: DataFrame, *by: str) -> DataFrame:
    """asked with `turn`, a block of queries within by."""
    counts = asked.groupBy("dims", *by).agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(QUERY_BYTES) / (8 * F.col("dims")), F.lit(1))
    sized = counts.withColumn("turns", F.ceil(F.col("n") / F.ceil(per))).drop("n")
    return asked.join(sized, ["dims", *by]).withColumn("turn", F.pmod(F.xxhash64("row"), F.col("turns")).cast("int"))


def _needs(asked: DataFrame) -> DataFrame:
    """asked with `need`, the lowest class of norms in which a row may reach what the query has reached."""
    least = F.floor(F.log2(F.col("reached") / F.col("norm")) * CLASSES) - 1
    need = F.when(F.col("reached").isNull() | (F.col("reached") <= 0) | (F.col("norm") <= 0) | (F.col("norm") > 1e300), F.lit(-(1 << 20))).otherwise(F.floor(least / COARSE) * COARSE)
    return asked.withColumn("need", need.cast("int"))


def block_pairs(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """(dims, class, part, need, turn): the blocks of rows that a block of queries needs, besides the first ones."""
    rows = dealt.filter(~F.col("first")).select("dims", "class", "part").distinct()
    queries = asked.select("dims", "need", "turn").distinct()
    return rows.join(queries, "dims").filter("class >= need")


def _scored(asked: DataFrame, rows: DataFrame, keys: list[str], k: int, scale: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of each group of rows for the queries of the same group."""

    def work(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if queries.num_rows and candidates.num_rows:
            ids, row = queries.column("id").to_numpy(), queries.column("row").to_numpy()
            reached = queries.column("reached").cast(pa.float64()).fill_null(float("-inf")).to_numpy()
            at, found, score = best(_matrix(queries, scale), ids, reached, _matrix(candidates, scale), candidates.column("id").to_numpy(), k)
            parts = row[at], ids[at], found, score
        else:
            parts = (np.empty(0, np.int64),) * 4
        return pa.table([pa.array(p, pa.int64()) for p in parts], names=["row", "query_id", "vec_id", "score"])

    # New names for the same columns, as both sides come from one table.
    asked, rows = (of.select(*[F.col(c).alias(c) for c in names]) for of, names in ((asked, [*keys, "row", "id", "reached", "v"]), (rows, [*keys, "id", "v"])))
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(work, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product for every row that is a query.

    A block has at most ROW_BYTES or QUERY_BYTES, whatever the size of the table. Nothing is collected.
    """
    ship(vectors.sparkSession)
    dealt = checkpointed(_dealt(vectors, is_query, scale, key, vector))
    asked = _query_blocks(dealt.filter("asks").withColumn("reached", F.lit(None).cast("long")))
    turns = asked.select("dims", "turn").distinct()
    first = checkpointed(_scored(asked, dealt.filter("first").join(turns, "dims"), ["dims", "turn"], k, scale))
    reached = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    asked = checkpointed(_query_blocks(_needs(asked.drop("reached", "turn", "turns").join(reached, "row", "left")), "need"))
    pairs = block_pairs(dealt, asked)
    wide = dealt.filter(~F.col("first")).join(pairs, ["dims", "class", "part"])
    more = _scored(asked.drop("class", "part").join(pairs, ["dims", "need", "turn"]), wide, ["dims", "class", "part", "need", "turn"], k, scale)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.union(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
