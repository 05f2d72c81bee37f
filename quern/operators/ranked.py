"""Ranked queries: the k documents with the largest scores.

The strategies differ in how they find candidates; all of them give the rows of the exhaustive one. Each first scores the few terms of
a query that can add most, which are in few documents, and so has a score that k documents are sure to reach. Scores are rounded to
SCALE digits before they are ranked, so that the order of additions decides nothing, and ties go to the smaller document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.index import Index, by_cell, few, others
from quern.session import checkpointed

SCALE, SLACK = 6, 1e-4
#: Pairs of a query and a document that short_pairs() leaves for each posting, about.
PAIRS = 8
#: Terms of a query, those with the largest bounds, whose scores raise its threshold.
HEAD = 4


def query_weights(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, term, qtf, unit, bound): the weight of one occurrence, and the most that the term adds to any score.

    Repeated rows of a term add up. Terms that no document holds are dropped.
    """
    added = query_terms.groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    met = added.join(index.terms.select("term", "df", "max_weight"), "term")
    unit = index.unit_weight(F.col("df"))
    return met.select("qid", "term", "qtf", unit.alias("unit"), (unit * F.col("max_weight") * F.col("qtf")).alias("bound"))


def theta(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, theta): a score that k documents are sure to reach: the best of the terms' k-th scores, less a slack for rounding."""
    added = query_terms.groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    best = added.join(index.thresholds(), "term", "left").groupBy("qid").agg(F.max(F.coalesce("thresh", F.lit(0.0)) * F.col("qtf")).alias("best"))
    return best.select("qid", F.greatest(F.lit(0.0), F.col("best") - SLACK).alias("theta"))


def score(index: Index, weights: DataFrame) -> DataFrame:
    """(qid, doc_id, score, n_met) of the documents that hold a term."""
    return _summed(index.weighted.join(weights.select("qid", "term", "qtf", "unit"), "term"))


def _summed(met: DataFrame) -> DataFrame:
    """(qid, doc_id, score, n_met) of postings with the weights of query terms."""
    total = F.sum(F.col("unit") * F.col("weight") * F.col("qtf"))
    return met.groupBy("qid", "doc_id").agg(F.round(total, SCALE).alias("score"), F.count("*").alias("n_met"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score). The limit is applied in every task before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def running_bounds(weights: DataFrame, limits: DataFrame) -> DataFrame:
    """Query terms in the order of their bounds, with the sum so far; a term is essential once that sum passes theta.

    A document without an essential term cannot pass theta.
    """
    order = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    return weights.join(limits, "qid").withColumn("running", F.sum("bound").over(order)).withColumn("essential", F.col("running") > F.col("theta"))


def reached(index: Index, weights: DataFrame, k: int) -> DataFrame:
    """(qid, theta): the k-th best sum of a query's HEAD terms, less a slack for rounding, or 0; what other terms add is never negative.

    It is more than theta() but where a term with a smaller bound has the best k-th score, and reads a few short lists only.
    """
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "term")
    head = weights.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= HEAD)
    found = best(score(index, head), k).filter(F.col("rank") == k).select("qid", F.greatest(F.col("score") - SLACK, F.lit(0.0)).alias("theta"))
    return weights.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("theta", F.lit(0.0)).alias("theta"))


def _by_cell(index: Index, weights: DataFrame, limits: DataFrame, bound: Column) -> DataFrame:
    """Scores of the documents of those cells whose terms' bounds add up to more than theta; other cells' postings are not met."""
    sums = index.cells.join(weights, "term").groupBy("qid", "cell").agg(F.sum(bound).alias("most"))
    left = sums.join(few(limits), "qid").filter("most > theta").groupBy("cell").agg(F.collect_list("qid").alias("left"))
    met = by_cell(index).join(left, "cell").join(weights.select("qid", "term", "qtf", "unit"), "term").filter(F.array_contains("left", F.col("qid")))
    # Documents lie by their cells, so that no shuffle is needed for their sums.
    total = F.sum(F.col("unit") * F.col("weight") * F.col("qtf"))
    return met.groupBy("cell", "qid", "doc_id").agg(F.round(total, SCALE).alias("score"), F.count("*").alias("n_met"))


def _wand(index: Index, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """Bounds are those of whole lists."""
    return _by_cell(index, weights.withColumnRenamed("bound", "own_bound"), limits, F.col("own_bound"))


def _block_max(index: Index, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """Bounds are the largest within the cell."""
    return _by_cell(index, weights, limits, F.col("unit") * F.col("max_weight") * F.col("qtf"))


def _maxscore(index: Index, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """Scores of the documents that an essential term is in, if what the others can add at most would lift them over theta; the lists
    of the others are only probed for these documents."""
    split = checkpointed(running_bounds(weights, limits))
    essential = split.filter("essential")
    rest = split.groupBy("qid").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    part = F.sum(F.col("unit") * F.col("weight") * F.col("qtf"))
    partial = index.weighted.join(essential.select("qid", "term", "qtf", "unit"), "term").groupBy("qid", "doc_id").agg(part.alias("part"))
    kept = checkpointed(partial.join(rest.join(limits, "qid"), "qid").filter("part + rest > theta").select("qid", "doc_id", "part"))
    probes = kept.select("qid", "doc_id").join(split.filter("not essential").select("qid", "term", "qtf", "unit"), "qid")
    more = index.weighted.join(probes, ["term", "doc_id"]).groupBy("qid", "doc_id").agg(part.alias("more"))
    total = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), SCALE)
    return kept.join(more, ["qid", "doc_id"], "left").select("qid", "doc_id", total.alias("score"))


def _placed(postings: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """Postings of the terms in asked(term, qtf) with what each adds to a query's score, that score if it adds all, and its place by that."""
    met = index.dealt(postings, "term").join(asked, "term")
    own = met.withColumn("df", F.count("*").over(Window.partitionBy("term", "qtf")))
    rows = own.withColumn("adds", index.unit_weight(F.col("df")) * F.col("weight") * F.col("qtf")).withColumn("alone", F.round("adds", SCALE)).drop("df", "weight", "freq")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("term", "qtf").orderBy(F.col("alone").desc(), "doc_id")))


def short_pairs(index: Index, query_terms: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, adds) for topk() of many short queries over short documents, whose pairs with a common term are far more than both.

    A document that has one term of a query alone is among its best only if it is among the k best of that term's list, and does not come
    after the k-th best of another list of the query. Of the others, only those are added up that have a second term of the query, as far as the
    marks of both tell (see others()), which miss none. So of a list met by a query few postings are left before anything is shuffled.
    """
    wanted = query_terms.groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    asked = wanted.select("term", "qtf").distinct()
    kth = _placed(index.weighted, asked, index).filter(F.col("place") == k).select("term", "qtf", F.struct("alone", -F.col("doc_id")).alias("kth"))
    own = Window.partitionBy("qid")
    known = index.dealt(wanted.join(kth, ["term", "qtf"], "left"), "qid").withColumn("least", F.max("kth").over(own)).drop("kth")
    queries = others(known, "qid").withColumnsRenamed({"mark1": "asks1", "mark2": "asks2", "qtf": "times"})
    lists = _placed(others(index.weighted, "doc_id"), asked, index)
    second = (F.col("mark1").bitwiseAND(F.col("asks1")) != 0) & (F.col("mark2").bitwiseAND(F.col("asks2")) != 0)
    alone = (F.col("place") <= k) & (F.col("least").isNull() | (F.struct("alone", -F.col("doc_id")) >= F.col("least")))
    # Terms are the only key of the join, by which lists lie already.
    met = lists.join(queries, (lists["term"] == queries["term"]) & (F.col("qtf") - F.col("times") == 0)).filter(second | alone)
    return index.dealt(met.select("qid", "doc_id", "adds"), "qid", share=PAIRS)


PRUNED = {"wand": _wand, "maxscore": _maxscore, "bmw": _block_max}


def topk(index: Index, query_terms: DataFrame, k: int | None = None, mode: str = "or", strategy: str = "exhaustive") -> DataFrame:
    """(qid, rank, doc_id, score) for mode "or" or "and"; strategy is "exhaustive", "short" or a name in PRUNED, which are for "or".

    Pruning is safe for OR only: the k best documents of a single term need not hold the others.
    """
    if strategy == "short" and mode == "or":
        met = short_pairs(index, query_terms, k or index.k).groupBy("qid", "doc_id")
        return best(met.agg(F.round(F.sum("adds"), SCALE).alias("score")), k or index.k)
    index = index.only(query_terms)
    weights = few(checkpointed(query_weights(index, query_terms)))  # a row for each query term, read by every phase
    k = k or index.k
    if mode == "and":
        if strategy != "exhaustive":
            raise ValueError("AND cannot be pruned by the thresholds of single terms")
        needed = query_terms.select("qid", "term").distinct().groupBy("qid").agg(F.count("*").alias("needed"))
        return best(score(index, weights).join(few(checkpointed(needed)), "qid").filter("n_met = needed"), k)
    if strategy == "exhaustive":
        return best(score(index, weights), k)
    return best(PRUNED[strategy](index, weights, checkpointed(reached(index, weights, k))), k)


def sharded_topk(index: Index, query_terms: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, shard_id, rank, doc_id, score): the best of each document range, to be merged by merge()."""
    k, index = k or index.k, index.only(query_terms)
    scored = score(index, few(checkpointed(query_weights(index, query_terms)))).withColumn("shard_id", index.shard(F.col("doc_id")))
    order = Window.partitionBy("qid", "shard_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "shard_id", "rank", "doc_id", "score")


def merge(partial: DataFrame, k: int) -> DataFrame:
    """The k best of partial results whose documents are disjoint."""
    return best(partial.select("qid", "doc_id", "score"), k)
