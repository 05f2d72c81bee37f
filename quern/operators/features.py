"""Features of queries, by which the degree of parallelism that a query deserves can be predicted.

Each feature is a value of a term; over the terms of a query it is summed, maximised (from 0) and spread (population standard
deviation). Block scores are block maxima times the term's weight. A block belongs to the shard of its last document, and a
shard without blocks counts as 0 wherever shards are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.index import Index, few
from quern.session import checkpointed

#: Features of a term, in the order of the output.
TERM_FEATURES = (
    "no_postings", "max_score_term", "avg_score_term", "topk_score_term", "morethan_avg_score", "morethan_topk_score", "var_max_score_term", "inverse_df",
    "morethan_maxscore5_score", "morethan_topkscore5_score",
)
SHARD_FEATURES = (
    "var_topk_score_shard", "var_avg_score_shard", "var_morethan_topk_score_shard", "var_morethan_avg_score_shard", "var_max_score_shard",
    "var_morethan_maxscore5_score_shard", "var_morethan_topkscore5_score_shard",
)
ALL = TERM_FEATURES + SHARD_FEATURES
SHARE = 0.95


def _base(index: Index, query_terms: DataFrame) -> DataFrame:
    """(qid, term, qtf, df, unit, thresh, max_weight, query_topk): what every feature of a query term needs."""
    added = query_terms.groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    known = index.terms.join(index.thresholds(), "term").select("term", "df", "max_weight", "thresh", index.unit_weight(F.col("df")).alias("unit"))
    met = added.join(known, "term")
    best = met.groupBy("qid").agg(F.greatest(F.lit(0.0), F.max(F.col("thresh") * F.col("qtf"))).alias("query_topk"))
    return met.join(best, "qid")


def _near(index: Index, base: DataFrame, compat: str) -> DataFrame:
    """(term, shard_id, near_max, near_topk): postings within SHARE of the term's largest and of its k-th score.

    With compat "docid" it is the document's number that is compared with those scores.
    """
    terms = few(base.select("term", "unit", "max_weight", "thresh").distinct())
    value = F.col("doc_id") if compat == "docid" else F.col("unit") * F.col("weight")
    met = index.weighted.select("term", "doc_id", "weight").join(terms, "term").withColumn("shard_id", index.shard(F.col("doc_id")))
    return met.groupBy("term", "shard_id").agg(
        F.count_if(value >= F.col("unit") * F.col("max_weight") * SHARE).alias("near_max"), F.count_if(value >= F.col("thresh") * SHARE).alias("near_topk")
    )


def _blocks(index: Index, base: DataFrame) -> DataFrame:
    """(qid, term, shard_id, block score) of every block of every query term, with the term's mean."""
    rows = checkpointed(index.blocks.select("term", F.col("max_weight").alias("block_weight"), index.shard(F.col("last_doc")).alias("shard_id")))
    means = rows.groupBy("term").agg(F.avg("block_weight").alias("mean_weight"))
    score = lambda c: F.col("qtf") * (F.col("unit") * F.col(c))
    return base.select("qid", "term", "qtf", "unit", "query_topk").join(rows, "term").join(means, "term").select("qid", "term", "shard_id", "query_topk", score("block_weight").alias("score"), score("mean_weight").alias("mean"))


def term_features(index: Index, query_terms: DataFrame, compat: str = "score") -> DataFrame:
    """(qid, term, term_count, query_topk_score and the features of ALL)."""
    index = index.only(query_terms)
    index.weighted = checkpointed(index.weighted)  # the queries' own lists, read by every feature
    # Both have a row for each query term, or for each of its blocks, and are read several times.
    base = checkpointed(_base(index, query_terms))
    blocks = checkpointed(_blocks(index, base))
    own = blocks.groupBy("qid", "term").agg(
        F.max("score").alias("max_score_term"),
        F.avg("score").alias("avg_score_term"),
        F.count_if(F.col("score") >= F.col("mean")).alias("morethan_avg_score"),
        F.count_if(F.col("score") >= F.col("query_topk")).alias("morethan_topk_score"),
        F.stddev_pop("score").alias("var_max_score_term"),
    )
    shards = len(index.bounds()) - 1
    dense = base.select("qid", "term", "qtf", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard_id"))
    by_shard = blocks.groupBy("qid", "term", "shard_id").agg(
        F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.count_if(F.col("score") >= F.col("query_topk")).alias("over_topk"), F.count_if(F.col("score") >= F.col("mean")).alias("over_avg")
    )
    near = _near(index, base, compat)
    kept = index.thresholds(by_shard=True).withColumnRenamed("thresh", "shard_thresh")
    full = dense.join(by_shard, ["qid", "term", "shard_id"], "left").join(near, ["term", "shard_id"], "left").join(kept, ["term", "shard_id"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    spread = lambda c, name: F.stddev_pop(c).alias(name)
    shard = full.groupBy("qid", "term").agg(
        spread(zero("shard_thresh") * F.col("qtf"), SHARD_FEATURES[0]),
        spread(zero("avg_score"), SHARD_FEATURES[1]),
        spread(zero("over_topk"), SHARD_FEATURES[2]),
        spread(zero("over_avg"), SHARD_FEATURES[3]),
        spread(zero("max_score"), SHARD_FEATURES[4]),
        spread(zero("near_max"), SHARD_FEATURES[5]),
        spread(zero("near_topk"), SHARD_FEATURES[6]),
        F.sum(zero("near_max")).alias("morethan_maxscore5_score"),
        F.sum(zero("near_topk")).alias("morethan_topkscore5_score"),
    )
    count = base.groupBy("qid").agg(F.count("*").alias("term_count"))
    out = base.join(own, ["qid", "term"]).join(shard, ["qid", "term"]).join(count, "qid")
    value = {"no_postings": F.col("df"), "topk_score_term": F.col("thresh") * F.col("qtf"), "inverse_df": 1 / F.col("df")}
    return out.select("qid", "term", "term_count", F.col("query_topk").alias("query_topk_score"), *[value.get(c, F.col(c)).cast("double").alias(c) for c in ALL])


def reduced(name: str) -> list[Column]:
    return [F.sum(name).alias(f"sum_{name}"), F.greatest(F.lit(0.0), F.max(name)).alias(f"max_{name}"), F.stddev_pop(name).alias(f"var_{name}")]


def query_features(index: Index, query_terms: DataFrame, sample_times: DataFrame | None = None, compat: str = "score") -> DataFrame:
    """(qid, term_count, query_topk_score, three columns for each feature, query_sample_time): one wide row for each query."""
    rows = term_features(index, query_terms, compat)
    wide = rows.groupBy("qid").agg(F.first("term_count").alias("term_count"), F.first("query_topk_score").alias("query_topk_score"), *[c for f in ALL for c in reduced(f)])
    if sample_times is None:
        return wide.withColumn("query_sample_time", F.lit(None).cast("double"))
    return wide.join(sample_times.select("qid", F.col("time").cast("double").alias("query_sample_time")), "qid", "left")


def inconsistent(index: Index, term_info: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Terms whose stated df, k-th or largest score differs from the index's: term_info(term, df, topk_score, max_score)."""
    own = index.terms.join(index.thresholds(), "term").select("term", F.col("df").alias("own_df"), F.col("thresh").alias("own_topk"), (index.unit_weight(F.col("df")) * F.col("max_weight")).alias("own_max"))
    off = (F.abs(F.col("topk_score") - F.col("own_topk")) > tolerance) | (F.abs(F.col("max_score") - F.col("own_max")) > tolerance)
    return term_info.join(own, "term").filter((F.col("df") != F.col("own_df")) | off)
