"""The registered queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import sizes
from quern.functions.codecs import CODECS, coded, decoded
from quern.operators import boolean, cache, features, index as ix, partition, ranked, schedule
from quern.plans.files import QUERIES as file_queries
from quern.plans.streams import QUERIES as stream_queries
from quern.plans.workload import basket_index, basket_query_terms, page_index, text_index, text_queries, text_query_terms
from quern.session import table
from quern.sources.files import dense_terms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Look-ahead of the planner, bytes of the cache, and digits of results.
AHEAD, BUDGET, DIGITS = 4, 200_000, 6
UNLIMITED = 1 << 60


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def _text(spark: SparkSession, sf_dir: str) -> tuple[ix.Index, DataFrame]:
    return text_index(spark, sf_dir), text_query_terms(spark, sf_dir)


@query
def postings_text(spark, sf_dir):
    return text_index(spark, sf_dir).postings


@query
def postings_basket(spark, sf_dir):
    return basket_index(spark, sf_dir).postings


@query
def postings_pages(spark, sf_dir):
    return page_index(spark, sf_dir).postings


@query
def doc_lengths(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).lengths, "norm_len")


@query
def term_stats(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).terms, "max_weight")


@query
def dense_term_ids(spark, sf_dir):
    return dense_terms(text_index(spark, sf_dir).terms)


@query
def query_terms_text(spark, sf_dir):
    return _text(spark, sf_dir)[1]


def _counts(name: str, run, freqs: bool) -> None:
    def counts(spark, sf_dir):
        own, wanted = _text(spark, sf_dir)
        return run(own, text_queries(spark, sf_dir), wanted, with_freqs=freqs)

    QUERIES[name] = counts


_counts("and_count", boolean.and_count, False)
_counts("and_freqs", boolean.and_count, True)
_counts("or_count", boolean.or_count, False)
_counts("or_freqs", boolean.or_count, True)


def _top(name: str, **how) -> None:
    def top(spark, sf_dir):
        own, wanted = _text(spark, sf_dir)
        return ranked.topk(own, wanted, **how)

    QUERIES[name] = top


_top("ranked_or_topk")
_top("ranked_and_topk", mode="and")
_top("wand_topk", strategy="wand")
_top("maxscore_topk", strategy="maxscore")
_top("bmw_topk", strategy="bmw")


@query
def basket_and_count(spark, sf_dir):
    wanted = basket_query_terms(spark, sf_dir)
    return boolean.and_count(basket_index(spark, sf_dir), wanted, wanted, short=True)


@query
def basket_ranked_or(spark, sf_dir):
    return ranked.topk(basket_index(spark, sf_dir), basket_query_terms(spark, sf_dir), strategy="short")


@query
def dgaps(spark, sf_dir):
    rows = text_index(spark, sf_dir).positioned
    return rows.select("term", "doc_id", "ordinal", (F.col("doc_id") - F.col("prev_doc") - 1).alias("gap"))


@query
def posting_blocks(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).blocks, "max_weight")


def _probes(spark, sf_dir) -> tuple[ix.Index, DataFrame]:
    own, wanted = _text(spark, sf_dir)
    return own.only(wanted), wanted.select("term", F.pmod(F.col("qid") * 7919, F.lit(own.n_docs)).alias("lower")).distinct()


@query
def next_geq_probe(spark, sf_dir):
    return ix.next_geq(*_probes(spark, sf_dir))


@query
def block_asof_lookup(spark, sf_dir):
    return _rounded(ix.covering_block(*_probes(spark, sf_dir)), "max_weight")


@query
def prev_value_probe(spark, sf_dir):
    own, probes = _probes(spark, sf_dir)
    met = ix.next_geq(own, probes).join(own.positioned.select("term", "doc_id", "prev_doc"), ["term", "doc_id"], "left")
    return met.select("term", "lower", "doc_id", "prev_doc")


@query
def position_probe(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    own = own.only(wanted)
    at = wanted.join(own.terms.select("term", "df"), "term").select("term", F.pmod(F.col("qid") * 31, F.col("df")).alias("ordinal")).distinct()
    return at.join(own.positioned.select("term", "ordinal", "doc_id", "freq"), ["term", "ordinal"])


@query
def shard_assignment(spark, sf_dir):
    own = text_index(spark, sf_dir)
    return own.docs.select("doc_id", own.shard(F.col("doc_id")).alias("shard_id"))


@query
def shard_ranges(spark, sf_dir):
    return text_index(spark, sf_dir).shard_table()


@query
def sharded_and_count(spark, sf_dir):
    return boolean.sharded_and_count(*_text(spark, sf_dir))


@query
def sharded_topk(spark, sf_dir):
    return ranked.sharded_topk(*_text(spark, sf_dir))


@query
def merged_topk(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    return ranked.merge(ranked.sharded_topk(own, wanted), own.k)


@query
def shard_split_blocks(spark, sf_dir):
    return ix.shard_splits(text_index(spark, sf_dir))


@query
def term_topk_threshold(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).thresholds(), "thresh")


@query
def term_shard_threshold(spark, sf_dir):
    return _rounded(text_index(spark, sf_dir).thresholds(by_shard=True), "thresh")


@query
def query_threshold(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    return _rounded(ranked.theta(own.only(wanted), wanted), "theta")


@query
def essential_terms(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    own = own.only(wanted)
    rows = ranked.running_bounds(ranked.query_weights(own, wanted), ranked.theta(own, wanted))
    return _rounded(rows.select("qid", "term", "qtf", "bound", "running", "essential"), "bound", "running")


@query
def shard_score(spark, sf_dir):
    return _rounded(schedule.shard_scores(*_text(spark, sf_dir)), "shard_score")


@query
def shard_tasks(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    threads = text_queries(spark, sf_dir).select("qid", F.expr("1 + qid % 4").alias("threads"))
    return schedule.tasks(schedule.shard_scores(own, wanted), threads).select("qid", "task_no", F.array_join(F.transform("shard_ids", lambda x: x.cast("string")), " ").alias("shard_ids"))


@query
def features_term(spark, sf_dir):
    return _rounded(features.term_features(*_text(spark, sf_dir)), "query_topk_score", *features.ALL)


@query
def features_query(spark, sf_dir):
    rows = features.query_features(*_text(spark, sf_dir)).drop("query_sample_time")
    return _rounded(rows, *[c for c in rows.columns if c not in ("qid", "term_count")])


@query
def list_bytes_vbyte(spark, sf_dir):
    return schedule.list_bytes(text_index(spark, sf_dir))


@query
def list_offsets(spark, sf_dir):
    return schedule.list_offsets(text_index(spark, sf_dir)).select("term", "list_bytes", "offset")


@query
def gap_code_bits(spark, sf_dir):
    gap = F.col("doc_id") - F.col("prev_doc") - 1
    rows = text_index(spark, sf_dir).positioned
    return rows.groupBy("term").agg(F.sum(sizes.gamma_bits(gap)).alias("gamma_bits"), F.sum(sizes.delta_bits(gap)).alias("delta_bits"), F.sum(sizes.vbyte_bytes(F.col("freq") - 1)).alias("freq_bytes"))


@query
def sequence_bitsize(spark, sf_dir):
    own = text_index(spark, sf_dir)
    u, n = F.lit(own.n_docs).cast("long"), F.col("df")
    named = {"docs_bits": sizes.indexed_bits(u, n), "docs_fano_bits": sizes.elias_fano_bits(u, n), "docs_bitvector_bits": sizes.ranked_bitvector_bits(u, n), "docs_strict_bits": sizes.strict_bits(u, n), "freqs_bits": sizes.strict_bits(F.col("cf") + 1, n)}
    return own.terms.select("term", *[v.cast("long").alias(k) for k, v in named.items()])


@query
def read_alignment(spark, sf_dir):
    return schedule.reads(text_index(spark, sf_dir))


@query
def lookahead_terms(spark, sf_dir):
    return schedule.lookahead(_text(spark, sf_dir)[1], AHEAD)


@query
def latency_quantiles(spark, sf_dir):
    return _rounded(schedule.latency_quantiles(table(spark, sf_dir, "events"), "value"), "latency")


@query
def cache_warmup(spark, sf_dir):
    return schedule.warmup(schedule.list_bytes(text_index(spark, sf_dir)), BUDGET)


def _accesses(spark, sf_dir, budgets: dict[str, int]) -> DataFrame:
    own, wanted = _text(spark, sf_dir)
    rows = wanted.join(schedule.list_bytes(own.only(wanted)).select("term", "list_bytes"), "term")
    numbered = rows.select(F.col("term").alias("key"), F.col("list_bytes").alias("bytes"), F.row_number().over(Window.partitionBy("qid").orderBy("term")).alias("turn"), "qid").withColumn("seq", F.col("qid") * 1_000_000 + F.col("turn"))
    configs = F.array(*[F.struct(F.lit(k).alias("config"), F.lit(v).cast("long").alias("budget")) for k, v in budgets.items()])
    return numbered.select("key", "bytes", "seq", F.inline(configs))


@query
def lru_simulation(spark, sf_dir):
    return cache.simulate(_accesses(spark, sf_dir, {"small": 2_000, "large": 20_000, "unlimited": UNLIMITED}))


@query
def lru_first_touches(spark, sf_dir):
    """With room for everything, a miss is a first touch."""
    return cache.simulate(_accesses(spark, sf_dir, {"unlimited": UNLIMITED})).select("hit_count", "miss_count", "miss_size")


@query
def greedy_reorder(spark, sf_dir):
    own, wanted = _text(spark, sf_dir)
    rows = wanted.join(schedule.list_bytes(own.only(wanted)).select("term", "list_bytes"), "term").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "list_bytes"))).alias("s"))
    return cache.greedy_reorder(rows.select(F.lit("default").alias("config"), F.expr("qid div 100").alias("batch_id"), "qid", F.col("s.term").alias("terms"), F.col("s.list_bytes").alias("sizes")), 20_000)


@query
def optimal_partition(spark, sf_dir):
    return partition.partition(basket_index(spark, sf_dir))


def _widest(universe, n):
    """Bits of a part if every value takes as many as the universe has, and a head."""
    return n * sizes.digits(universe) + 32


@query
def gap_partition(spark, sf_dir):
    """Partitions by another cost."""
    return partition.partition(basket_index(spark, sf_dir), _widest)


@query
def balanced_shards(spark, sf_dir):
    """Ranges of documents with about equally many postings."""
    own = text_index(spark, sf_dir)
    return ix.Index(own.postings, own.docs, cuts=ix.balanced_cuts(own)).shard_table()


@query
def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("us"))
    return rows.select("event_type", "n", F.round(schedule.throughput(F.col("n"), F.col("us")), DIGITS).alias("per_second"))


@query
def read_alignment_fixed(spark, sf_dir):
    """Reads in units of 64 KiB whatever the length."""
    return schedule.reads(text_index(spark, sf_dir), fixed_unit=sizes.READ_UNITS[-1])


@query
def codec_roundtrip(spark, sf_dir):
    """Every block of the basket collection through every code and back."""
    rows = basket_index(spark, sf_dir).positioned
    lists = rows.groupBy("term", "block_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", (F.col("doc_id") - F.col("prev_doc") - 1).alias("gap"), (F.col("freq") - 1).alias("rest")))).alias("s"))
    values = ix.spread(lists.select(F.concat("s.gap", "s.rest").alias("v")))
    # All codes in one pass, so that blocks are made once.
    tests = values.select(F.size("v").alias("n"), *[(decoded(coded(F.col("v"), c), F.size("v"), c) == F.col("v")).alias(c) for c in CODECS])
    out = tests.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("codec"), F.col(c).alias("same")) for c in CODECS])))
    return out.groupBy("codec").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_values"), F.count_if("same").alias("n_equal"))


QUERIES |= file_queries | stream_queries
