"""Invariants, edge cases and brute force on small collections."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boolean, features, partition, ranked, schedule
from quern.operators.cache import ListCache, greedy_reorder, simulate
from quern.operators.index import Index, balanced_cuts, covering_block, from_texts, from_tokens, invalid_postings, next_geq, shard_splits
from quern.sources.files import batches, dense_terms

B, K1 = 0.5, 1.2


def collection(spark, n_docs=300, n_terms=25, seed=42, **more):
    rng = random.Random(seed)
    rows = [(d, t) for d in range(n_docs) for t in (int(rng.paretovariate(0.7)) % n_terms for _ in range(rng.randrange(1, 12)))]
    return rows, from_tokens(spark.createDataFrame(rows, "doc_id long, term long"), **more)


def asked(spark, queries):
    rows = [(q, t) for q, terms in enumerate(queries) for t in terms]
    terms = spark.createDataFrame(rows, "qid long, term long").groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    return spark.createDataFrame([(q,) for q in range(len(queries))], "qid long"), terms


QUERIES = [[1], [1, 2], [2, 2, 5], [3, 4, 6, 9], [0, 1, 2, 3, 4, 5], [999], [1, 999], []]


@pytest.fixture(scope="module")
def small(spark):
    rows, index = collection(spark, block=16)
    lists = {}
    for d, t in rows:
        lists.setdefault(t, {}).setdefault(d, 0)
        lists[t][d] += 1
    return rows, index.keep(), lists, *asked(spark, QUERIES)


def brute_scores(rows, lists, terms):
    length = {}
    for d, _ in rows:
        length[d] = length.get(d, 0) + 1
    n, mean = len(length), sum(length.values()) / len(length)
    out = {}
    for t in set(terms):
        df = len(lists.get(t, {}))
        unit = max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * (1 + K1)
        for d, f in lists.get(t, {}).items():
            w = f / (f + K1 * (1 - B + B * length[d] / mean))
            out[d] = out.get(d, 0) + terms.count(t) * unit * w
    return out


def test_counts(small):
    _, index, lists, queries, terms = small
    got_and = dict(boolean.and_count(index, queries, terms).collect())
    got_or = dict(boolean.or_count(index, queries, terms).collect())
    parts = {}
    for q, _, n in boolean.sharded_and_count(index, terms).collect():
        parts[q] = parts.get(q, 0) + n
    for q, wanted in enumerate(QUERIES):
        sets = [set(lists.get(t, {})) for t in set(wanted)]
        assert got_or[q] == len(set().union(*sets))
        assert got_and[q] == (len(set.intersection(*sets)) if sets else 0) == parts.get(q, 0)
        assert got_and[q] <= got_or[q]


def test_ranked_against_brute_force_and_each_other(small):
    rows, index, lists, _, terms = small
    want = {}
    for q, wanted in enumerate(QUERIES):
        scores = brute_scores(rows, lists, wanted)
        want[q] = sorted(((-round(s, 6), d) for d, s in scores.items()))[:10]
    for strategy in ("exhaustive", *ranked.PRUNED):
        got = {}
        for q, _, d, s in ranked.topk(index, terms, strategy=strategy).orderBy("qid", "rank").collect():
            got.setdefault(q, []).append((-s, d))
        for q in want:
            assert [d for _, d in got.get(q, [])] == [d for _, d in want[q]], (strategy, q)
            assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got.get(q, []), want[q]))
    merged = ranked.merge(ranked.sharded_topk(index, terms), 10).collect()
    assert sorted(merged) == sorted(ranked.topk(index, terms).collect())
    with pytest.raises(ValueError):
        ranked.topk(index, terms, mode="and", strategy="wand")


def test_ranked_and(small):
    rows, index, lists, _, terms = small
    got = {}
    for q, _, d, s in ranked.topk(index, terms, mode="and").collect():
        got.setdefault(q, {})[d] = s
    for q, wanted in enumerate(QUERIES):
        both = set.intersection(*[set(lists.get(t, {})) for t in set(wanted)]) if wanted else set()
        scores = {d: round(s, 6) for d, s in brute_scores(rows, lists, wanted).items() if d in both}
        assert len(got.get(q, {})) == min(10, len(both))
        assert all(abs(scores[d] - s) < 2e-6 for d, s in got.get(q, {}).items())


def test_repeated_query_terms_count_in_ranking_only(spark, small):
    _, index, _, _, _ = small
    queries, once = asked(spark, [[2, 5]])
    _, twice = asked(spark, [[2, 2, 5, 5]])
    assert boolean.or_count(index, queries, once).collect() == boolean.or_count(index, queries, twice).collect()
    a = {d: s for _, _, d, s in ranked.topk(index, once).collect()}
    b = {d: s for _, _, d, s in ranked.topk(index, twice).collect()}
    assert a.keys() == b.keys() and all(abs(b[d] - 2 * a[d]) < 1e-5 for d in a)


def test_positions_blocks_and_shards(small):
    _, index, lists, _, _ = small
    for r in index.positioned.collect():
        docs = sorted(lists[r.term])
        assert docs[r.ordinal] == r.doc_id and r.block_id == r.ordinal // 16
        assert r.prev_doc == (docs[r.ordinal - 1] if r.ordinal else -1)
    blocks = index.blocks.collect()
    weights = {(r.term, r.doc_id): r.weight for r in index.weighted.collect()}
    for b in blocks:
        held = [d for d in lists[b.term] if b.first_doc <= d <= b.last_doc]
        assert len(held) == b.n and abs(max(weights[b.term, d] for d in held) - b.max_weight) < 1e-12
    lows = index.bounds()
    for r in shard_splits(index).collect():
        after = [b.block_id for b in blocks if b.term == r.term and b.last_doc >= lows[r.shard_id]]
        assert r.split_block == (min(after) if after else None)
    assert len(balanced_cuts(index)) <= 9 and balanced_cuts(index)[0] == lows[0]
    assert invalid_postings(index.postings).count() == 0
    doubled = index.postings.union(index.postings.limit(1))
    assert invalid_postings(doubled).count() == 1


def test_feature_rows(small):
    _, index, _, _, terms = small
    wide = features.query_features(index, terms)
    assert len(wide.columns) == 1 + 54
    rows = {r.qid: r for r in wide.collect()}
    assert rows[0].term_count == 1 and rows[0].var_no_postings == 0 and rows[0].sum_no_postings == rows[0].max_no_postings
    by_doc = {r.qid: r for r in features.query_features(index, terms, compat="docid").collect()}
    assert by_doc[0].sum_morethan_maxscore5_score >= rows[0].sum_morethan_maxscore5_score
    info = index.terms.join(index.thresholds(), "term").select("term", "df", F.col("thresh").alias("topk_score"), (index.unit_weight(F.col("df")) * F.col("max_weight")).alias("max_score"))
    assert features.inconsistent(index, info).count() == 0
    assert features.inconsistent(index, info.withColumn("max_score", F.col("max_score") + 1)).count() == info.count()


def test_empty_collections(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "One one TWO")], "id long, text string")
    index = from_texts(texts, "id", "text")
    assert sorted(index.postings.collect()) == [("one", 4, 2), ("two", 4, 1)]
    assert sorted(index.docs.collect()) == [(1, 0), (2, 0), (3, 0), (4, 3)]
    none = from_texts(texts.limit(0), "id", "text")
    queries, terms = asked(spark, [[1]])
    assert none.terms.count() == 0 and none.n_docs == 0
    assert boolean.and_count(none, queries, terms.withColumn("term", F.col("term").cast("string"))).collect() == [(0, 0)]


def test_save_and_load(spark, small, tmp_path):
    _, index, _, _, terms = small
    index.save(str(tmp_path / "frozen"))
    back = Index.load(spark, str(tmp_path / "frozen"), block=16)
    assert sorted(ranked.topk(back, terms).collect()) == sorted(ranked.topk(index, terms).collect())


def test_running_total_and_ids(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    got = schedule.running_total(spark.createDataFrame(rows, "o long, v long"), [F.col("o")], "v", "before").orderBy("o").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v
    ids = dense_terms(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "term string")).collect()
    assert sorted(ids) == [("a", 0), ("b", 1), ("c", 2)]


def test_latency_quantiles(spark):
    values = [float(random.Random(5).randrange(1000)) for _ in range(1)] + [float(x % 37) for x in range(1000)]
    got = dict(schedule.latency_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect())
    ordered = sorted(values)
    for q in schedule.QUANTILES:
        assert got[q] == ordered[int(round(q * 10)) * len(values) // 1000]
    assert abs(got[0.0] - sum(values) / len(values)) < 1e-9
    assert schedule.latency_quantiles(spark.createDataFrame([], "v double"), "v").count() == 0


def test_cache_evicts_the_longest_unused_and_keeps_pinned_lists():
    cache = ListCache(10)
    assert [cache.get(k, n) for k, n in (("a", 4), ("b", 4), ("a", 4), ("c", 4))] == [False, False, True, False]
    assert list(cache.held) == ["a", "c"] and cache.used == 8 and cache.evicted == 1
    cache.pin("a")
    cache.get("d", 6)
    assert list(cache.held) == ["a", "d"]
    cache.pin("d")
    assert not cache.get("e", 9, prefetch=True) and "e" not in cache.held
    with pytest.raises(MemoryError):
        cache.get("e", 9)
    assert not cache.get("f", 11) and cache.refused == 3 and cache.hits == 1


def test_simulations(spark):
    rows = [("x", 100, i, f"k{i % 7}", 10, False) for i in range(40)]
    frame = spark.createDataFrame(rows, "config string, budget long, seq long, key string, bytes long, prefetch boolean")
    (got,) = simulate(frame).collect()
    assert (got.miss_count, got.hit_count, got.miss_size) == (7, 33, 70)
    assert simulate(frame, trace=True).filter("hit").count() == 33
    queries = spark.createDataFrame([("c", 0, q, [f"t{q % 3}"], [10 + q % 3]) for q in range(9)], "config string, batch_id long, qid long, terms array<string>, sizes array<long>")
    order = [r.qid for r in greedy_reorder(queries, 1000).orderBy("position").collect()]
    assert sorted(order) == list(range(9)) and order[:3] == [0, 3, 6]
    assert batches(queries.select("qid"), 4).select("batch_id").distinct().count() == 3


def least_cost(values, universe):
    """The least cost of all cuts of a list, one place after the other."""
    cost = lambda u, n: int(partition.part_cost(np.array([u]), np.array([n]))[0])
    best = [0]
    for end in range(1, len(values) + 1):
        bases = [values[i - 1] + 1 if i else values[0] for i in range(end)]
        prices = [best[i] + cost(values[end - 1] - b + 1, end - i) for i, b in enumerate(bases)]
        if end == len(values):
            prices[0] = cost(universe, end)
        best.append(min(prices))
    return best[-1]


def test_partitions_are_the_cheapest(spark):
    rng = random.Random(3)
    lists = {}
    for t, n in enumerate((1, 2, 40, 120, 120, 400)):
        dense = rng.sample(range(5000, 5000 + 2 * n), n - n // 2)
        lists[t] = sorted(rng.sample(range(2000), n // 2)) + sorted(dense)
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("len"))
    postings = spark.createDataFrame([(t, d, 1) for t, v in lists.items() for d in v], "term long, doc_id long, freq long")
    index = Index(postings, docs)
    parts = {}
    for r in partition.partition(index).orderBy("term", "part").collect():
        parts.setdefault(r.term, []).append(r)
    for t, v in lists.items():
        assert sum(r.cost for r in parts[t]) == least_cost(v, 10_000)
        assert sum(r.n for r in parts[t]) == len(v) and [r.first_doc for r in parts[t]] == sorted(r.first_doc for r in parts[t])
        assert all(r.n == sum(r.first_doc <= d <= r.last_doc for d in v) for r in parts[t])
    pieces = partition.partition(index, piece=16).groupBy("term").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).collect()
    for r in pieces:
        assert r.n == len(lists[r.term]) and least_cost(lists[r.term], 10_000) <= r.cost <= 1.5 * least_cost(lists[r.term], 10_000)


def test_a_long_even_list_stays_one_part(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("len"))
    index = Index(docs.select(F.lit(7).alias("term"), "doc_id", F.lit(1).cast("long").alias("freq")), docs)
    (r,) = partition.partition(index, piece=64).collect()
    assert (r.n, r.first_doc, r.last_doc, r.cost) == (3000, 0, 2999, partition.FIXED)


def test_seeks_read_one_block(spark, small):
    """For every list and many bounds, next_geq and covering_block against the lists; the join meets few blocks for each probe."""
    _, index, lists, _, _ = small
    bounds = [-5, 0, 1, 7, 100, 150, 299, 300, 5000]
    probes = spark.createDataFrame([(t, b) for t in (*lists, 999) for b in bounds], "term long, lower long")
    for r in next_geq(index, probes).collect():
        after = [d for d in sorted(lists.get(r.term, {})) if d >= r.lower]
        assert (r.doc_id, r.ordinal) == ((after[0], len(lists[r.term]) - len(after)) if after else (None, None))
    blocks = {}
    for b in index.blocks.orderBy("block_id").collect():
        blocks.setdefault(b.term, []).append(b)
    for r in covering_block(index, probes).collect():
        after = [b for b in blocks.get(r.term, []) if b.last_doc >= r.lower]
        assert r.block_id == (after[0].block_id if after else None) and (not after or r.last_doc == after[0].last_doc)


def test_shards_of_equal_weight(spark):
    rows = [(d, t) for d in range(200) for t in range(1 if d < 100 else 9)]
    index = from_tokens(spark.createDataFrame(rows, "doc_id long, term long"))
    cuts = balanced_cuts(index, 4)
    sizes = [sum(1 for d, _ in rows if lo <= d < hi) for lo, hi in zip(cuts, cuts[1:])]
    assert cuts[0] == 0 and cuts[-1] == 200 and len(sizes) == 4 and max(sizes) - min(sizes) <= 2 * 9


def test_pruned_plans_skip_most_documents(spark, small):
    """Cells that cannot reach the threshold meet no posting."""
    _, index, _, _, terms = small
    own = index.only(terms)
    weights = ranked.query_weights(own, terms)
    limits = ranked.reached(own, weights, 10)
    every = ranked.score(own, weights).groupBy("qid").count().collect()
    best = {r.qid: r.score for r in ranked.topk(index, terms).filter("rank = 10").collect()}
    for r in limits.collect():
        assert r.qid not in best or r.theta <= best[r.qid]
    for strategy in ranked.PRUNED.values():
        met = dict(strategy(own, weights, limits).groupBy("qid").count().collect())
        assert all(met.get(r.qid, 0) <= r["count"] for r in every)


def test_a_table_that_changes_is_read_again(spark, tmp_path):
    from quern.plans.workload import text_index

    for n in (3, 5):
        spark.createDataFrame([(i, "some words") for i in range(n)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert text_index(spark, str(tmp_path)).n_docs == n
