"""Plans that keep what is shuffled in proportion to the tables: the rows are those of the plain plans, and the work is less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boolean, ranked
from quern.operators.index import from_texts, from_tokens
from quern.plans.queries import QUERIES
from quern.plans.workload import text_index, text_query_terms
from quern.sources import files
from quern.sources.binary import BinaryReader
from quern.sources.files import write_sequences


def short_documents(spark, seed):
    """Documents and queries of few terms, with repeated terms, equal scores, unknown terms and a term that nearly all have."""
    rng = random.Random(seed)
    draw = lambda: [1 if rng.random() < 0.6 else rng.randrange(40) for _ in range(rng.randrange(1, 8))]
    found = [(d, t) for d in range(400) for t in draw()]
    asked = [(q, t) for q in range(150) for t in [*draw(), *([99] if q % 9 == 0 else [])]]
    return from_tokens(spark.createDataFrame(found, "doc_id long, term long")), spark.createDataFrame(asked, "qid long, term long").groupBy("qid", "term").agg(F.count("*").alias("qtf"))


@pytest.mark.parametrize("k", [1, 10])
def test_short_strategy_gives_the_rows_of_the_exhaustive_one(spark, k):
    index, asked = short_documents(spark, k)
    got, want = [sorted(map(tuple, ranked.topk(index, asked, k=k, strategy=s).collect())) for s in ("short", "exhaustive")]
    assert got == want


def test_short_strategy_adds_up_few_of_the_pairs_with_a_common_term(spark):
    """Orders of parts: a query meets 30 documents by each term; before, all of these pairs were shuffled and added up."""
    rng = random.Random(5)
    lines = spark.createDataFrame([(d, rng.randrange(400)) for d in range(3000) for _ in range(4)], "doc_id long, term long")
    index = from_tokens(lines)
    asked = index.postings.select(F.col("doc_id").alias("qid"), "term", F.col("freq").alias("qtf"))
    pairs = asked.join(index.postings, "term").count()
    met = ranked.short_pairs(index, asked, 10)
    assert met.count() < 0.5 * pairs
    assert met.filter("qid = doc_id").select("qid").distinct().count() == 3000


def test_short_and_counts_like_the_plain_one(spark):
    index, asked = short_documents(spark, 3)
    queries = spark.range(200).select(F.col("id").alias("qid"))
    got, want = [sorted(map(tuple, boolean.and_count(index, queries, asked, with_freqs=True, short=s).collect())) for s in (True, False)]
    assert got == want and any(r[1] for r in got)


def test_short_and_meets_one_list_of_a_query(spark):
    """Before, a query met the lists of all its terms, and the pairs of all were counted."""
    index, asked = short_documents(spark, 4)
    pairs = asked.join(index.postings, "term").count()
    assert boolean.whole_candidates(index, asked).count() < 0.5 * pairs


def plan_of(df):
    """A line for each step of the plan that Spark begins with; what is held is one step."""
    nodes, out = [df._jdf.queryExecution().executedPlan().initialPlan()], []
    while nodes:
        node = nodes.pop()
        out.append(node.simpleString(1000))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return "\n".join(out)


@pytest.mark.parametrize("mode", ["or", "and"])
def test_ranked_sums_need_no_shuffle_of_lists(spark, sf_dir, mode):
    """Query terms are sent to the lists, which lie by documents; before, lists were shuffled by term and sums by query and document."""
    own, asked = text_index(spark, sf_dir), text_query_terms(spark, sf_dir)
    plan = plan_of(ranked.topk(own, asked, mode=mode))
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(qid" in plan
    assert "SortMergeJoin" not in plan


def test_terms_of_a_query_are_counted_from_its_own_lists(spark, sf_dir):
    """Before, the terms, blocks and cells of all lists were made, as the collection is held."""
    index = from_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").keep()
    own = index.only(text_query_terms(spark, sf_dir))
    assert own.blocks.count() and own.cells.count() and own.terms.count() < index.postings.select("term").distinct().count()
    assert not {"terms", "blocks", "cells"} & set(index.__dict__)
    index.drop()


@pytest.mark.parametrize("strategy", ["wand", "bmw"])
def test_cells_are_dealt_once_for_bounds_and_once_for_sums(spark, sf_dir, strategy):
    """Before, bounds were shuffled by query and cell, postings by term and cell, and sums by query and document."""
    plan = plan_of(ranked.topk(text_index(spark, sf_dir), text_query_terms(spark, sf_dir), strategy=strategy))
    assert "hashpartitioning(term" not in plan and plan.count("Exchange hashpartitioning(cell") == 2 and plan.count("Exchange hashpartitioning(") == 3


def test_many_query_terms_are_not_sent(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("quern.operators.index.FEW", 100)
    own, asked = text_index(spark, sf_dir), text_query_terms(spark, sf_dir)
    got = [sorted(map(tuple, ranked.topk(own, asked, strategy=s).collect())) for s in ("exhaustive", "bmw")]
    monkeypatch.undo()
    assert got == [sorted(map(tuple, ranked.topk(own, asked).collect()))] * 2


def test_documents_and_lists_are_made_of_one_shuffle_of_texts(spark, sf_dir):
    """Lengths are counted where the texts lie; before, texts were shuffled for lengths and again for postings."""
    index = from_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    assert not [x for x in plan_of(index.docs).splitlines() if "Exchange" in x and "text" in x]
    texts = spark.createDataFrame([(1, "One two, two"), (2, None), (3, " ;"), (1, "three"), (None, "four")], "doc_id long, text string")
    assert sorted(map(tuple, from_texts(texts, "doc_id", "text").docs.filter("doc_id is not null").collect())) == [(1, 4), (1, 4), (2, 0), (3, 0)]


def test_short_sequences_are_read_many_in_a_batch(tmp_path):
    """Before, each sequence was a batch of its own, and a task of 32 MB had millions."""
    (tmp_path / "s").write_bytes(np.array([[1, i] for i in range(10_000)], "<u4").tobytes())
    reader = BinaryReader({"path": str(tmp_path / "s"), "kind": "sequences", "dtype": "<u4"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 1 and batches[0].to_pydict() == {"seq": list(range(10_000)), "pos": [0] * 10_000, "value": list(range(10_000))}


@pytest.mark.parametrize("heavy", [0, 20, 1 << 18])
def test_places_in_lists_counted_whole_or_by_ranges(spark, monkeypatch, heavy):
    monkeypatch.setattr("quern.operators.index.HEAVY", heavy)
    rng = random.Random(heavy)
    found = {(rng.randrange(5, 900), min(int(rng.paretovariate(0.5)), 60)) for _ in range(1500)}
    rows = from_tokens(spark.createDataFrame(sorted(found), "doc_id long, term long")).positioned.select("term", "doc_id", "ordinal", "prev_doc").collect()
    lists = {}
    for d, t in sorted(found):
        lists.setdefault(t, []).append(d)
    want = [(t, d, i, ds[i - 1] if i else -1) for t, ds in lists.items() for i, d in enumerate(ds)]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_places_and_blocks_of_lists_take_one_shuffle(spark, sf_dir):
    """Before, postings, ranges and their totals were shuffled and joined, and blocks were shuffled again."""
    assert plan_of(text_index(spark, sf_dir).positioned.groupBy("term", "block_id").count()).count("Exchange ") == 1


def test_every_code_in_one_pass(spark, sf_dir):
    """Before, blocks were made anew for each code."""
    plan = plan_of(QUERIES["codec_roundtrip"](spark, sf_dir))
    assert plan.count("Union") == 0 and plan.count("InMemoryTableScan") + plan.count("Scan ") <= 2


def test_sequences_with_a_length_are_not_counted(spark, tmp_path):
    """Files of postings have the length of each list; before, places were made a second time to count them."""
    rows = spark.createDataFrame([(s, p, 10 * s + p) for s in range(4) for p in range(s + 1)], "seq long, pos long, value long")
    write_sequences(rows, str(tmp_path / "counted"))
    write_sequences(rows.withColumn("length", F.col("seq") + 1), str(tmp_path / "given"))
    assert (tmp_path / "counted").read_bytes() == (tmp_path / "given").read_bytes()


def test_numbers_of_terms_and_thresholds_are_made_once(spark, sf_dir, monkeypatch):
    """Before, terms were numbered twice and lists' k-th weights found twice; sizes of documents numbered the terms, too."""
    made = []
    dense = files.dense_terms
    monkeypatch.setattr(files, "dense_terms", lambda rows: made.append(rows) or dense(rows))
    QUERIES["term_info_inconsistent"](spark, sf_dir)
    assert len(made) == 1
    QUERIES["collection_sizes_file"](spark, sf_dir)
    assert len(made) == 2
    own = text_index(spark, sf_dir)
    assert own.kths is own.kths and own.kths.storageLevel.useMemory


def test_pairs_are_dealt_in_more_parts_than_postings(spark):
    """Some ten pairs are left for each posting; in as many parts as postings have, 3 GB of them were added up by twelve tasks, which spilled."""
    index, asked = short_documents(spark, 6)
    assert f", {ranked.PAIRS * index.parts})" in plan_of(ranked.short_pairs(index, asked, 10)).splitlines()[0]
