"""The stages one after the other, each against brute force over what it was given."""

from collections import Counter

import pytest

import corpus_pipeline
from test_edges import brute_measures
from test_queries import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1]) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_quality_rules(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        n, _, _, _, _, repeated = brute_measures(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in kept


def test_lines(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    seen = Counter()
    for r in stages[2].collect():
        lines, old = r.text.split("\n"), iter(before[r.doc_id].split("\n"))
        assert all(any(x == y for y in old) for x in lines) and r.n_chars == len(r.text)
        full = [x for x in lines if x.strip()]
        seen.update(zip(full, full[1:], full[2:]))
    assert not [w for w, n in seen.items() if n > 1]


def test_near_duplicates(stages):
    rows = stages[2].orderBy("doc_id").collect()
    want = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text, 5) for r in rows], 5)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(want.values()))


def test_mix_and_tokens(stages, spark, sf_dir):
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert copies.keys() <= {r.doc_id for r in stages[3].collect()} and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in stages[5].collect()) == copies
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(tuple(r) for r in stages[5].collect())


def test_odd_and_empty_tables_pass_through(spark, odd_docs, no_docs, sf_dir, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
        assert docs.columns[:2] == ["doc_id", "n_tokens"]
