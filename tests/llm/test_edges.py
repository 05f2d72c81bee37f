"""What the operators do with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, components, langid, licences, lines, mixing, perplexity, quality, search, simhash, toxicity
from quern.llm.text import by_rows, words
from test_queries import brute_components, brute_fingerprint

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(rows):
    return [r[1] for r in rows]


def test_words_are_those_of_the_pattern(odd_rows):
    for t in texts_of(odd_rows):
        assert words(t or "") == [w.encode() for w in WORD.findall(t or "")]


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


def test_transducer_is_the_merges(ranks):
    rng = random.Random(5)
    machine = bpe.Transducer(ranks, most_states=50)  # so that it forgets often
    for _ in range(1500):
        piece = bytes(rng.choice(b"abcdethino \xc3\xa9\xe6\x97") for _ in range(rng.randrange(0, 24)))
        assert machine.encode(piece) == [ranks[p] for p in bpe.merged(piece, ranks)]


def test_round_trip_of_odd_texts(spark, odd_docs, odd_rows, no_docs, clashing):
    got = bpe.round_trip(odd_docs, PATH, PATTERN, carry=("text",)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.decoded.decode() == (r.text or "") and r.valid and len(r.ids) == 4 * r.n_tokens
    again = bpe.decode(bpe.encode(clashing.select("doc_id", "text", "size"), PATH, PATTERN, carry=("text",)), PATH, carry=("text",)).collect()
    assert Counter((r.text or "").encode() for r in again) == Counter(bytes(r.decoded) for r in again)
    assert bpe.round_trip(no_docs, PATH, PATTERN).count() == 0


def test_streaming_decoder_holds_back_incomplete_characters(ranks):
    decoder = bpe.Decoder(ranks)
    text = "héllo 日本語 🎉" * 3
    ids = np.frombuffer(bpe.Encoder(ranks, PATTERN).encode(text), "<u4")
    decoder.restart()
    parts = [decoder.feed(ids[i : i + 1]) for i in range(len(ids))]
    assert all(p.decode() is not None for p in parts) and (b"".join(parts) + decoder.finish()).decode() == text and decoder.valid
    broken = np.array([ranks[bytes([0xE6])], ranks[b"a"]], "<u4")
    assert decoder.decode(broken.tobytes()) == (b"\xe6a", False)
    assert decoder.decode(np.array([ranks[bytes([0xE6])]], "<u4").tobytes()) == (b"\xe6", False)


def test_utf8_machine_is_the_language(ranks):
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice((0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xE6, 0xED, 0xF0, 0xF4, 0xF5)) for _ in range(rng.randrange(1, 5)))
        state, _ = bpe.Decoder._run(bpe.BETWEEN, data)
        try:
            data.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        assert (state == bpe.BETWEEN) == good


# Language identification


def test_languages(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs, F.lit(True))
    got = langid.classify(odd_docs, model, carry=("text",)).collect()
    for r in got:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    empty = langid.fit(no_docs, F.lit(True))
    assert {tuple(r)[1:] for r in langid.classify(odd_docs, empty).collect()} == {("und", 0.0, True)}
    assert langid.classify(no_docs, model).count() == 0


def test_slices_count_like_the_whole(monkeypatch):
    text = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 20
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert (langid.counts(text) == whole).all()


# Quality rules


def brute_measures(text):
    text = text or ""
    found = WORD.findall(text)
    seen = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {i + k for i in range(len(found) - 7) if seen[tuple(found[i : i + 8])] > 1 for k in range(8)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(rows), len(rows) - len(set(rows)), len(covered)


def test_measurements(odd_rows):
    more = ["a b c d e f g h " * 2, "a b c d e f g h", "x " * 9, "x " * 8, " ".join(random.Random(1).choice("ab") for _ in range(60))]
    for t in texts_of(odd_rows) + more:
        assert quality.measure(t)[:6] == brute_measures(t)


def test_ledger_policies_and_ablations(odd_docs, odd_rows, clashing, no_docs):
    rows = quality.ledger(odd_docs)
    bits = [r.fail_bits for r in rows.collect()]
    assert len(bits) == len(odd_rows)
    for r in quality.ablations(rows).collect():
        mask, bit = quality.mask(quality.POLICIES[r.version]), quality.mask((r.rule,))
        assert r.kept == sum(b & mask == 0 for b in bits) and r.kept_without == sum(b & mask & ~bit == 0 for b in bits)
        assert r.rejected_alone == sum(b & mask == bit for b in bits)
    kept = quality.keep(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(b & quality.mask(quality.POLICIES[3]) == 0 for b in bits)
    assert quality.keep(no_docs).count() == 0 and quality.ablations(quality.ledger(no_docs)).count() == 0


# Exact search


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20).round(1)], "s") for i in range(400)]
    rows += [(1000 + i, [0.5] * 20, "ties") for i in range(30)] + [(None, [0.1] * 20, ""), (2000, None, ""), (2001, [None] + [0.1] * 19, ""), (2002, [float("nan")] * 20, ""), (2003, [float("inf")] * 20, ""), (2020, [1.0] * 3, ""), (2040, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = search.top_k(df, F.col("vec_id") % 20 == 0, 5, 64).orderBy("query_id", "rank").collect()
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert [tuple(r) for r in got] == sorted(want)
    assert search.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5, 64).count() == 0


def brute_top(rows, k):
    """Scores beyond 64 bits count as the largest or smallest number there is."""
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_components_of_any_size(spark):
    rng = random.Random(9)
    near = [[float(rng.randrange(-(2**24), 2**24)) for _ in range(3)] for _ in range(60)]
    far = [[rng.choice((1e8, -1e8, 1.0)), rng.uniform(-1, 1), rng.choice((0.0, 0.015625))] for _ in range(60)]
    odd = [*[[1e12, 1.0, 0.0]] * 3, *[[1e30, -1e30, 1.0]] * 3, [1e300, 0.0, 0.0], *[[0.25, 0.5, rng.random()] for _ in range(50)]]
    for vectors in (near, far, odd):
        rows = list(enumerate(vectors))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = search.top_k(df, F.col("vec_id") % 20 == 0, 4, 64).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == brute_top(rows, 4)


def test_blocks_that_no_query_needs_are_never_paired(spark):
    """A few long vectors bound the scores of the short ones, most of which then take part in no pair."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (8.0 if i < 1500 else 0.05)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = search.top_k(df, F.col("vec_id") % 20 == 0, 4, 64).filter("query_id < 200").orderBy("query_id", "rank").collect()
    whole = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64))
    for q in range(0, 200, 20):
        scores = whole @ whole[q]
        want = [i for i in np.lexsort((np.arange(len(rows)), -scores)) if i != q][:4]
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(i, scores[i]) for i in want]
    dealt = search.checkpointed(search._dealt(df, F.col("vec_id") % 20 == 0, 64, "vec_id", "embedding"))
    asked = search._query_blocks(search._needs(dealt.filter("asks").withColumn("reached", F.when(F.col("norm") > 64, 100_000.0))), "need")
    pairs = search.block_pairs(dealt, asked)
    every = dealt.filter("not first").select("class", "part").distinct().count() * asked.select("need", "turn").distinct().count()
    assert 0 < pairs.count() < every and dealt.groupBy("class", "part").count().agg(F.max("count")).first()[0] <= 2 * search.FEW_ROWS + 6000 // search.BLOCKS


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = [(20, [1.0, 2.0]), (20, [3.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0]), (22, [-1.0, 0.0])]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 3, 1).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 21, 4), (20, 2, 21, 4), (20, 3, 21, 3)]


# SimHash


def test_components_of_odd_documents(odd_docs, odd_rows, no_docs):
    rows = simhash.clusters(odd_docs).collect()
    prints = [brute_fingerprint(t) for t in texts_of(odd_rows)]
    ids = [r[0] for r in odd_rows]
    want = brute_components(list(range(len(ids))), prints)
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, []).append(ids[i])
    least = {i: min((x for x in groups[root] if x is not None), default=None) for i, root in want.items()}
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in rows) == Counter((ids[i], prints[i], least[i]) for i in want)
    assert simhash.clusters(no_docs).count() == 0


def test_one_of_each_component_stays(clashing, odd_rows, no_docs):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    prints = [brute_fingerprint(t) for t in texts_of(odd_rows)]
    assert kept.count() == len(set(brute_components(list(range(len(prints))), prints).values()))
    assert simhash.keep_one(no_docs).count() == 0


def test_rules_find_every_pair_within_their_distance(spark):
    """Pairs whose differences lie anywhere, by each rule; distances beyond it are no links."""
    rng = random.Random(4)
    assert simhash.FOUR.segments == simhash.FIVE.segments == [(0, 22), (22, 43), (43, 64)] and len(simhash.Rule(4, 7).segments) == 4
    for rule in (simhash.FOUR, simhash.FIVE, simhash.Rule(4, 7)):
        values, want = [], []
        for i in range(120):
            a, far = rng.getrandbits(64), i % (rule.distance + 3)
            values += [a, a ^ sum(1 << b for b in rng.sample(range(64), far))]
            want.append(far <= rule.distance)
        df = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "id long, fp long")
        got = {r.id: r.component for r in simhash.near_duplicates(df, "id", rule).collect()}
        assert [got[2 * i] == got[2 * i + 1] for i in range(120)] == want
    texts = [None, "", "one", "one two three four", "one two three four five six"]
    assert [simhash.fingerprint(t, 5) for t in texts] == [brute_fingerprint(t, 5) for t in texts]


def test_large_buckets_lose_no_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for b in base:
        x = b
        for _ in range(60):  # a chain whose ends are far apart
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "id long, fp long")
    got = {r.id: r.component for r in simhash.near_duplicates(df, "id").collect()}
    assert got == brute_components(list(range(len(values))), values)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(40))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{x: 0 for x in path}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


# Kneser-Ney


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition."""
    grams = Counter(g for t in texts if t is not None for d in [perplexity.PAD + t.encode()] for g in (d[i : i + 5] for i in range(len(d) - 4)))
    counts = {5: grams}
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if not (n[1] and n[2]):
            cuts[k] = [0.5] * 3
            continue
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        cuts[k] = [min(max(d, 0.01), i + 0.9) for i, d in enumerate(raw)]
    cut = lambda k, n: cuts[k][min(n, 3) - 1]
    contexts = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            contexts[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        own = contexts[k].get(g[:-1])
        if own is None:
            return p(g[1:])
        n = counts[k].get(g, 0)
        return ((n - cut(k, n)) if n else 0) / sum(own) + sum(cut(k, m) for m in own) / sum(own) * p(g[1:])

    return lambda t: sum(math.log(p((perplexity.PAD + t)[i : i + 5])) for i in range(len(t)))


def test_model_is_kneser_ney_and_shards_add_up(spark, odd_docs):
    taught = ["the cat sat on the mat\nand the dog", "a cat and a dog sat", "the mat", None, ""]
    df = spark.createDataFrame([(t,) for t in taught], "text string")
    known = perplexity.model(df, "text")
    log = brute_model(taught)
    docs = odd_docs.select("doc_id", F.substring("text", 1, 300).alias("text"))
    for most in (10**6, 60):
        got = perplexity.sums(docs, known, "doc_id", "text", ("text",), most).collect()
        assert len(got) == docs.count()
        for r in got:
            raw = (r.text or "").encode()
            assert r.n_bytes == len(raw) and abs(r.log - log(raw)) <= 1e-5 * max(1, len(raw))


def test_classifier_of_odd_documents(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 60)] + [(None, 1, 0), (9, None, None), (21, 1, 0)], "doc_id long, quality int, toxic int")
    got = perplexity.classify(odd_docs, labels)
    assert got.columns == ["doc_id", "lang", "n_bytes", "perplexity", "limit", "kept"] and got.count() == len(odd_rows)
    rows = got.collect()
    assert all((r.perplexity is None) == (r.n_bytes == 0) and (r.n_bytes or not r.kept) for r in rows)
    taught = [r for r in rows if r.doc_id in range(20, 60) and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert all(r.kept for r in taught) or sum(r.kept for r in taught) >= 0.8 * len(taught)
    assert perplexity.classify(no_docs, labels).count() == 0
    assert perplexity.classify(odd_docs, labels.limit(0)).filter("n_bytes > 0 and not kept").count() == 0


@pytest.mark.parametrize("share", (0.5, 0.995))
def test_limits_are_the_quantiles_of_held_out_trusted_documents(spark, share, monkeypatch):
    """limit and kept of every row against brute force; the larger share needs more documents than a language has."""
    monkeypatch.setattr(perplexity, "QUANTILE", share)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("one", "two", "three", "four", "five")) for _ in range(rng.randrange(3, 40))), rng.choice(("en", "de", None))) for i in range(150)]
    rows += [(200, "zq xj kv wq" * 9, "en"), (201, None, "en"), (202, "only one of its kind", "xx")]
    good = [i for i in range(0, 150, 2)]
    labels = spark.createDataFrame([(i, 1) for i in good] + [(1, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in perplexity.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    log = brute_model([t for i, t, _ in rows if i in set(good) - held])
    logs = {i: (log((t or "").encode()), len((t or "").encode()), lang) for i, t, lang in rows}
    centre = -sum(logs[i][0] for i in held) / sum(logs[i][1] for i in held)
    smooth = {i: round((-x + centre * perplexity.SMOOTHING) / (n + perplexity.SMOOTHING), 3) for i, (x, n, _) in logs.items() if n}
    limit = lambda ids: float(np.quantile([smooth[i] for i in ids], perplexity.QUANTILE))
    for i, (x, n, lang) in logs.items():
        own = [j for j in held if logs[j][2] == lang] if lang else []
        want = limit(own if len(own) >= round(1 / (1 - share)) else held)
        assert abs(math.log(got[i].limit) - want) < 2e-3 and (got[i].perplexity is None) == (n == 0)
        if n and abs(smooth[i] - want) > 4e-3:
            assert got[i].kept == (smooth[i] <= want) and abs(got[i].perplexity - math.exp(-x / n)) < 1e-3 * got[i].perplexity
    assert not got[200].kept and not got[201].kept


def test_shards_are_ranges_of_bounded_counts():
    rng = random.Random(8)
    counts = {p: rng.choice((1, 5, 900)) for p in rng.sample(range(1 << 16), 3000)}
    ranges = perplexity.shard_ranges(counts, 1000)
    assert ranges[0][0] == 0 and ranges[-1][1] == 1 << 16 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(sum(n for p, n in counts.items() if lo <= p < hi) <= 1000 for lo, hi in ranges)
    assert perplexity.shard_ranges({}, 10) == [(0, 1 << 16)] and perplexity.shard_ranges({7: 50, 9: 50}, 10) == [(0, 9), (9, 1 << 16)]


# Columns that are called like computed ones


def test_carried_columns_that_clash_are_replaced(spark, odd_docs, clashing):
    def one(df, *names):
        assert all(df.columns.count(n) == 1 for n in names) and df.select(*names).count() == df.count()

    one(quality.ledger(clashing, carry=("n_words", "fail_bits", "source")), "n_words", "fail_bits", "source")
    one(langid.classify(clashing, langid.fit(odd_docs, F.lit(True)), carry=("score", "lang")), "score", "lang")
    one(simhash.fingerprints(clashing, carry=("fp", "lang")), "fp", "lang")
    one(bpe.encode(clashing, PATH, PATTERN, carry=("ids", "n_tokens", "lang")), "ids", "n_tokens", "lang")
    one(toxicity.score(clashing, toxicity.ftrl([]), carry=("score", "lang")), "score", "lang")
    one(lines.dedup(clashing.withColumn("n_removed", F.lit("x"))), "n_removed", "n_lines", "lines")
    known = perplexity.model(spark.createDataFrame([("some text",)], "text string"), "text")
    one(perplexity.sums(clashing.withColumn("log", F.lit("x")), known, "doc_id", "text", ("log", "lang")), "log", "lang")


# Mixing


def test_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 5, "d": 0}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (i % 3) + 1 for i, s in enumerate(order)}
    left, open_, want = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def brute_mix(rows):
    """copies of rows (id, source, size, weight) by the definition, for sources whose targets are given by mixing.targets()."""
    import hashlib

    def run(target):
        out = {}
        for s in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == s and r[2] > 0]
            lo, hi = 0.0, 1e6
            for _ in range(200):  # copies in proportion to the weight, 3 at most
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(r[2] * min(3.0, mid * r[3]) for r in own) < target[s] else (lo, mid)
            expected = {r[0]: round(min(3.0, lo * r[3]), 9) for r in own}
            left = target[s] - sum(math.floor(expected[r[0]]) * r[2] for r in own)
            order = []
            for r in own:
                p = expected[r[0]] % 1
                u = (int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                if p > 0:
                    q = u / (1 - u) / (p / (1 - p))
                    order.append((q / (1 + q), r[0], r[2]))
            done = 0
            for _, i, size in sorted(order):
                out[i] = math.floor(expected[i]) + (done + size / 2 <= left)
                done += size
            out |= {r[0]: int(expected[r[0]]) for r in own if r[0] not in out}
        return out

    return run


def test_mixes_by_weights_against_brute_force(spark):
    """Unequal probabilities: the documents of each source are taken in Pareto order by their own weights."""
    rng = random.Random(12)
    rows = [(i, rng.choice("abc"), rng.randrange(1, 40), float(rng.choice((0, 1, 2, 5)))) for i in range(400)] + [(900, "d", 7, 0.0), (901, "a", 0, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, grade double")
    target = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_mix(rows)(target)
    got = {r.doc_id: r for r in mixing.mix(df, "doc_id", weight="grade").collect()}
    assert len(got) == len(rows) and all(got[i].copies == n for i, n in want.items()) and got[900].copies == 0
    assert all(r.copies == 0 for r in got.values() if r.grade == 0) and all(r.copies <= 3 for r in got.values())
    mean = lambda g: np.mean([r.copies for r in got.values() if r.grade == g and r["size"]])
    assert mean(1.0) < mean(2.0) < mean(5.0)
    for s in "abc":
        assert abs(sum(r.taken for r in got.values() if r.source == s) - target[s]) <= 40


def test_mixes_of_odd_documents(clashing, odd_docs, odd_rows, no_docs):
    rows = mixing.plan(odd_docs).collect()
    assert len(rows) == len(odd_rows) and all(r.taken <= 3 * r.size for r in rows)
    longest = max(len(WORD.findall(t or "")) for t in texts_of(odd_rows))
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


# Line dedup


def test_repeated_passages_go(spark):
    docs = [(1, "a1\nx\ny\nz\nb1"), (2, "a2\nx\ny\nz\nb2"), (3, "x\n\n y\ny\nz"), (4, "x\ny\n\nz"), (5, "q\nq\nq\nq\nq"), (6, "x\ny"), (7, None), (8, ""), (2, "other\nx\ny\nz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in lines.dedup(df).collect()}
    assert got[1, 5] == ("a1\nx\ny\nz\nb1", 0)
    assert got[3, 5] == ("x\n\n y\ny\nz", 0)
    assert got[4, 4] == ("", 4)
    assert got[5, 5] == ("q", 4)
    assert got[6, 2] == ("x\ny", 0) and got[7, 0] == (None, 0) and got[8, 1] == ("", 0)
    assert {got[2, 5], got[2, 4]} == {("a2\nb2", 3), ("other", 3)}


def test_long_passages_of_few_lines_go(spark):
    one = " ".join(f"w{i}" for i in range(51))
    two = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(21))
    short = " ".join(f"w{i}" for i in range(50))
    docs = [(1, f"a\n{one}\nb"), (2, f"c\n{one}"), (3, f"d\n{two[0]}\n\n{two[1]}\ne"), (4, f"{two[0]}\n{two[1]}\nf"), (5, short), (6, short), (7, one)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "c", 3: docs[2][1], 4: "f", 5: short, 6: short, 7: ""}


def test_three_line_windows_alone(spark):
    one = " ".join(f"w{i}" for i in range(51))
    docs = [(1, f"a\n{one}\nb"), (2, f"c\n{one}"), (3, f"a\n{one}\nb\nd"), (4, one)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string"), long_words=None).collect()}
    assert got == {1: docs[0][1], 2: docs[1][1], 3: "d", 4: one}


def test_lines_of_odd_documents(clashing, odd_docs, odd_rows, no_docs):
    out = lines.dedup(clashing, bare=True)
    assert out.columns == clashing.columns and out.count() == len(odd_rows)
    by_id = {r.doc_id: r for r in lines.dedup(odd_docs).collect() if r.doc_id is not None and r.doc_id != 5}
    assert by_id[100].n_removed == 0 and all(by_id[100 + i].n_removed == 4 for i in range(1, 30))
    assert all(by_id[20 + i].n_removed == 0 for i in range(40)) and by_id[8].text == "the very same line"
    assert lines.dedup(no_docs).count() == 0


# Toxicity


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs, odd_rows):
    rng = random.Random(4)
    words_ = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        own = [rng.choice(words_) for _ in range(20)] + (["vile", "vile"] if i % 4 == 0 else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert len(model.places) < 300
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((scores[i] >= 0.7) == (i % 4 == 0) for i in range(400, 600))
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    blank = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd_docs, blank).collect()} == {0.5}
    assert toxicity.score(no_docs, model).count() == 0


def test_short_and_long_texts_are_scored_alike():
    model = toxicity.Model(np.array(sorted({int(x) for x in toxicity.features("bad")[:1]})), np.array([3.0]), -1.0)
    want = toxicity.sigmoid(2.0)
    assert model.score("bad") == pytest.approx(want) == model.score("bad " + "other " * 200)
    assert model.score(None) == model.score("") == pytest.approx(toxicity.sigmoid(-1.0))


# Licenses


def test_licenses(spark, odd_docs, no_docs):
    full = licences.NOTICES["MIT"][0]
    cases = [
        (1, "some text\nLicensed under CC BY-NC 4.0.\nmore", [("CC-BY-NC-4.0", True)]), (2, "Licensed under CC BY 4.0.", [("CC-BY-4.0", True)]), (3, "I have no license to sing.", []),
        (4, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", [("Apache-2.0", True)]), (5, full.replace(". ", ".\n").replace(", ", ",\n"), [("MIT", True)]),
        (6, "Licensed under the Apache License, Version 9.9.", [("Apache-2.0", False)]), (7, None, []), (8, "", []),
        (9, "This work is licensed under the GNU General Public License, version 2.", [("GPL-2.0", True)]), (9, "This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", True)]),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in cases], "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.license, r.confirmed) for r in licences.scan(df).collect())
    assert got == Counter((i, *h) for i, _, hits in cases for h in hits)
    near = [r for r in licences.scan(df).collect() if r.doc_id == 6][0]
    assert near.lacks == ["2.0"] and "9.9" in near.extra or near.lacks == ["2.0"]
    assert licences.scan(odd_docs).count() == 0 and licences.scan(no_docs).count() == 0


def test_no_language_is_left_out_silently(spark):
    rows = spark.createDataFrame([(i, f"some words of number {i}", f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    assert len(langid.fit(rows, F.lit(True), most=24).languages) == 3
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(rows, F.lit(True), most=16)


def test_a_labelled_key_of_many_rows_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"bad words {i % 7}") for i in range(500)] + [(i, "good words") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1)] + [(i, 0) for i in range(2, 30)], "doc_id long, toxic int")
    once = docs.filter("doc_id > 1").union(docs.filter("doc_id = 1").orderBy(F.xxhash64("text")).limit(1))
    for most, places in ((1000, 10**6), (10, 10**6), (1000, 20)):
        a, b = (toxicity.fit(d, labels, F.lit(True), most=most, places=places) for d in (docs, once))
        assert a.intercept == b.intercept and (a.places == b.places).all() and (a.weights == b.weights).all()


def test_toxicity_learns_planted_words(spark):
    """Held-out accuracy on rows whose label is known by construction."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(900):
        own = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            own[rng.randrange(28)] = "vile"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 600)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], i % 4 == 0) for i in range(600, 900)]
    assert all((s > 0.5) == bad for s, bad in held) and len(model.places) < 200


def test_languages_by_brute_force(spark):
    """Every prediction is the nearest centroid's, computed here by the definition; what is far from all of them is rejected."""
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "abcij"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)), k) for i, (k, a) in enumerate(list(alphabets.items()) * 40)]
    docs = spark.createDataFrame([*rows, (500, "qqqq wwww zzzz vvvv " * 5, None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 90"), F.lit(True))
    frequency = Counter()
    for i, t, _ in rows[:90]:
        frequency.update(np.flatnonzero(langid.counts(t)).tolist())
    for r in langid.classify(docs, model).collect():
        text = rows[r.doc_id][1] if r.doc_id < 500 else "qqqq wwww zzzz vvvv " * 5
        v = np.zeros(langid.SIZE)
        for g in np.flatnonzero(langid.counts(text)):
            v[g] = (1 + math.log(langid.counts(text)[g])) * (math.log((1 + 90) / (1 + frequency[g])) + 1)
        near = model.centroids @ (v / np.linalg.norm(v))
        assert r.lang_pred == model.languages[model.owner[int(near.argmax())]] and abs(r.score - max(0, near.max())) < 1e-4
        assert r.rejected == (near.max() < model.limit[int(near.argmax())])
        assert (r.lang_pred == rows[r.doc_id][2] and not r.rejected) if r.doc_id < 90 else r.doc_id < 500 or r.rejected


def licenses_of(text):
    return [(h[2], h[6]) for h in licences.match(text)]


PROSE = "the committee met on a cold morning to talk about the harvest and the price of grain in the valley. " * 5
FILLED = {"{party}": "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "{number}": "1."}


def all_wordings():
    """(license, wording with its open places filled) of every template."""
    for name, forms in licences.NAMES.items():
        for form in forms:
            yield from ((name, f"{lead} {form}.") for lead in licences.LEADS)
    for name, forms in licences.NOTICES.items():
        for form in forms:
            for place, filling in FILLED.items():
                form = form.replace(place, filling)
            yield name, form


def test_licenses_within_long_lines():
    for name, wording in all_wordings():
        assert licenses_of(f"{PROSE}{wording} {PROSE}") == [(name, True)]
    assert licenses_of(f"{PROSE}Licensed under the Apache License, Version 9.9. {PROSE}") == [("Apache-2.0", False)]
    assert licenses_of(PROSE + "I have no license to sing. " + PROSE) == []


def test_licenses_in_their_ordinary_layout():
    for mit in licences.NOTICES["MIT"]:
        for blank in ("\n\n", "\n#\n# ", "\n *\n * "):
            assert licenses_of(mit.replace("{party}", "THE AUTHORS").replace(" The above", f"{blank}The above")) == [("MIT", True)]
    mpl = licences.NOTICES["MPL-2.0"][0].replace("Public License", "Public\nLicense").replace("this file", "this\nfile").replace("http:", "https:")
    assert [h[:3] for h in licences.match("Title\n" + mpl)] == [(1, 3, "MPL-2.0")] and licenses_of(mpl) == [("MPL-2.0", True)]
    near = mpl.replace("v. 2.0", "v. 7.0").replace(" You", "\n\nYou")
    assert [(h[:3], h[4], h[6]) for h in licences.match("Title\n" + near)] == [((1, 5, "MPL-2.0"), ["2.0"], False)]
    zero = licences.NOTICES["CC0-1.0"][0].replace("{party}", "the author")
    assert licenses_of("Words of an author who lives here. " + zero.replace(" has", "\nhas")) == [("CC0-1.0", True)]


def test_clauses_tell_licenses_apart():
    three = dict(all_wordings())["BSD-3-Clause"]
    for i, clause in enumerate(("Redistributions of", "Redistributions in", "Neither the"), 1):
        three = three.replace(f"1. {clause}", f"\n\n{i}. {clause}")
    third = three[three.index("\n\n3.") : three.index("THIS SOFTWARE IS")]
    two = three.replace(third, "\n\n")
    assert licenses_of(three) == [("BSD-3-Clause", True)] and licenses_of(two) == [("BSD-2-Clause", True)]
    assert licenses_of("Copyright (c) 2020, An Owner. All rights reserved.\n\n" + three) == [("BSD-3-Clause", True)]
    assert not any(sure for _, sure in licenses_of(three.replace("endorse", "praise")) + licenses_of(two[: two.index("\n\n2.")]))


def test_every_template_can_be_confirmed():
    everything = list(all_wordings())
    text = "\n".join(f"{w} And so much for that, which has some words of its own; grain, valleys, mornings, harvests and a cold price." for _, w in everything)
    found = Counter(licenses_of(text))
    assert all(found[name, True] == n for name, n in Counter(name for name, _ in everything if name != "Proprietary").items())


def test_a_change_of_any_word_is_not_confirmed():
    """Brute force over every word of every template: replaced, left out, or with another one before it."""
    for name, wording in all_wordings():
        parts = wording.split(" ")
        for i in range(0, len(parts), 1 if len(parts) < 40 else 5):
            for changed in (parts[:i] + ["Zebra"] + parts[i + 1 :], parts[:i] + ["Zebra"] + parts[i:]):
                own = licences.wordings(licences._word(" ".join(changed).lower()))
                held = [w for begin, end, _, filling in own for w in licences._word(" ".join(changed).lower())[begin:end] if w not in filling]
                assert "zebra" not in held and {licences.templates()[i].license for _, _, i, _ in own} <= {name}


def test_licenses_come_from_the_compressor(monkeypatch):
    """No wording is confirmed where its template saves nothing: only those of one license remain if only its templates have dictionaries."""
    text, everything = "\n".join(w for _, w in all_wordings()), {name for name, _ in all_wordings()} - {"Proprietary"}

    def confirmed():
        licences.winners.cache_clear()
        licences.guess.cache_clear()
        return {name for name, sure in licenses_of(text) if sure}

    try:
        for only in ("MIT", "none"):
            with monkeypatch.context() as patch:
                for t in licences.templates():
                    if t.license != only:
                        patch.setattr(t, "compressor", licences._plain()[0])
                assert confirmed() == {only} & everything
    finally:
        assert confirmed() == everything


def test_the_compressor_loses_no_wording():
    """Brute force over every place and template, with open places that hold up to twelve words of any kind and length."""
    import random

    draw, known = random.Random(1), licences.templates()
    for i, t in enumerate(known):
        assert any(i in licences.winners(tuple(run)) for run in t.runs)
    words = sorted({w for t in known for w in t.words})
    kinds = (words, sorted(words, key=len)[-12:], ["".join(draw.choices("abcdefgh", k=300)) for _ in range(20)], list(known[0].words), ["grain", "license", "copyright"])
    for _ in range(150):
        text = []
        for t in draw.choices(known, k=4):
            text += draw.choices(draw.choice(kinds), k=draw.randrange(6))
            for gap, run in zip([*t.gaps, ""], t.runs, strict=True):
                text += run + (draw.choices(draw.choice(kinds), k=draw.randrange(13)) if gap == "party" else [draw.choice(("1", "iv"))] if gap else [])
        hits = [(-len(t.words), len(h[1]), i, at, *h) for at in range(len(text)) for i, t in enumerate(known) if (h := t.at(text, at))]
        want: list[tuple] = []
        for _, _, i, begin, end, held in sorted(hits):
            if all(end <= b or e <= begin for b, e, _, _ in want):
                want.append((begin, end, i, held))
        assert licences.wordings(text) == sorted(want)


def test_siblings_and_negations():
    names = {n: [w for k, w in all_wordings() if k == n] for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
    for name, forms in names.items():
        for form in forms:
            assert licenses_of(form) == [(name, True)]
            assert not any(sure for _, sure in licenses_of(form.replace("General", "Special")))
    for negated in ("This is not released under the MIT License.", "It was never, as some say, released under the MIT License.", "No part is Released under the MIT License."):
        assert licenses_of(negated) == [("MIT", False)]
    for plain in ("It is not for sale. Released under the MIT License.", "We did not sell it!\n\nReleased under the MIT License."):
        assert licenses_of(plain) == [("MIT", True)]


def test_cues_lose_no_wording(spark):
    """The condition that texts meet before they leave the JVM holds for every wording, in any case and broken anywhere."""
    rows = [(f,) for _, w in all_wordings() for f in (w, w.upper(), w.lower(), w.replace(" ", "\n"), w.replace(" ", " *\n\t# "))]
    df = spark.createDataFrame(rows, "text string")
    assert df.filter(F.col("text").rlike(licences.CUES)).count() == len(rows)


def test_repeated_notices_take_linear_time():
    import time

    for line in ("Released under the MIT License.", "Released under the MITT License.", dict(all_wordings())["ISC"]):
        began = time.perf_counter()
        found = licenses_of("\n".join([line] * 20_000))
        assert (len(found) < 20 and not any(sure for _, sure in found) if "MITT" in line else len(found) == 20_000) and time.perf_counter() - began < 60


def test_rows_keep_their_order_and_types(odd_docs, odd_rows):
    got = by_rows(odd_docs, ["text"], ["doc_id", "n_chars"], lambda t: [[len(x or "") for x in t]], "n long").collect()
    assert Counter((r.doc_id, r.n_chars, r.n) for r in got) == Counter((r[0], r[4], len(r[1] or "")) for r in odd_rows)


def test_machines_of_a_stage_go_when_the_worker_serves_another(spark):
    docs = spark.range(0, 64, 1, 8).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    bpe.round_trip(docs, PATH, PATTERN).collect()

    def alive(texts):
        import gc

        return [[sum(type(x).__name__ == "Transducer" for x in gc.get_objects())] * len(texts)]

    assert {r.n for r in by_rows(docs, ["text"], ["doc_id"], alive, "n long").collect()} == {0}
    assert {r.n for r in by_rows(docs, ["text"], ["doc_id"], alive, "n long", bpe.OWNER).collect()} == {0}


def test_near_duplicates_send_few_rows_in_a_batch(spark, monkeypatch):
    """The rows of the batches that the fingerprints are made of, written in their place."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, real, seen = spark.conf.get(name), simhash.checkpointed, []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b.num_rows] * b.num_rows, pa.int64())], names=["__0", "version", "fp"])

    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k, t, carry, rule: docs.select(k, "version").mapInArrow(sizes, "`__0` long, version long, fp long"))
    monkeypatch.setattr(simhash, "checkpointed", lambda df: seen.append(real(df)) or seen[-1])
    simhash.keep_one(spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")))
    assert seen[0].agg(F.max("fp")).first()[0] == 256 and spark.conf.get(name) == before
