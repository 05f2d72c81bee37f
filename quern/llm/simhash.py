"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits, made of the hashes of the shingles of a text, and two documents are linked if no more bits differ than a rule
allows. Cut into enough segments, at least one of them differs by at most one bit: three segments with two differences each would make
six, so three are enough for distances up to five. Every fingerprint is indexed under its 64 one-wildcard variants - one segment, with
one of its bits left out - and fingerprints that share a variant are compared.

FOUR is the rule of words by fours and 4 bits. FIVE takes words by fives and all that three segments find, 5 bits; pairs that it links
have, but for chance, a similarity of more than 0.8, and it misses many pairs near that.

Equal fingerprints are one node, so exact copies cost nothing. Buckets of up to SMALL nodes emit their verified pairs. Larger
ones are cut into blocks of BLOCK nodes, and each pair of blocks emits a spanning forest of its links: every component stays
connected, and the pairs within a group are neither emitted nor capped.

Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a key are separate rows of one
result. A null key takes no part in the choice of the smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.text import ROWS, by_rows, positional
from quern.session import arrow_rows, checkpointed, ship

SEED = 42


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, most bits that may differ, and segments, which are as many as that needs."""

    shingle: int
    distance: int

    @property
    def segments(self) -> list[tuple[int, int]]:
        n = self.distance // 2 + 1
        cuts = [-(-64 * i // n) for i in range(n + 1)]
        return list(zip(cuts, cuts[1:], strict=False))


FOUR, FIVE = Rule(4, 4), Rule(5, 5)
SMALL, BLOCK = 64, 2048
#: Hashes whose bits are counted at once; sums of 255 bits fit a byte.
CHUNK = 255 * 32


def fingerprint(text: str | None, shingle: int = FOUR.shingle) -> int:
    """The unsigned fingerprint of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(islice(found, i, None) for i in range(shingle)), strict=False)), len(found) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, m), repeat(SEED)), np.uint64, m)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        whole = m // 255 * 255
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < m:
            counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), rule: Rule = FOUR) -> DataFrame:
    """key, the columns in carry and `fp`, the fingerprint as a signed long; a carried column called `fp` is left out."""
    return by_rows(docs, [text], [key, *carry], lambda texts: [[_signed(fingerprint(t, rule.shingle)) for t in texts]], "fp long")


def variants(nodes: DataFrame, rule: Rule = FOUR) -> DataFrame:
    """(bit, part, fp): the segment that holds the bit, without that bit."""
    each = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    inside = F.lit(0).cast("long")
    for lo, hi in rule.segments:
        inside = F.when((F.col("bit") >= lo) & (F.col("bit") < hi), F.lit(_signed(sum(1 << b for b in range(lo, hi)))).cast("long")).otherwise(inside)
    return each.select("bit", F.col("fp").bitwiseAND(inside).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))).alias("part"), "fp")


def forest(fps: np.ndarray, distance: int = FOUR.distance) -> list[tuple[int, int]]:
    """Links that connect what any links within fps connect: breadth first, one row of distances at a time."""
    out: list[tuple[int, int]] = []
    left = fps.view(np.uint64)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(left ^ u) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                queue += list(found)
                out += [(_signed(int(u)), _signed(int(v))) for v in found]
    return out


def links(nodes: DataFrame, rule: Rule = FOUR) -> DataFrame:
    """Verified links (u, v) between distinct fingerprints, enough to connect each component; links may repeat."""
    ship(nodes.sparkSession)

    def connected(table: pa.Table) -> pa.Table:
        pairs = forest(np.unique(table.column("fp").to_numpy()), rule.distance)
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    bucket = Window.partitionBy("bit", "part").orderBy("fp")
    sized = variants(nodes, rule).select("*", F.count("*").over(bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"), (F.row_number().over(bucket) - 1).alias("place")).filter("n > 1")
    sized = checkpointed(sized)
    lists = sized.filter(F.col("n") <= SMALL).groupBy("bit", "part").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(F.slice("fps", i + 2, F.size("fps")), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    near = F.filter(pairs, lambda p: F.bit_count(p["u"].bitwiseXOR(p["v"])) <= rule.distance)
    few = lists.select(F.inline(near))
    large = sized.filter(F.col("n") > SMALL).withColumn("own", F.expr(f"place div {BLOCK}"))
    others = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))
    one = large.filter(F.col("n") <= BLOCK).select("bit", "part", "fp", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    many = large.filter(F.col("n") > BLOCK).select("bit", "part", "fp", "own", F.explode(others).alias("other")).select("bit", "part", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return few.union(one.union(many).groupBy("bit", "part", "lo", "hi").applyInArrow(connected, "u long, v long"))


def near_duplicates(rows: DataFrame, key: str, rule: Rule = FOUR) -> DataFrame:
    """rows has a key and `fp`; adds `root`, which names the component, and `component`, the smallest key that links reach, the
    own one included. Where keys repeat, components may have the same smallest key, but never the same root."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes.select("fp"), rule))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component")))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component"), "fp")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = FOUR) -> DataFrame:
    """key, `fp` and `component` of every document."""
    return near_duplicates(checkpointed(fingerprints(docs, key, text, rule=rule)), key, rule).select(key, "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = FOUR) -> DataFrame:
    """docs with one row of each component: that with the smallest key (of rows that share it, the smallest text hash)."""
    plain, restored = positional(docs)
    k, t = (f"__{docs.columns.index(c)}" for c in (key, text))
    with arrow_rows(docs.sparkSession, ROWS):
        rows = checkpointed(fingerprints(plain.withColumn("version", F.xxhash64(t)), k, t, ("version",), rule))
    known = near_duplicates(rows, k, rule)
    best = known.groupBy("root").agg(F.min(F.struct(F.col(k).isNull(), F.col(k).alias("key"), F.col("version").alias("version"))).alias("best")).select("best.key", "best.version")
    met = plain.withColumn("version", F.xxhash64(t)).join(best, F.col(k).eqNullSafe(best["key"]) & (F.xxhash64(t) == best["version"])).select(*plain.columns, best["version"])
    # Combined before the shuffle, so that rows without a key and a text are not one task's.
    return restored(met.dropDuplicates([k, "version"]))
