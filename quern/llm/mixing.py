"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

The words of all documents are shared out among the sources by weight; no source may get more than MOST times its own words,
and what it cannot take is shared among the others. A document's expected number of copies is the ratio of its source's target
to the source's words, or in proportion to a weight of its own, if one is named, but never more than MOST. Whole copies are certain;
the fraction is an inclusion probability, and documents are ranked by random odds divided by inclusion odds. The first ones in that
order get one more copy until the source's remaining words are used up.

The order is not sorted in one task: a histogram of ranks finds where the words run out, twice more finely, and only the
documents of the last cell are put in order. Random numbers are hashes of key and seed, so reruns agree.

Weights are few classes, such as grades of quality: a table has a row for each class of each source. Null weights and those below 0
count as 0, and documents of weight 0 are never taken, nor is a source without another.

Null and empty texts have size 0 and fill nothing. A null source is a source, the last one. Rows that repeat a key have the
same random number; the larger size comes first. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import n_words, positional
from quern.session import checkpointed

MOST, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"
#: Cells of a histogram, and of the finer one within one of its cells.
CELLS = 1024


def uniform(key: str, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): water filling, solved at once after sorting the sources by when they are full.

    The table has a row for each source, so its windows over all rows stay small.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("turn", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("turn") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "turn")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = listed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("below"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = full.withColumn("level", (F.col("total") - MOST * F.col("below")) / F.col("rest"))
    # The water level is that of the first source, in order of filling, which it does not fill.
    open_ = F.when(F.col("level") * F.col("weight") <= MOST * F.col("source_size"), F.col("level"))
    flat = level.withColumn("water", F.min(F.when(open_.isNotNull(), F.struct(F.col("source_size") / F.col("weight"), F.col("turn"), open_.alias("level")))).over(everything)["level"])
    return flat.select("source", "source_size", F.least(F.coalesce(F.col("water") * F.col("weight"), F.lit(float("inf"))), (MOST * F.col("source_size")).cast("double")).alias("target"))


def expectations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(source, weight, source_size, target, expected, left): copies of the documents of a class, and the words that whole copies leave.

    Copies are in proportion to the weight, and MOST where that would be more, which leaves more for the others; solved like targets().
    The table has a row for each class of each source.
    """
    classes = rows.groupBy("source", "weight").agg(F.sum("size").alias("words")).join(known.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    every = Window.partitionBy("source")
    order = every.orderBy(F.desc("weight"))
    full = classes.withColumn("above", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = F.sum(F.col("weight") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = full.withColumn("level", F.when(rest > 0, (F.col("target") - MOST * F.col("above")) / rest))
    # Classes are full from the top; the level is that of the first one which it does not fill.
    open_ = F.when(F.col("level") * F.col("weight") <= MOST, F.struct(-F.col("weight"), F.col("level").alias("level")))
    flat = level.withColumn("open", F.min(open_).over(every)["level"])
    # Where all are full, they are; a weight of 0 has no copies.
    expected = F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(F.coalesce(F.col("open"), F.lit(float("inf"))) * F.col("weight"), F.lit(float(MOST))))
    done = flat.withColumn("expected", F.when(F.col("words") > 0, expected).otherwise(F.lit(0.0)))
    return done.select("source", "weight", "source_size", "target", "expected", (F.col("target") - F.sum(F.floor("expected") * F.col("words")).over(every)).alias("left"))


def mix(rows: DataFrame, key: str, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """rows has key, `source` and `size`, and maybe a weight; adds source_size, target, `copies` and `taken`."""
    names = rows.columns
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    weighed = rows.withColumn("__weight", own)
    known = expectations(weighed.select("source", "size", F.col("__weight").alias("weight")), targets(rows)).withColumnsRenamed({"source": "its_source", "weight": "its_weight"})
    joined = weighed.join(known, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("__weight") == F.col("its_weight"))).drop("its_source", "its_weight", "__weight")
    u = uniform(key, seed)
    part = F.col("expected") - F.col("whole")
    rank = (u / (1 - u)) / (part / (1 - part))
    ranked = joined.withColumn("whole", F.floor("expected")).withColumn("open", part > 0).withColumn("rank", F.when(F.col("open"), rank / (1 + rank)).otherwise(F.lit(1.0)))
    ranked = checkpointed(ranked.withColumn("cell", F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1))).withColumn("fine", F.least(F.floor(F.col("rank") * CELLS * CELLS), F.lit(CELLS * CELLS - 1))))

    def cells(of: DataFrame, cell: str, before: str) -> DataFrame:
        """For each source and cell: words in earlier cells, besides `before` of those met above, and in the cell."""
        order = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return of.groupBy("source", cell).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first(before).alias("start")).select(F.col("source").alias("s"), F.col(cell).alias("c"), "words", (F.col("start") + F.coalesce(F.sum("words").over(order), F.lit(0))).alias("from"))

    def placed(of: DataFrame, cell: str, before: str) -> DataFrame:
        """of with `from`, and whether its cell is wholly taken (1), wholly left (0) or neither (null)."""
        at = cells(of, cell, before)
        met = of.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(cell) == F.col("c")))
        verdict = F.when(F.col("from") + F.col("words") <= F.col("left"), 1).when(F.col("from") > F.col("left"), 0)
        return met.withColumn("more", verdict).drop("s", "c", "words")

    candidates = ranked.filter("open").withColumn("zero", F.lit(0).cast("long"))
    first = checkpointed(placed(candidates, "cell", "zero"))
    second = placed(first.filter("more is null").withColumnRenamed("from", "from_cell").drop("more"), "fine", "from_cell")
    second = checkpointed(second.drop("from_cell"))
    order = Window.partitionBy("source").orderBy("rank", key, F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = second.filter("more is null").withColumn("done", F.col("from") + F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("more", (F.col("done") + F.col("size") / 2 <= F.col("left")).cast("int"))
    kept = [*names, "source_size", "target", "whole", "more"]
    parts = [ranked.filter("not open").withColumn("more", F.lit(0)), first.filter("more is not null"), second.filter("more is not null"), last]
    out = parts[0].select(*kept)
    for p in parts[1:]:
        out = out.union(p.select(*kept))
    copies = (F.col("whole") + F.col("more")).cast("long")
    return out.select(*names, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, `source` and `size`, the table that mix() takes; the only pass over the texts."""
    return docs.select(F.col(key), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *carry)


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """key, source, size, source_size, target, copies and taken of every document, and the weight if one is named."""
    return mix(checkpointed(sizes(docs, key, text, source, (weight,) if weight else ())), key, weight=weight)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: docs with each row as often as it is copied."""
    plain, restored = positional(docs)
    k, t, s = (f"__{docs.columns.index(c)}" for c in (key, text, source))
    rows = checkpointed(sizes(plain, k, t, s, (F.xxhash64(t).alias("version"),)))
    copies = mix(rows, k).filter("copies > 0").groupBy(F.col(k).alias("key"), "source", "version").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    met = plain.withColumn("version", F.xxhash64(t)).join(copies, F.col(k).eqNullSafe(copies["key"]) & F.col(s).eqNullSafe(copies["source"]) & (F.xxhash64(t) == copies["version"]))
    return restored(met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("copies div n")))))
