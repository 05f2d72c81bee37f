"""Collections of posting lists as tables: documents, postings, terms, blocks and shards.

A collection is a set of DataFrames. Terms may be numbers or strings. Positions within a list are never counted in one task
for a whole list: lists are cut by document range, counted in parts, and the parts' totals are added up.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scoring import Bm25, Scorer
from quern.functions.sizes import vbyte_bytes
from quern.session import checkpointed

BLOCK, SHARDS, K = 128, 8, 10
#: Neighbouring document numbers of a cell, the unit in which ranked queries skip documents.
CELL = 16
TOKEN = r"[^\p{L}\p{N}]+"
#: Most documents of a range in which the postings of a list are counted by one task.
STRETCH = 1 << 20
#: Most postings of a list that is counted whole by one task.
HEAVY = 1 << 18
#: Bytes of a part, and the size from which on an estimate is none.
PART, UNKNOWN = 64 << 20, 1 << 60
#: Most parts for each task that runs at once.
WAVES = 16
#: Bytes of a table's files in a part of a collection. A part's rows with queries' terms are added up in the memory of one task.
INPUT_PART = 8 << 20
#: Most rows of a batch's query terms that are sent to all tasks; they are counted before.
FEW = 1 << 17


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, or that of all that df is made of if it is less: a join's estimate is a product."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    made_of = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), made_of)


def parts_of(df: DataFrame, part: int = PART) -> int:
    """As many parts as the session runs at once, more of about part bytes for a larger df, but no more than WAVES times those it
    runs at once, as an estimate may be far too high. The size is the optimizer's estimate; no job runs."""
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = estimated_bytes(df)
    return min(max(least, size // part), WAVES * least) if size < UNKNOWN else least


def spread(df: DataFrame, *keys: str, part: int = PART) -> DataFrame:
    """df in parts_of(df, part) parts by keys, so that grouping by them and others needs no further shuffle."""
    return df.repartition(parts_of(df, part), *keys)


def few(df: DataFrame) -> DataFrame:
    """df, which must be cheap to count, to be sent to all tasks if it has no more than FEW rows.

    A table with the lists of a batch's terms then stays where it lies: by documents, so that sums by document need no shuffle, and a
    term that every document holds is not one task's.
    """
    return df.hint("broadcast") if df.limit(FEW + 1).count() <= FEW else df


#: Where the bits of a hash begin that choose a bit of each mark.
MARKS = {1: 0, 2: 6}


def _bit(i: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(term), {MARKS[i]}) & 63 as int))")


def marked(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, term, ...), unique by both, with `n_terms` of the key, and `mark1` and `mark2`: bits of the hashes of its terms.

    The marks of a key with all terms of another hold all bits of its marks.
    """
    bits = rows.select(key, _bit(1).alias("bit1"), _bit(2).alias("bit2"))
    every = bits.groupBy(key).agg(F.count("*").alias("n_terms"), F.bit_or("bit1").alias("mark1"), F.bit_or("bit2").alias("mark2"))
    return rows.join(every.hint("shuffle_hash"), key)


def others(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, term, ...), unique by both, with `mark1` and `mark2` of the other terms of the same key.

    Two keys with a second term in common have a bit in common in both marks of either term. The term's own bit stays where another
    term of the key may have it too, so marks may tell of terms that are not there, but never miss one.
    """
    own = lambda i: F.when(F.bit_count(f"mark{i}") == F.col("n_terms"), F.bitwise_not(_bit(i))).otherwise(F.lit(-1).cast("long"))
    return marked(rows, key).withColumns({f"mark{i}": F.col(f"mark{i}").bitwiseAND(own(i)) for i in MARKS}).drop("n_terms")


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, term), a row for each token of the lower-case text; null and empty texts have none."""
    parts = F.explode(F.split(F.lower("text"), TOKEN))
    return spread(texts.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", part=INPUT_PART).select("doc_id", parts.alias("term")).filter("term <> ''")


def count_tokens(found: DataFrame) -> DataFrame:
    """(term, doc_id, freq) of token rows."""
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("freq")).select("term", "doc_id", "freq")


@dataclass
class Index:
    """postings(term, doc_id, freq), unique by term and doc_id, and docs(doc_id, len) with every document of the collection."""

    postings: DataFrame
    docs: DataFrame
    scorer: Scorer = field(default_factory=Bm25)
    shards: int = SHARDS
    block: int = BLOCK
    k: int = K
    cuts: list[int] | None = None
    held: bool = False
    #: Parts in which its postings are dealt; by an estimate if None.
    parts: int | None = None

    @cached_property
    def _facts(self) -> tuple[int, float, int, int]:
        n, mean, least, most = self.docs.agg(F.count("*"), F.avg("len"), F.min("doc_id"), F.max("doc_id")).first()
        return n, mean or 1.0, least or 0, most or 0

    @property
    def n_docs(self) -> int:
        return self._facts[0]

    @property
    def universe(self) -> int:
        """The number after the last document's."""
        return self._facts[3] + 1

    def dealt(self, rows: DataFrame, *keys: str, share: int = 1) -> DataFrame:
        """rows, about share times as many as postings, in parts by keys."""
        return rows.repartition(share * (self.parts or parts_of(self.postings)), *keys)

    @property
    def lengths(self) -> DataFrame:
        """docs with `norm_len`, the length relative to the mean over all documents."""
        return self.docs.withColumn("norm_len", F.col("len") / self._facts[1])

    @cached_property
    def weighted(self) -> DataFrame:
        """postings with `weight`."""
        met = self.postings.join(self.lengths.select("doc_id", "norm_len").hint("shuffle_hash"), "doc_id")
        return met.select("term", "doc_id", "freq", self.scorer.doc_weight(F.col("freq"), F.col("norm_len")).alias("weight"))

    def keep(self) -> Index:
        """Holds postings, and terms and blocks once they are asked for, in the executors' memory and disks for the queries
        that follow."""
        self.held = True
        # Documents are held before they are counted and met, or all of them would be made of their tokens each time.
        self.docs = self.docs.persist()
        self.weighted = self.weighted.persist()
        self.postings = self.weighted.drop("weight")
        return self

    def drop(self) -> None:
        """Lets go of what keep() holds."""
        self.held = False
        for name in ("weighted", "docs", "terms", "blocks", "cells", "kths"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    def only(self, wanted: DataFrame) -> Index:
        """The collection's lists of the terms in wanted(term); documents, lengths and shards stay those of the whole.

        What a query needs of terms, blocks and thresholds is then computed from its own lists alone.
        """
        terms = few(checkpointed(wanted.select("term").distinct()))
        part = Index(self.postings.join(terms, "term", "left_semi"), self.docs, self.scorer, self.shards, self.block, self.k, self.cuts, parts=self.parts)
        part._facts = self._facts
        if self.held:
            part.weighted = self.weighted.join(terms, "term", "left_semi")
            for name in ("terms", "blocks", "cells"):
                if name in self.__dict__:  # some query has asked for those of all lists
                    setattr(part, name, self.__dict__[name].join(terms, "term", "left_semi"))
        return part

    def bounds(self) -> list[int]:
        """Shard f holds the documents from bounds[f] up to, but without, bounds[f + 1]; even ranges unless cuts are given."""
        if self.cuts:
            return self.cuts
        _, _, least, most = self._facts
        width = -(-(most - least + 1) // self.shards)
        return [least + f * width for f in range(self.shards + 1)]

    def shard(self, doc: Column) -> Column:
        bounds = self.bounds()
        out = F.lit(0)
        for f in range(1, len(bounds) - 1):
            out = F.when(doc >= bounds[f], F.lit(f)).otherwise(out)
        return out

    def shard_table(self) -> DataFrame:
        bounds = self.bounds()
        rows = [(f, bounds[f], bounds[f + 1]) for f in range(len(bounds) - 1)]
        return self.docs.sparkSession.createDataFrame(rows, "shard_id int, lo_doc long, hi_doc long")

    def unit_weight(self, df: Column) -> Column:
        """Weight of a query term that occurs once."""
        return self.scorer.query_weight(df, self.n_docs)

    @cached_property
    def terms(self) -> DataFrame:
        """(term, df, cf, max_weight): document frequency, occurrences, and the largest posting weight."""
        rows = self.weighted.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf"), F.max("weight").alias("max_weight"))
        return rows.persist() if self.held else rows

    @cached_property
    def positioned(self) -> DataFrame:
        """Weighted postings with `ordinal` in their list, `prev_doc` (-1 for the first) and `block_id`.

        Lists of more than HEAVY postings are counted by ranges of documents, a shard or STRETCH numbers wide, so no task counts more
        postings of a list than that; their ranges' totals, few rows, are sent to all tasks.
        """
        bounds = self.bounds()
        width = max(1, min(STRETCH, -(-(bounds[-1] - bounds[0]) // self.shards)))
        heavy = checkpointed(self.terms.filter(F.col("df") > HEAVY).select("term", F.lit(True).alias("heavy")))
        keys, own = ["term"], self.weighted
        if heavy.take(1):
            keys = ["term", "range"]
            own = own.join(few(heavy), "term", "left").withColumn("range", F.when(F.col("heavy"), F.expr(f"(doc_id - {bounds[0]}) div {width}"))).drop("heavy")
            order = Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            parts = own.filter("range is not null").groupBy("term", "range").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
            starts = few(checkpointed(parts.select("term", "range", F.sum("n").over(order).alias("start"), F.max("last").over(order).alias("before"))))
        within = Window.partitionBy(*keys).orderBy("doc_id")
        placed = self.dealt(own, *keys).withColumn("ordinal", F.row_number().over(within) - 1).withColumn("prev_doc", F.lag("doc_id").over(within))
        if len(keys) > 1:
            placed = placed.join(starts, keys, "left").withColumn("ordinal", F.coalesce("start", F.lit(0)) + F.col("ordinal")).withColumn("prev_doc", F.coalesce("prev_doc", "before"))
        placed = placed.withColumns({"ordinal": F.col("ordinal").cast("long"), "prev_doc": F.coalesce("prev_doc", F.lit(-1))})
        return placed.select("term", "doc_id", "freq", "weight", "ordinal", "prev_doc", F.expr(f"ordinal div {self.block}").alias("block_id"))

    @cached_property
    def blocks(self) -> DataFrame:
        """(term, block_id, n, first_doc, last_doc, max_weight, bytes): runs of `block` postings; gaps and freqs as vbytes."""
        size = vbyte_bytes(F.col("doc_id") - F.col("prev_doc") - 1) + vbyte_bytes(F.col("freq") - 1)
        rows = self.positioned.groupBy("term", "block_id").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("weight").alias("max_weight"), F.sum(size).alias("bytes")
        )
        return rows.persist() if self.held else rows

    @cached_property
    def cells(self) -> DataFrame:
        """(term, cell, max_weight): the largest weight of a term among the documents of a cell."""
        rows = by_cell(self).groupBy("term", "cell").agg(F.max("weight").alias("max_weight"))
        return rows.persist() if self.held else rows

    def kth_weights(self, by_shard: bool = False, k: int | None = None) -> DataFrame:
        """The k-th largest weight of each term (and shard); terms with fewer postings have none."""
        keys = ["term", "shard_id"] if by_shard else ["term"]
        rows = self.weighted.withColumn("shard_id", self.shard(F.col("doc_id"))) if by_shard else self.weighted
        order = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "doc_id")
        k = k or self.k
        return rows.select(*keys, "weight", "doc_id").withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k).filter(F.col("turn") == k).select(*keys, F.col("weight").alias("kth_weight"))

    @cached_property
    def kths(self) -> DataFrame:
        """kth_weights() of whole lists."""
        rows = self.kth_weights()
        return rows.persist() if self.held else rows

    def thresholds(self, by_shard: bool = False) -> DataFrame:
        """(term, [shard_id,] thresh): the k-th best score that a single occurrence of the term gives; 0 if there is none."""
        keys = ["term", "shard_id"] if by_shard else ["term"]
        every = self.terms.select("term", "df")
        if by_shard:
            every = every.select("*", F.explode(F.array(*map(F.lit, range(len(self.bounds()) - 1)))).alias("shard_id"))
        met = every.join(self.kth_weights(by_shard) if by_shard else self.kths, keys, "left")
        return met.select(*keys, F.coalesce(self.unit_weight(F.col("df")) * F.col("kth_weight"), F.lit(0.0)).alias("thresh"))

    def save(self, path: str) -> None:
        """Freezes the collection: postings sorted by term and document, so that row groups can be skipped by either."""
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        self.docs.write.parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **more) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), **more)


def by_cell(index: Index) -> DataFrame:
    """(term, doc_id, weight, cell), dealt by cell."""
    return index.dealt(index.weighted.select("term", "doc_id", "weight", F.expr(f"doc_id div {CELL}").alias("cell")), "cell")


def from_texts(texts: DataFrame, key: str, text: str, **more) -> Index:
    """A collection of the tokens of texts; documents without a token count with length 0."""
    postings = count_tokens(tokens(texts, key, text))
    # Lengths are counted where the texts lie, so that only their numbers are shuffled.
    words = F.size(F.filter(F.split(F.lower(text), TOKEN), lambda x: x != ""))
    rows = texts.select(F.col(key).alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(words).cast("long").alias("len"))
    own = rows.groupBy("doc_id").agg(F.sum("len").alias("len"))
    docs = texts.select(F.col(key).alias("doc_id")).join(own, "doc_id", "left").select("doc_id", F.coalesce("len", F.lit(0)).alias("len"))
    return Index(postings, docs, **({"parts": parts_of(texts, INPUT_PART)} | more))


def from_tokens(found: DataFrame, **more) -> Index:
    """A collection of rows (doc_id, term), one for each occurrence; only documents that have one are known."""
    postings = count_tokens(spread(found, "doc_id", part=INPUT_PART))
    return Index(postings, postings.groupBy("doc_id").agg(F.sum("freq").alias("len")), **({"parts": parts_of(found, INPUT_PART)} | more))


def balanced_cuts(index: Index, shards: int = SHARDS) -> list[int]:
    """Bounds of shards with about equally many postings: shard f begins with the first document before which lie f parts of them.

    A row for each shard reaches the driver.
    """
    from quern.operators.schedule import running_total

    own = running_total(index.postings.groupBy("doc_id").agg(F.count("*").alias("n")), [F.col("doc_id")], "n", "before")
    total = index.postings.count()
    turns = own.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, range(1, shards))), lambda f: F.col("before") * shards >= f * F.lit(total))).alias("f"))
    got = turns.groupBy("f").agg(F.min("doc_id").alias("lo")).collect()
    _, _, least, most = index._facts
    return [*sorted({least, *(r["lo"] for r in got)}), most + 1]


def invalid_postings(postings: DataFrame) -> DataFrame:
    """Postings that no list may hold: repeated documents, frequencies below one, nulls."""
    bad = postings.groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.min("freq").alias("least"))
    return bad.filter("n > 1 or coalesce(least, 0) < 1 or term is null or doc_id is null")


def next_geq(index: Index, probes: DataFrame) -> DataFrame:
    """For each probe (term, lower): the first document of the list that is not below lower, its place, and null at the end.

    A probe reads the postings of one block.
    """
    at = covering_block(index, probes).select("term", "lower", "block_id")
    met = at.join(index.positioned.select("term", "block_id", "doc_id", "ordinal"), ["term", "block_id"]).filter("doc_id >= lower")
    first = met.groupBy("term", "lower").agg(F.min(F.struct("doc_id", "ordinal")).alias("first"))
    return probes.join(first, ["term", "lower"], "left").select("term", "lower", F.col("first.doc_id").alias("doc_id"), F.col("first.ordinal").alias("ordinal"))


def covering_block(index: Index, probes: DataFrame) -> DataFrame:
    """For each probe (term, lower): the first block whose last document is not below lower, with its bound.

    The documents of a list are cut into as many even stretches as it has blocks. A block belongs to those that it reaches into, two on
    average, and a probe meets the blocks of its own stretch.
    """
    order = Window.partitionBy("term").orderBy("block_id")
    spans = index.blocks.select("term", "block_id", "last_doc", "max_weight", F.coalesce(F.lag("last_doc").over(order) + 1, "first_doc").alias("from"), "first_doc")
    lists = spans.groupBy("term").agg(F.min("first_doc").alias("least"), F.max("last_doc").alias("most"), F.count("*").alias("n"))
    lists = lists.select("term", "least", "most", F.expr("(most - least) div n + 1").alias("width"))
    cell = lambda doc: F.expr(f"({doc} - least) div width")
    reached = spans.join(lists, "term").select("term", "block_id", "last_doc", "max_weight", "from", F.explode(F.sequence(cell("from"), cell("last_doc"))).alias("cell"))
    inside = probes.join(lists, "term").filter("lower <= most").withColumn("at", F.greatest("lower", "least"))
    met = inside.withColumn("cell", cell("at")).join(reached, ["term", "cell"]).filter("at between `from` and last_doc")
    first = met.select("term", "lower", "block_id", "last_doc", "max_weight").distinct()
    return probes.join(first, ["term", "lower"], "left").select("term", "lower", "block_id", "last_doc", "max_weight")


def shard_splits(index: Index) -> DataFrame:
    """(term, shard_id, split_block): the first block to read for a shard; null if the list ends before it."""
    lows = index.bounds()[:-1]
    each = index.blocks.select("term", "block_id", "last_doc", F.explode(F.array(*[F.struct(F.lit(f).alias("shard_id"), F.lit(lo).alias("lo_doc")) for f, lo in enumerate(lows)])).alias("s"))
    return each.groupBy("term", F.col("s.shard_id").alias("shard_id")).agg(F.min(F.when(F.col("last_doc") >= F.col("s.lo_doc"), F.col("block_id"))).alias("split_block"))
