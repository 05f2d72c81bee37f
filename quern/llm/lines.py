"""Line deduplication over overlapping windows of three lines, with DataFrame functions only.

Lines with a word are numbered within their document, each window of three consecutive ones is hashed to 128 bits, and of
every window found more than once only its first occurrence (smallest key, then position) stays. The lines that later occurrences
cover are removed together: overlapping windows merge, blank lines inside a covered stretch go as well.

That is the whole method with long_words=None. By default, one or two lines that already hold more than LONG words are a window too, so
that a repeated passage of that length is found however few lines it has; three lines are a window whatever their length.

Null text stays null, an empty one stays empty; texts of one or two lines change only by a repeated long passage. Rows that
repeat both key and text count as one occurrence and are treated alike. Columns of the input keep their names, whatever they are, but
for those called like an added one, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import WORD, positional
from quern.session import checkpointed

WINDOW = 3
#: Words of which fewer lines than WINDOW must have more to be a window.
LONG = 50
#: Second hash of a line: the first one is xxhash64 of the line alone.
SALT = "line"


def _windows(lines: Column, long_words: int | None) -> Column:
    """Array of (at, last, a, b) for the windows of an array of numbered lines (at, a, b, words)."""

    def window(i: Column, n: int) -> Column:
        hashes = [F.xxhash64(*[F.get(lines, i + k)[h] for k in range(n)]).alias(h) for h in ("a", "b")]
        return F.struct(lines[i]["at"].alias("at"), F.get(lines, i + (n - 1))["at"].alias("last"), *hashes)

    def short(i: Column) -> Column:
        found, held = F.lit(None), F.lit(0)
        tests = []
        for n in range(1, WINDOW):
            held = held + F.get(lines, i + (n - 1))["words"]
            tests.append((held > long_words, window(i, n)))
        for enough, made in reversed(tests):
            found = F.when(enough, made).otherwise(found)
        return found

    whole = F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), lambda i: window(i, WINDOW))
    if long_words is None:
        return F.when(F.size(lines) >= WINDOW, whole)
    long_ = F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), short), lambda w: w.isNotNull())
    return F.when(F.size(lines) >= WINDOW, F.concat(whole, long_)).when(F.size(lines) > 0, long_)


def occurrences(docs: DataFrame, key: str, text: str, long_words: int | None = LONG) -> DataFrame:
    """One row (key, version, at, last, a, b) for each window; version tells apart texts that share a key."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(SALT), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    numbered = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    return numbered.select("key", "version", F.inline(_windows(F.col("lines"), long_words)))


def covered(docs: DataFrame, key: str, text: str, long_words: int | None = LONG) -> DataFrame:
    """(key, version, gone): the positions of the lines to remove, for documents that lose any.

    The first occurrence of a window is a minimum, so it is combined before the shuffle however common the window is; the way
    back is a sort-merge join, whose hot windows AQE can split.
    """
    found = checkpointed(occurrences(docs, key, text, long_words))
    place = F.struct("key", "version", "at")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first.hint("merge"), ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("key", "version", F.explode(F.sequence("at", "last")).alias("line")).groupBy("key", "version").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bare: bool = False, long_words: int | None = LONG) -> DataFrame:
    """docs with the repeated lines taken out of text, and, unless bare, the columns `n_lines` and `n_removed`."""
    plain, restored = positional(docs)
    k, t = (f"__{docs.columns.index(c)}" for c in (key, text))
    gone = covered(plain, k, t, long_words)
    met = F.col(k).eqNullSafe(gone["key"]) & (F.xxhash64(t) == gone["version"])
    both = plain.join(gone.hint("shuffle_hash"), met, "left").select(*plain.columns, "gone")
    split = both.withColumn("lines", F.split(t, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    done = split.withColumns(
        {
            t: F.when(F.col("gone").isNull(), F.col(t)).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")),
            "n_lines": F.coalesce(F.size("lines"), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        }
    )
    added = ("n_lines", "n_removed")
    return restored(done) if bare else done.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added], *added)
