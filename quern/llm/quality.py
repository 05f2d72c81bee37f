"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit per failed rule; policies are
versions of a bit mask, applied to the ledger without looking at the text again, and the effect of leaving a rule out of a
policy (its ablation) comes from grouping the ledger by its bits.

Nulls and empty texts have no words, so they fail `few_words`. Ties and repeated rows are judged row by row. keep() returns the
columns of its input, whatever their names; in the ledger a carried column that is called like one of its own is replaced by that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import BLANKS, by_rows, positional, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Measurements, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")

_letters = regex.compile(r"\p{L}+")
_capitals = regex.compile(r"\p{Lu}+")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | str


#: A rule's bit is its place in this list; new rules go to the end, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 15 * n_words"),
    Rule("capitals", "n_letters >= 20 and 100 * n_capitals > 70 * n_letters"),
    Rule("short_words", "10 * word_chars < 15 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("few_letters", "100 * n_letters < 40 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
)

#: Versions of the policy: the rules that count. Version 1 is the base.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "capitals", "repeated_lines"),
    3: tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def repeated(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more.

    Windows are numbered by doubling: equal numbers of two halves make equal numbers of the whole, so nothing is hashed.
    """
    if len(ids) <= WINDOW:
        return 0
    span, number = 1, ids
    while span < WINDOW:
        pairs = number[:-span] * (int(number.max()) + 1) + number[span:]
        _, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return 0
        span *= 2
    starts = np.flatnonzero(counts[number] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text."""
    if not text:
        return (0,) * len(MEASURES)
    found = words(text)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(found),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(ids) if len(numbers) < len(found) else 0,
        sum(map(len, _letters.findall(text))),
        sum(map(len, _capitals.findall(text))),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in carry, the measurements and `fail_bits` of every row."""
    made = ", ".join(f"{m} long" for m in MEASURES)
    measured = by_rows(docs, [text], [key, *carry], lambda texts: list(map(list, zip(*map(measure, texts), strict=True))), made)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def fails(version: int) -> Column:
    """Whether the ledger's row fails the policy of that version."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) != 0


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents kept, kept without the rule, and rejected by the rule alone.

    Only counts by fail_bits are shuffled: at most 2 ** len(RULES) rows, however many documents there are.
    """
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(mask((n,))).cast("long").alias("bit")) for v, p in POLICIES.items() for n in p])
    each = counts.select("fail_bits", "n", F.inline(cases))
    left = F.col("fail_bits").bitwiseAND(F.col("mask"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("version", "rule").agg(
        n(left == 0).alias("kept"), n(left.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"), n(left == F.col("bit")).alias("rejected_alone")
    )


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", version: int = 3) -> DataFrame:
    """The rows that pass the policy, with the columns they came with."""
    names = docs.columns
    plain, restored = positional(docs)
    place = {c: f"__{i}" for i, c in enumerate(names)}
    marked = ledger(plain, place[key], place[text], tuple(p for c, p in place.items() if c != key))
    return restored(marked.filter(~fails(version)))
