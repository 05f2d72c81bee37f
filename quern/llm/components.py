"""Connected components of a link table by alternating large and small stars, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each node, combined before the shuffle.

    It is checkpointed, so that the join that follows reads two plain shuffles and AQE can split the links of a hub.
    """
    return checkpointed(links.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node that it knows."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links goes from larger to smaller nodes; each node joins its smaller neighbours, and itself, to the smallest."""
    least = _least(links)
    joined = links.join(least, "u")
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that a row (u, v) of links names; root is the smallest node of its component.

    Every round is checkpointed, so its plan doesn't grow and a lost executor costs one round. Self links count for nothing.
    Rounds grow with the logarithm of the component's diameter; it is an error if most_rounds don't suffice.
    """
    now = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
        mark = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
