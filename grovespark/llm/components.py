"""Connected components of a graph kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links`` (a, b), by alternating large and small stars.

    Each round hangs nodes onto the smallest neighbour and is written to the
    checkpoint folder, so a lost executor costs one round.  Rounds grow with the
    logarithm of the longest path.  A node with very many neighbours is met by
    partial minima and by joins that the engine can split.  An empty table gives an
    empty result; links from a node to itself and repeated links count for nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = fingerprint(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where("m < u").select("u", F.col("m").alias("v"))
        )
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(small_least.select("u", F.col("m").alias("v"))).distinct())
        if (then := fingerprint(now)) == state:
            break
        state = then
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def fingerprint(links: DataFrame) -> tuple:
    """One row whatever the number of links: count and sum of hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
