"""Connected components of a link table, as alternating large and small stars, all in DataFrame operations.

Every round is one table in the shared folder. Hubs are pre-aggregated before the shuffle (their smallest neighbour),
and joins back on them are left to the skew handling of adaptive execution. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cautela.llm.common import Scratch

MAX_ROUNDS = 60


def _stars(links: DataFrame) -> DataFrame:
    """Both steps of a round over links (a > b): neighbours move to the smallest node around them."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(lowest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter(F.col("a") > F.col("b")).distinct()
    parent = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(parent, "a")
    moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") > F.col("b"))
    return moved.union(parent.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (smallest id reachable) of every node that is not its component's smallest.

    ``links`` has columns a and b of one orderable type; loops, repeats and either direction are fine, nulls are left out.
    """
    clean = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, state = scratch.save(clean.distinct()), None
    for _ in range(MAX_ROUNDS):
        following = scratch.save(_stars(current))
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        new_state = tuple(following.agg(F.count("*"), mark).first())
        scratch.drop(current)
        current = following
        if new_state == state:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = new_state
    raise RuntimeError("Components did not settle.")
