"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014).

Each round replaces links by links to the smallest known neighbour; stars remain when nothing changes. A node's links
are only joined and aggregated, never gathered, so a node may have any number of them. Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import Staging


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("x"), "m")


def _small(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the smallest of them. links: a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(low, "a").select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m"))


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))


def _stars(links: DataFrame) -> bool:
    """Every node has one link down, or is the centre of links only."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("down")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("down")))
    each = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count_if(F.col("down") == 0).alias("up"))
    return each.filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(links: DataFrame, staging: Staging, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. links: a, b of one orderable type."""
    now = staging.write(_down(links.select(F.col("a").alias("x"), F.col("b").alias("m"))).distinct(), "links")
    for _ in range(rounds):
        if _stars(now):
            break
        after = staging.write(_down(_small(_down(_large(now)))).distinct(), "stars")
        staging.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
