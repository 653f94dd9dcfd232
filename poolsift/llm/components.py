"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.session import pin


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of itself and all neighbours."""
    arcs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = arcs.groupBy("u").agg(F.min("v").alias("low"))
    return arcs.filter("v > u").join(least, "u").select(F.least("low", "u").alias("u"), "v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of these."""
    least = links.groupBy("v").agg(F.min("u").alias("low"))
    tied = links.join(least, "v").select(F.col("low").alias("u"), F.col("u").alias("v"))
    return tied.union(least.select(F.col("low").alias("u"), "v")).filter("u < v").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the least node reachable.

    Each round ties every node's larger neighbours, then its smaller ones, to the least it
    knows. Rounds are written to the shared folder, and end when a round changes nothing, that
    is when the links are stars. A hub is one key of a join, which adaptive execution splits.
    """
    links = pin(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    digest = None
    for _ in range(rounds):
        links = pin(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == digest:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        digest = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
