"""Connected components of a graph given as links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _turned(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = _turned(links)
    least = _least_neighbour(both).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; links run from larger to smaller."""
    least = _least_neighbour(links)
    moved = links.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    ``links`` has two bigint columns a and b; loops, repeats and either direction are
    fine, null ends are ignored. A hub's links are reduced by partial minima, its
    neighbours are split by the adaptive skew join, and each round is stored, so a
    lost executor costs one round at most. Ends when a round changes nothing; the
    number of rounds grows with the logarithm of the longest chain.
    Empty input: empty output.
    """
    now = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or seen["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        mark = seen
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
    raise RuntimeError(f"links still change after {rounds} rounds")
