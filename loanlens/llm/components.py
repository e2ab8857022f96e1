"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """node, least: the smallest of the node and its neighbours. Sums up before the shuffle, so hubs are no load."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "node")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a, b). Labels need a number of rounds that grows
    with the logarithm of a component's size; hubs are split by Spark's skewed joins."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both)
        large = both.join(least, both.a == least.node).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Each node now sees smaller ones only; they and the node go to the smallest of them.
        down = large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
        joined = large.join(down, large.a == down.node)
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            down.select(F.col("node").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()
        edges = staged(small, "stars")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == before:
            break
        before = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
