"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import scratch, spread_join


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    tied = spread_join(both.where("b > a"), least, "a", "n", total)
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = spread_join(edges, least, "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node that isn't a root itself.

    edges: two columns of node ids; loops and null ids are left out. Each round
    is written to the shared folder; minima are combined before shuffles and a node
    with very many edges meets them by broadcast, so it is no bottleneck.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    now = scratch(pairs.where("x and y and a <> b").select("a", "b").distinct(), "edges")
    seen = mark(now)
    while True:
        large = scratch(large_star(now, seen[0]), "edges")
        now = scratch(small_star(large, seen[0]), "edges")
        last, seen = seen, mark(now)
        if seen == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
