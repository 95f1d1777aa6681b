"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import cut, spread_join

MAX_ROUNDS = 60
#: Neighbours of a node that one task joins.
HUB = 100_000


def _large_star(edges: DataFrame, hubs_possible: bool) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    if not hubs_possible:
        return both.filter("b > a").join(least.drop("n"), "a").select(F.col("m").alias("a"), "b").distinct()
    hubs = least.filter(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    return spread_join(both.filter("b > a"), least.drop("n"), "a", hubs, "b").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to its least neighbour. Rows have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x <> y")
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root for every node that ``edges`` (columns a, b of one ordered type) names; root is the least node reachable.

    Both steps keep the components and use a minimum and a join on one key, never a list of
    neighbours; a hub's rows are pre-aggregated and its join is dealt in parts. Each round's edges are checkpointed. Ends
    when every edge is a root and its leaf; the number of rounds grows with the logarithm of the
    component size. Self-loops and repeated edges are allowed; null ends are dropped.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a < b").distinct()
    edges = cut(edges)
    for _ in range(MAX_ROUNDS):
        n = edges.count()
        if not n:
            break
        edges = cut(_small_star(_large_star(edges, n > HUB)))
        # stars: no node is a leaf of two edges, and no leaf is a root
        leaves = edges.groupBy("b").agg(F.count("*").alias("n"))
        if leaves.filter("n > 1").isEmpty() and edges.select(F.col("a").alias("b")).distinct().join(leaves, "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
