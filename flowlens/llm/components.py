"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed, join_heavy


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
    tied = join_heavy(both.where("v > u"), least, "u", "n", "inner")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_heavy(down, least, "u", "n", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least id that each node of ``edges`` (u, v) reaches.

    Edges are taken in both directions; repeated ones, loops and nulls do no
    harm. Each round halves the longest paths at least, and is cut off from its
    lineage by a checkpoint. A hub's edges are joined where they lie (``join_heavy``).
    """
    now = checkpointed(edges.where("u <> v").select("u", "v").distinct())
    for _ in range(most_rounds):
        now = checkpointed(_small_star(checkpointed(_large_star(now).distinct())))
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        # stars all: no node is both a centre and tied, or tied twice
        if ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least"), F.max("up").alias("most")).where("n > 1 or least <> most").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
