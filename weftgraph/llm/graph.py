"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import store


def is_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) with v < u join every node to its component's least node already."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    roles = roles.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.filter("up > 1 or up > 0 and down > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) of every node of edges (u, v).

    Each step only joins a node with the minimum of its neighbours, which is combined before the
    shuffle; no group is gathered in one task, and nothing comes to the driver but one count.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = store.save(now, f"{path}/start")
    for step in range(rounds):
        if is_stars(now):
            break
        # large star: every larger neighbour of a node is linked with the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = store.save(now, f"{path}/large{step}")
        # small star: every smaller neighbour, and the node itself, is linked with the least of them
        down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = store.save(joined.filter("u <> v").distinct(), f"{path}/small{step}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
