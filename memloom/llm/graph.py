"""Connected components as Spark jobs: alternating large-star and small-star steps.

Each step is an aggregation by node (its least neighbour and how many it has) and a
join back, in which the links of a hub are split over salted copies of its one row,
so they never meet in one task. Steps are written to the shared folder, so lineage
stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm import common


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (u, v): the least id that links reach. Self-links and repeats are fine."""
    now = common.staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        # Large star: a node's greater neighbours move to its least neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = common.salted_join(both.where("v > u"), least.drop("n"), ["u"], least.select("u", "n"), ["v"])
        large = common.staged(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: a node and its lesser neighbours move to the least of them.
        least = common.staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        joined = common.salted_join(large, least.drop("n"), ["u"], least.select("u", "n"), ["v"])
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = common.staged(small, "links")
        after = _state(now)
        if after == state:
            break
        state = after
    # All links are now from a node to its component's least id.
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
