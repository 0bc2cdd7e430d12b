"""Iterative graph jobs as checkpointed DataFrame loops."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint

#: Edges that make it worth to run one more task.
TASK_EDGES = 1 << 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to itself and to its smaller neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("least").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node it reaches) for every node that an edge between two nodes touches.

    Alternating large-star and small-star steps; the edges between steps are checkpointed, so a lost executor costs
    one step. Only two numbers a round reach the driver, and the number of edges decides how many tasks a step is worth.
    Null ends and loops are left out.
    """
    links = checkpoint(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == now or not now["n"]:
            break
        seen = now
        tasks = ceil(now["n"] / TASK_EDGES)  # no more than there are partitions
        large = _large_star(links.coalesce(tasks)).coalesce(tasks)
        links = checkpoint(_small_star(large).coalesce(tasks).distinct().coalesce(tasks))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
