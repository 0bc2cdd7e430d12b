"""Streaming forms of two batch jobs: running edge flows by purpose, and trips that use disrupted links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_edge_flow(trips: DataFrame, shares: DataFrame) -> DataFrame:
    """Σ flow · share per edge and purpose over arriving trips(kind, path, flow); for complete or update mode.

    ``shares`` is a static (kind, purpose, share), a row for each purpose, and broadcast: trips dealt by kind would meet in a few
    tasks. Kinds it lacks are of the purpose 'unknown'.
    """
    met = trips.join(F.broadcast(shares), "kind", "left").withColumn("purpose", F.coalesce("purpose", F.lit("unknown")))
    met = met.withColumn("flow", F.col("flow") * F.coalesce("share", F.lit(1.0)))
    return met.select(F.explode("path").alias("e_id"), "purpose", "flow").groupBy("e_id", "purpose").agg(F.sum("flow").alias("flow"))


def disrupted_trips(trips: DataFrame, disrupted: DataFrame) -> DataFrame:
    """Arriving trips(od_id, path, flow) exploded and joined to a static table of links: rows (od_id, e_id, flow)."""
    return trips.select("od_id", "flow", F.explode(F.array_distinct("path")).alias("e_id")).join(disrupted.select("e_id"), "e_id", "left_semi")
