"""Path tables: exploded steps, flows on edges, and one round of capacity-constrained adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.operators.tables import tasks_for

SALTS = 4  # tasks for the pairs of one edge, at least


def collect_paths(steps: DataFrame, key: str = "od_id") -> DataFrame:
    """One row per key with its edges in order; a path is bounded by its number of steps."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "e_id")))
    return steps.groupBy(key).agg(F.transform(ordered, lambda s: s["e_id"]).alias("path"))


def explode_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """A row per path position (pos from 1) and edge; rows with an empty path have none."""
    kept = [c for c in paths.columns if c != path]
    return paths.select(*kept, F.posexplode(path).alias("pos", "e_id")).withColumn("pos", F.col("pos") + 1)


def flow_on_edges(paths: DataFrame, path: str = "path", flow: str = "flow") -> DataFrame:
    """e_id, flow: each occurrence of an edge in a path carries the path's flow."""
    return paths.select(F.explode(path).alias("e_id"), F.col(flow).alias("flow")).groupBy("e_id").agg(F.sum("flow").alias("flow"))


def path_costs(steps: DataFrame, edges: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Sums of edge measures along each path, with the path in order."""
    met = steps.join(edges.select("e_id", *measures), "e_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "e_id"))), lambda s: s["e_id"])
    return met.groupBy(key).agg(ordered.alias("path"), *[F.sum(m).alias(m) for m in measures])


def pair_edge_flow(steps: DataFrame, od: DataFrame) -> DataFrame:
    """e_id, od_id, flow: what each pair sends over each edge. A task's share of pairs does not grow with the table."""
    return steps.repartition(tasks_for(steps), "od_id").join(od.select("od_id", "flow"), "od_id").groupBy("e_id", "od_id").agg(F.sum("flow").alias("flow"))


def adjustment_ratio(pair_flow: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """od_id, ratio: the tightest edge of each pair, least(capacity / total flow, 1). An edge without flow limits nothing.

    ``tasks`` (of ``tasks_for``) keep a task's share from growing with the table; an edge's pairs are dealt over SALTS.
    """
    total = pair_flow.groupBy("e_id").agg(F.sum("flow").alias("total"))
    limit = total.join(edges.select("e_id", "capacity"), "e_id").select("e_id", F.least(F.try_divide(F.col("capacity").cast("double"), F.col("total").cast("double")), F.lit(1.0)).alias("limit"))
    if not tasks:
        return pair_flow.join(limit, "e_id").groupBy("od_id").agg(F.min("limit").alias("ratio"))
    salted = pair_flow.select("e_id", "od_id", F.pmod(F.xxhash64("od_id"), F.lit(SALTS)).alias("salt")).repartition(tasks, "e_id", "salt")
    limits = limit.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(limits, ["e_id", "salt"]).select("od_id", "limit")
    return met.repartition(tasks, "od_id").groupBy("od_id").agg(F.min("limit").alias("ratio"))


def adjusted(od: DataFrame, ratio: DataFrame) -> DataFrame:
    return od.join(ratio, "od_id", "left").withColumn("assigned", F.col("flow") * F.coalesce("ratio", F.lit(1.0))).drop("ratio")


def neighbours_of_origin(od: DataFrame) -> DataFrame:
    """Per origin the destinations in order and the flows to them; both bounded by the network's nodes."""
    pairs = od.groupBy("origin_node", "destination_node").agg(F.sum("flow").alias("flow"))
    listed = pairs.groupBy("origin_node").agg(F.array_sort(F.collect_list(F.struct("destination_node", "flow"))).alias("to"))
    return listed.select("origin_node", F.transform("to", lambda t: t["destination_node"]).alias("destinations"), F.transform("to", lambda t: t["flow"]).alias("flows"))
