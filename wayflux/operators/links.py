"""Link tables: subsets, initial state, costs, congestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.functions import road


def require(frame: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def select_class(links: DataFrame, nodes: DataFrame, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Links of the given classes and the nodes that they touch."""
    chosen = links.filter(F.col(column).isin(*values))
    ends = chosen.select(F.col("from_id").alias("node_id")).union(chosen.select("to_id"))
    return chosen, nodes.join(ends, "node_id", "left_semi")


def drop_dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links both of whose ends are known nodes."""
    known = lambda end: nodes.select(F.col("node_id").alias(end))
    return links.join(known("from_id"), "from_id", "left_semi").join(known("to_id"), "to_id", "left_semi")


def classify(links: DataFrame) -> DataFrame:
    return links.withColumn("combined_label", road.combined_label(F.col("road_classification"), F.col("form_of_way")))


def with_speeds(links: DataFrame, parameters: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    """Class speeds, urban limits, and the restriction (e_id, max_speed) of an event; closed links go.

    ``parameters`` has one row per class; it is joined as is, and small enough for Spark to broadcast by its size.
    """
    require(links, "combined_label", "urban")
    out = links.join(parameters, "combined_label", "left")
    free = F.when(F.col("urban") == 1, F.col("urban_speed")).otherwise(F.col("free_flow_speed"))
    out = out.withColumn("free_flow_speeds", free).withColumnRenamed("min_speed", "min_flow_speeds").withColumnRenamed("breakpoint_flow", "breakpoint_flows")
    if restricted is None:
        return out.withColumn("initial_flow_speeds", F.col("free_flow_speeds"))
    out = out.join(restricted, "e_id", "left")
    out = out.withColumn("initial_flow_speeds", road.initial_speed(F.col("free_flow_speeds"), F.col("min_flow_speeds"), F.col("max_speed")))
    return out.filter("initial_flow_speeds > 0")


def initialise(links: DataFrame, capacity_factor: float = 1.0) -> DataFrame:
    """No flow yet, a day's capacity from lanes and class, current speed; links without capacity go."""
    out = links.withColumn("acc_flow", F.lit(0.0)).withColumn("acc_capacity", F.col("capacity_plph") * F.col("lanes") * 24 * capacity_factor)
    if "current_capacity" not in out.columns:
        out = out.withColumn("current_capacity", F.col("acc_capacity"))
    return out.withColumn("acc_speed", F.col("initial_flow_speeds")).filter("acc_capacity > 0.5")


def with_costs(links: DataFrame, vehicle: str) -> DataFrame:
    """Miles, hours, time and operating cost and the weight that routing minimises."""
    out = links.withColumn("length_mile", F.col("length_m") * road.METRE_TO_MILE)
    out = out.withColumn("time_hr", F.try_divide("length_mile", "acc_speed"))
    out = out.withColumn("time_cost", road.time_cost(F.col("time_hr"), vehicle)).withColumn("operating_cost", road.operating_cost(F.col("time_hr"), F.col("length_mile"), vehicle))
    return out.withColumn("weight", F.col("time_cost") + F.col("operating_cost") + F.col("average_toll_cost"))


def with_flow_speed(links: DataFrame) -> DataFrame:
    speed = road.flow_speed(F.col("combined_label"), F.col("acc_flow"), F.col("initial_flow_speeds"), F.col("min_flow_speeds"), F.col("breakpoint_flows"))
    return links.withColumn("acc_speed", speed)


def congestion(links: DataFrame) -> DataFrame:
    """Utilisation, seconds lost per km, and the loss of speed."""
    out = links.withColumn("utilisation", F.try_divide("acc_flow", F.col("acc_flow") + F.col("acc_capacity")))
    lost = (F.try_divide(F.lit(1.0), "acc_speed") - F.try_divide(F.lit(1.0), "initial_flow_speeds")) * 2236.94
    return out.withColumn("time_loss", lost).withColumn("speed_loss", 1 - F.try_divide("acc_speed", "initial_flow_speeds"))


def systematic_sample(rows: DataFrame, key: str, stride: int) -> DataFrame:
    """Every ``stride``-th row in order of a unique integer key, counted within ranges of keys.

    Counting restarts in blocks of keys, offset by the rows before, so no single task sorts the whole table; the blocks
    are counted in blocks of their own, of which one task sees the totals (one for 2 ** 32 keys).
    """
    block = rows.withColumn("__b", F.floor(F.col(key) / 65536))
    sizes = block.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.floor(F.col("__b") / 65536))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy("__c").agg(F.sum("__n").alias("__n"))
    totals = totals.select("__c", before(Window.orderBy("__c")).alias("__whole"))
    inner = sizes.select("__b", "__c", before(Window.partitionBy("__c").orderBy("__b")).alias("__inner"))
    sizes = inner.join(totals, "__c").select("__b", (F.col("__inner") + F.col("__whole")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1 + F.col("__before")
    return block.join(sizes, "__b").withColumn("__place", place).filter(F.col("__place") % stride == 0).select(*rows.columns)


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows with the smallest hashes of key and seed: the same ones in every run."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def min_max_scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; a constant one stays as it is. One row of bounds is joined to all."""
    bounds = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.crossJoin(F.broadcast(bounds))  # exactly one row
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(c, F.when(hi == lo, F.col(c)).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.select(*rows.columns)


def binned(value: Column, thresholds: list[float], names: list[str]) -> Column:
    """The first class whose threshold is at least the value."""
    out = F.when(value <= thresholds[0], names[0])
    for t, n in zip(thresholds[1:], names[1:]):
        out = out.when(value <= t, n)
    return out
