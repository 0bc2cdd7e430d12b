"""Recovery of disrupted links: rates by day and level, capacities by scenario, cost of rerouting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Level of damage, first and last day of its recovery, share of the capacity that each of those days restores.
CURVES = [("minor", 10, 15, "0.1670"), ("moderate", 21, 45, "0.0400"), ("extensive", 36, 73, "0.0263"), ("severe", 51, 110, "0.0167")]
DAYS = 110


def recovery_rates(levels: DataFrame, curves: list[tuple[str, int, int, str]] = CURVES, last: int = DAYS) -> DataFrame:
    """level, day (0 to ``last``), rate (two decimals) of levels(level): a share a day from the first to the last day of its curve.

    A level without a curve has no rows. Steps are decimal, so that no rounding adds up.
    """
    day = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    known = levels.sparkSession.createDataFrame(curves, "level string, first long, until long, step string")
    daily = levels.select("level").distinct().join(known, "level").withColumn("day", day)
    gone = F.least(F.greatest(F.col("day") - F.col("first") + 1, F.lit(0)), F.col("until") - F.col("first") + 1)
    return daily.select("level", "day", F.round(F.col("step").cast("decimal(6,4)") * gone.cast("decimal(4,0)"), 2).cast("double").alias("rate"))


def design_long(design: DataFrame) -> DataFrame:
    """scenario, asset, level, rate from columns named asset_level."""
    columns = [c for c in design.columns if c != "scenario"]
    long = design.unpivot("scenario", columns, "name", "rate")
    return long.select("scenario", F.split_part("name", F.lit("_"), F.lit(1)).alias("asset"), F.split_part("name", F.lit("_"), F.lit(2)).alias("level"), "rate")


def recovered_capacity(links: DataFrame, rates: DataFrame) -> DataFrame:
    """Capacity of links(e_id, road_label, level, capacity) per scenario; tunnels recover as roads; none without a rate.

    The rates are broadcast, a row for each scenario, asset and level: links dealt by asset and level would meet in a few tasks.
    """
    asset = F.when(F.col("road_label") == "bridge", "bridge").otherwise("road")
    met = links.withColumn("asset", asset).join(F.broadcast(rates), ["asset", "level"])
    return met.select("e_id", "scenario", (F.col("capacity") * F.col("rate")).alias("capacity"))


def event_day_capacity(links: DataFrame) -> DataFrame:
    """On the event day links with extensive or severe damage are closed."""
    return links.withColumn("capacity", F.when(F.col("level").isin("extensive", "severe"), 0.0).otherwise(F.col("capacity").cast("double")))


def rerouting_cost(links: DataFrame) -> DataFrame:
    """Cost of links(e_id, pre, post, change_flow): what the way round costs more, times the flow; only losses count."""
    return links.withColumn("cost", F.greatest(F.col("post") - F.col("pre"), F.lit(0.0)) * F.col("change_flow")).filter("cost > 0")
