"""Timetables: running days, travel times between stops, co-occurrence of stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.operators import routing


def running_days(trains: DataFrame, first: str, last: str, runs_on: Column, horizon: tuple[str, str] | None = None) -> DataFrame:
    """A row per train and ``day`` between two dates (both included) on whose weekday (0 = Monday) it runs.

    With a ``horizon`` (first and last day, included) only its days count, so that an open range makes no more rows than
    the horizon has days. A range without a start, an end or a day in it gives no row.
    """
    start, end = F.col(first).cast("date"), F.col(last).cast("date")
    if horizon:
        start = F.when(start.isNotNull(), F.greatest(start, F.lit(horizon[0]).cast("date")))
        end = F.when(end.isNotNull(), F.least(end, F.lit(horizon[1]).cast("date")))
    ranged = trains.withColumn("__start", start).withColumn("__end", end).filter("__start <= __end")
    days = ranged.withColumn("day", F.explode(F.sequence("__start", "__end", F.expr("interval 1 day")))).drop("__start", "__end")
    return days.filter(F.get(runs_on, F.weekday("day")) == 1)


def stop_times(stops: DataFrame) -> DataFrame:
    """Seconds from each stop to the train's next one; passing points do not count."""
    w = Window.partitionBy("train_id", "run_date").orderBy("pos")
    held = stops.filter("stop = 'S'").withColumn("before", F.lag(F.struct("station", "t_sec")).over(w))
    taken = F.pmod(F.col("t_sec") - F.col("before.t_sec"), F.lit(86400))
    return held.filter("before is not null").select("train_id", "run_date", "pos", F.col("before.station").alias("from_station"), F.col("station").alias("to_station"), taken.alias("seconds"))


def downstream(stops: DataFrame) -> DataFrame:
    """Distinct pairs of a station and a later one on the same run.

    Each run keeps, per station, its first and last position: a pair exists if the one's first is before the other's last.
    """
    ends = stops.filter("stop = 'S'").groupBy("train_id", "run_date", "station").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    later = ends.select("train_id", "run_date", F.col("station").alias("to_station"), F.col("hi").alias("to_hi"))
    met = ends.join(later, ["train_id", "run_date"]).filter((F.col("lo") < F.col("to_hi")) & (F.col("station") != F.col("to_station")))
    return met.select(F.col("station").alias("from_station"), "to_station").distinct()


def trains_between(stops: DataFrame, od: DataFrame) -> DataFrame:
    """Per pair the sorted ids of the trains that stop at both ends; pairs without one keep an empty list."""
    at = stops.filter("stop = 'S'").select("train_id", "station").distinct()
    one = od.join(at.withColumnRenamed("station", "origin"), "origin")
    both = one.join(at.withColumnRenamed("station", "destination"), ["destination", "train_id"])
    held = both.groupBy("origin", "destination").agg(F.sort_array(F.collect_set("train_id")).alias("trains"))
    empty = F.array().cast(held.schema["trains"].dataType)
    return od.join(held, ["origin", "destination"], "left").withColumn("trains", F.coalesce("trains", empty))


def edge_speeds(links: DataFrame, times: DataFrame, most: float = 50.0) -> DataFrame:
    """e_id, fast, middle: the greatest and the median of the distinct speeds (m/s) of trains over each link.

    times(from_station, to_station, seconds) are runs between stations, which are nodes of links(e_id, from_id, to_id,
    weight in metres). The fastest run of a pair takes its shortest path: length by time is the speed on every link of
    it. Speeds above ``most`` and pairs without a path count for nothing.
    """
    fastest = times.filter("seconds > 0").groupBy(F.col("from_station").alias("origin_node"), F.col("to_station").alias("destination_node")).agg(F.min("seconds").alias("seconds"))
    found = routing.least_cost_paths(links, fastest).join(fastest, ["origin_node", "destination_node"])
    speeds = found.withColumn("speed", F.col("cost") / F.col("seconds")).filter(F.col("speed") <= most)
    speeds = speeds.select(F.explode("path").alias("e_id"), "speed").distinct()
    return speeds.groupBy("e_id").agg(F.max("speed").alias("fast"), F.median("speed").alias("middle"))


def all_or_nothing(links: DataFrame, od: DataFrame, scenarios: list[str], baseline: str) -> DataFrame:
    """e_id, and per scenario half the flow on each link, its gain over the baseline, and volume over capacity.

    ``od`` has a column of flow per scenario and one for the baseline; pairs are routed once. Every link is there.
    """
    flows = [*dict.fromkeys([baseline, *scenarios])]
    pairs = od.groupBy("origin_node", "destination_node").agg(*[F.sum(c).alias(c) for c in flows])
    routed = routing.least_cost_paths(links, pairs).join(pairs, ["origin_node", "destination_node"])
    edge = routed.select(F.explode("path").alias("e_id"), *flows).groupBy("e_id").agg(*[(F.sum(c).cast("double") / 2).alias(f"flow_{c}") for c in flows])
    out = links.select("e_id", "capacity").join(edge, "e_id", "left").fillna(0.0, [f"flow_{c}" for c in flows])
    out = out.withColumns({f"gain_{c}": F.col(f"flow_{c}") - F.col(f"flow_{baseline}") for c in scenarios})
    return out.withColumns({f"vc_{c}": F.try_divide(f"flow_{c}", F.col("capacity").cast("double")) for c in flows}).drop("capacity")
