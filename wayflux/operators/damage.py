"""Flooded segments to damage: depths, levels, fractions, costs, and their roll-ups, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayflux.functions import road


def flood_long(segments: DataFrame) -> DataFrame:
    """One row per segment and flood type from the depth columns of both."""
    both = F.array(*[F.struct(F.lit(t).alias("flood"), F.col(f"depth_{t}_cm").alias("depth_cm")) for t in ("surface", "river")])
    return segments.withColumn("f", F.explode(both)).select("*", "f.flood", "f.depth_cm").drop("f", "depth_surface_cm", "depth_river_cm")


def with_level(rows: DataFrame) -> DataFrame:
    """The damage level of rows (flood, depth_cm, road_label, road_classification, trunk_road)."""
    group = road.road_group(F.col("road_label"), F.col("road_classification"), F.col("trunk_road"))
    level = F.when(F.col("flood") == "surface", road.damage_level("surface", F.col("depth_cm"), group)).otherwise(road.damage_level("river", F.col("depth_cm"), group))
    return rows.withColumn("level", level)


def worst_per_link(levels: DataFrame) -> DataFrame:
    """Highest depth and worst level of each link."""
    worst = levels.groupBy("e_id").agg(F.max("depth_cm").alias("depth_cm"), F.max(road.level_rank(F.col("level"))).alias("rank"))
    return worst.withColumn("level", road.level_name(F.col("rank"))).drop("rank")


def curve_pieces(curves: DataFrame) -> DataFrame:
    """Linear pieces (curve, d0, d1, y0, y1) between the knots of curves(curve, depth, fraction); ends are left open."""
    w = Window.partitionBy("curve").orderBy("depth")  # a curve has a few knots
    ends = curves.select("curve", F.col("depth").alias("d0"), F.lead("depth").over(w).alias("d1"), F.col("fraction").alias("y0"), F.lead("fraction").over(w).alias("y1"))
    first = curves.groupBy("curve").agg(F.min("depth").alias("d1"), F.min_by("fraction", "depth").alias("y1"))
    below = first.select("curve", F.lit(None).cast("double").alias("d0"), "d1", F.col("y1").alias("y0"), "y1")
    return ends.unionByName(below)


def damage_fraction(rows: DataFrame, curves: DataFrame) -> DataFrame:
    """Fraction by linear interpolation of rows (curve, depth); the end values hold outside the knots.

    The pieces are broadcast: there are a few dozen, and rows dealt by their curve would meet in as few tasks as there are curves.
    """
    pieces = curve_pieces(curves).withColumnRenamed("curve", "of")
    inside = (F.col("curve") == F.col("of")) & (F.col("d0").isNull() | (F.col("depth") >= F.col("d0"))) & (F.col("d1").isNull() | (F.col("depth") < F.col("d1")))
    met = rows.join(F.broadcast(pieces), inside, "left")
    slope = (F.col("y1") - F.col("y0")) * (F.col("depth") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    value = F.when(F.col("d0").isNull() | F.col("d1").isNull(), F.col("y0")).otherwise(F.col("y0") + slope)
    return met.withColumn("fraction", value).drop("of", "d0", "d1", "y0", "y1")


def curves_of_group(rows: DataFrame) -> DataFrame:
    """Each row with the two curves of its road group."""
    group = road.road_group(F.col("road_label"), F.col("road_classification"), F.col("trunk_road"))
    pair = F.when(group == "tunnel", F.array(F.lit("C1"), F.lit("C2"))).when(group == "major", F.array(F.lit("C3"), F.lit("C4"))).otherwise(F.array(F.lit("C5"), F.lit("C6")))
    return rows.withColumn("curve", F.explode(pair))


def damage_cost(rows: DataFrame, unit: DataFrame) -> DataFrame:
    """Least, highest and mean cost of rows with a fraction and a level; ``unit`` is (asset, key, lo, hi) and broadcast, a few dozen rows."""
    bridge = F.col("road_label") == "bridge"
    asset = F.when(bridge, F.concat(F.lit("bridge_"), F.col("flood"))).otherwise(F.col("road_label"))
    key = F.when(bridge, F.col("level")).otherwise(road.cost_key(F.col("road_classification"), F.col("form_of_way"), F.col("urban"), F.col("lanes")))
    size = F.when(bridge, F.col("average_width") * F.col("length_m")).otherwise(F.col("length_m") * 1e-3 * F.col("lanes") * F.col("fraction"))
    met = rows.withColumn("asset", asset).withColumn("key", key).join(F.broadcast(unit), ["asset", "key"], "left")
    met = met.withColumn("cost_min", size * F.col("lo")).withColumn("cost_max", size * F.col("hi"))
    return met.withColumn("cost_mean", (F.col("cost_min") + F.col("cost_max")) / 2).drop("asset", "key", "lo", "hi")


def link_damage(costs: DataFrame) -> DataFrame:
    """Per link, flood and curve the sums over its segments; a missing cost counts as none."""
    total = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("cost_min", "cost_max", "cost_mean")]
    return costs.groupBy("e_id", "flood", "curve").agg(*total)


def event_bounds(damage: DataFrame) -> DataFrame:
    """Per flood the sum over links of each link's highest curve (curves exclude one another), and the middle."""
    upper = damage.groupBy("flood", "e_id").agg(F.max("cost_min").alias("cost_min"), F.max("cost_max").alias("cost_max"))
    return upper.groupBy("flood").agg(F.sum("cost_min").alias("cost_min"), F.sum("cost_max").alias("cost_max")).withColumn("cost_mid", (F.col("cost_min") + F.col("cost_max")) / 2)


def bands_table(spark: SparkSession) -> DataFrame:
    """flood, group, low, high, level: the depth bands as a table (open ends are null)."""
    ends = [None, *map(float, road.BANDS), None]
    rows = [(f, g, ends[k], ends[k + 1], level) for (f, g), levels in road.BAND_LEVELS.items() for k, level in enumerate(levels)]
    return spark.createDataFrame(rows, "flood string, group string, low double, high double, band_level string")


def with_band(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows (flood, group, depth_cm) with the level of their band; the band table has a few dozen rows."""
    d = F.col("depth_cm")
    fits = (rows["flood"] == bands["flood"]) & (rows["group"] == bands["group"]) & (F.col("low").isNull() | (d >= F.col("low"))) & (F.col("high").isNull() | (d < F.col("high")))
    return rows.join(F.broadcast(bands), fits & d.isNotNull(), "left").select(rows["*"], "band_level")


def legacy_damage(rows: DataFrame, unit: DataFrame) -> DataFrame:
    """Least and highest over a link's curves of length times unit cost times fraction; ``unit`` is (class, lo, hi)."""
    met = rows.join(F.broadcast(unit), "class")  # a row for each class
    size = F.col("length_m") * F.col("fraction")
    return met.groupBy("e_id").agg(F.max("depth_cm").alias("depth_cm"), F.min(size * F.col("lo")).alias("cost_min"), F.max(size * F.col("hi")).alias("cost_max"))
