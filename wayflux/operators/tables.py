"""Joins, set work and numbering that the pipelines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint

BINS = 4096  # of a pass that narrows a median down
TASK_ROWS = 2**18  # rows that a task sorts or gathers at a time


def tasks_for(rows: DataFrame) -> int:
    """Tasks for ``rows`` so that what one of them sorts and gathers does not grow with the table; rows are counted once."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers from 1 in order of distinct keys, without sorting all keys in one task.

    Keys are range-partitioned; each range is numbered on its own, from the number of keys in the ranges before it.
    """
    placed = keys.select(key).distinct().repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    placed = checkpoint(placed)  # the bounds of ranges come from a sample: they are fixed once here
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__least"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # one row per range
    number = F.row_number().over(Window.partitionBy("__part").orderBy(key)) + F.col("__before")
    return placed.join(sizes, "__part").select(key, number.alias(name))


def running_total(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``upto`` (the sum of value in order within the key, the row's own included) and the key's ``total``.

    Rows are ranged by key and order, so that a key of many rows stands in many tasks; each adds what stands before it.
    Values are whole numbers or decimals, whose sums do not depend on the partitioning; a null counts as 0.
    """
    held = rows.withColumn(value, F.coalesce(value, F.lit(0).cast(rows.schema[value].dataType)))
    placed = checkpoint(held.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()))  # bounds come from a sample: fixed once
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(sums.schema["__n"].dataType)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), zero)).withColumn("total", F.sum("__n").over(Window.partitionBy("__key"))).drop("__n")
    inside = F.sum(value).over(Window.partitionBy(key, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = placed.withColumn("upto", inside).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("upto", F.col("upto") + F.col("__before")).drop("__part", "__key", "__p", "__before")


def exact_median(rows: DataFrame, value: str) -> float | None:
    """The median of a column, the middle of the two middle values for an even number; None without values.

    The range that holds the middle is cut into bins over and over; a pass counts them map-side and at most ``BINS`` + 1
    rows reach the driver, however many values there are. Null, NaN and infinite values are not there.
    """
    v = F.col("v")
    held = rows.select(F.col(value).cast("double").alias("v")).filter(F.abs(v) < float("inf"))
    one = held.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not one["n"]:
        return None
    low, high, first, second = one["low"], one["high"], (one["n"] - 1) // 2, one["n"] // 2  # ranks among the values from low to high
    while low < high:
        part = F.try_divide(v / 2 - F.lit(low) / 2, F.lit(high) / 2 - F.lit(low) / 2)
        bins = F.coalesce(F.floor(part * BINS), F.when(v > low, BINS).otherwise(0))
        counted = held.filter(v.between(low, high)).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counts = sorted(counted.collect(), key=lambda r: r["bin"])
        for b, after in zip(counts, [*counts[1:], None]):
            if first < b["n"] <= second:  # the two middle values are neighbours in two bins
                return b["high"] / 2 + after["low"] / 2
            if first < b["n"]:
                low, high = b["low"], b["high"]
                break
            first, second = first - b["n"], second - b["n"]
    return low


def missing_either(pairs: DataFrame, known: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Pairs one of whose ends is not known; null ends are unknown."""
    as_first, as_second = known.select(F.col(key).alias("__a")).distinct(), known.select(F.col(key).alias("__b")).distinct()
    met = pairs.join(as_first, F.col(first) == F.col("__a"), "left").join(as_second, F.col(second) == F.col("__b"), "left")
    return met.filter(F.col("__a").isNull() | F.col("__b").isNull()).drop("__a", "__b")


def overwrite(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``other`` where it has the key and the value is not null, else those of ``rows``."""
    new = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.drop(*[f"__{c}" for c in columns])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__place = 1").drop("__place")


def share_of_group(value: Column, keys: list[str]) -> Column:
    """A value's share of its group's total; 0 where the total is 0."""
    return F.coalesce(F.try_divide(value, F.sum(value).over(Window.partitionBy(*keys))), F.lit(0.0))
