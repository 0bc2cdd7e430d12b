"""Readers and writers of the tables that the pipelines exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header under a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """key, value rows of JSON lines {"key": ..., "value": ...}."""
    return spark.read.schema("key string, value double").json(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """An external database's answer to ``query``; its filters and sums run there."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_with_source(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several Parquet paths with the name of each row's file; corrupt files are passed over (``passed_over`` names them)."""
    frame = spark.read.option("ignoreCorruptFiles", True).parquet(*paths)
    return frame.withColumn("source_file", F.col("_metadata.file_name"))


def passed_over(frame: DataFrame) -> DataFrame:
    """file: the input files of ``read_with_source``'s frame that gave no row, being corrupt or empty."""
    every = frame.sparkSession.createDataFrame([(f.rsplit("/", 1)[-1],) for f in frame.inputFiles()], "file string")
    return every.join(frame.select(F.col("source_file").alias("file")).distinct(), "file", "left_anti")


def write_parquet(frame: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Zstandard Parquet; a table keyed by scenario columns is laid out by them, so that readers prune."""
    writer = frame.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("header", True).csv(path)


def append_parts(frame: DataFrame, path: str) -> None:
    write_parquet(frame, path, mode="append")


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """The parts under ``path`` as about ``files`` files under ``target``."""
    write_parquet(spark.read.parquet(path).repartition(files), target)


def event_catalogue(paths: DataFrame) -> DataFrame:
    """path, flood, event_key of raster paths(path): those with RD and without IE, typed by FLSW or FLRF, keyed by folder."""
    kept = paths.filter(F.col("path").contains("RD") & ~F.col("path").contains("IE"))
    flood = F.when(F.col("path").contains("FLSW"), "surface").when(F.col("path").contains("FLRF"), "river")
    return kept.select("path", flood.alias("flood"), F.element_at(F.split("path", "/"), -2).alias("event_key")).filter("flood is not null")


def with_mask(catalogue: DataFrame, known: DataFrame) -> DataFrame:
    """Each raster with its mask among known(path): the _VE_ sibling under Vector, else the _PR_ one, else null."""
    base = F.regexp_replace("path", "Raster", "Vector")
    named = catalogue.withColumn("ve", F.regexp_replace(base, "_RD_", "_VE_")).withColumn("pr", F.regexp_replace(base, "_RD_", "_PR_"))
    files = known.select(F.col("path").alias("mask"))
    met = named.join(files.withColumnRenamed("mask", "m1"), F.col("ve") == F.col("m1"), "left").join(files.withColumnRenamed("mask", "m2"), F.col("pr") == F.col("m2"), "left")
    return met.withColumn("mask", F.coalesce("m1", "m2")).drop("ve", "pr", "m1", "m2")
