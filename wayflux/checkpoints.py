"""Cutting lineage in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; only where none is named (tests, one machine) a new temporary one."""
    context = spark.sparkContext
    set_already = context.getCheckpointDir()
    if set_already:
        return set_already
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        named = tempfile.mkdtemp(prefix="spark-wayflux-")
    context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and go on from there; lost executors do not lose it."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fresh(frame: DataFrame) -> DataFrame:
    """``checkpoint`` for loops that join what they made: the size that Spark estimates for ``frame`` is forgotten, too.

    A checkpointed frame keeps the estimate of its plan, and a join's estimate is the product of both sides', so that from
    round to round the digits of that number multiply until they fill the driver.
    """
    spark, written = frame.sparkSession, checkpoint(frame)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(written.toJavaRDD(), written.schema()), spark)
