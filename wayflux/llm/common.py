"""Column helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step holds at once.
CHUNK_CHARS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key's decimal text, modulo ``buckets``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, so that a batch of long texts needs little memory."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of about ``limit`` bytes, so that only that much becomes Python strings at once."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield begin, end
        begin = end


def small_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Arrow batches of at most ``limit`` for this session, where it has Spark's default: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64MB").lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(name, limit)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of MurmurHash3); changes ``x`` in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
