"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source is due ``target / source_size`` times: the whole part is taken outright, the fraction is an
inclusion probability. A flight moves these probabilities through the null space of the balancing constraints (words
and documents), a few documents at a time, so that each step settles at least one document and keeps both totals.
Flights run in blocks of bounded size, each leaving a handful of open documents; those meet again in fewer blocks,
until one block per source remains, whose last documents (the landing problem) are settled by trying all ways.
Deville and Tille, Efficient balanced sampling: the cube method, Biometrika 2004.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import text_or_empty

#: Documents of one flight; a block is held in one task's memory.
BLOCK_ROWS = 4096
#: Open documents that a flight leaves, at most; the landing tries 2 ** LANDING ways.
LANDING = 12

_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target of rows (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all sizes; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight, until none is above (if all are,
    the rest is not handed out). One row per source is held and sorted here, never one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    totals = checkpoint(totals.withColumn("weight", F.get(turn, (place % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * most))
    whole = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"] * share
    level = 0.0
    while True:  # each turn caps at least one more source
        capped = F.col("weight") * level >= F.col("cap")
        held = totals.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("caps"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        raised = (whole - held["caps"]) / held["open"] if held["open"] else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return totals.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def flight(sizes: list[float], chances: list[float], keep: int, rng: random.Random) -> list[float]:
    """Chances after the flight: all but ``keep`` at most are 0 or 1; sums of chance and of size times chance stay."""
    chances = list(chances)
    pool: list[int] = []
    waiting = [i for i, c in enumerate(chances) if _EPS < c < 1 - _EPS]
    left, at = len(waiting), 0
    while left > keep:
        while len(pool) < 3 and at < len(waiting):
            pool.append(waiting[at])
            at += 1
        if len(pool) < 3:
            break
        i, j, k = pool
        step = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if not any(step):
            step = (1.0, -1.0, 0.0)
        up = min(((1 - chances[x]) / u if u > 0 else -chances[x] / u) for x, u in zip(pool, step) if u)
        down = min((chances[x] / u if u > 0 else (chances[x] - 1) / u) for x, u in zip(pool, step) if u)
        move = up if rng.random() * (up + down) < down else -down
        stay = []
        for x, u in zip(pool, step):
            c = chances[x] + move * u
            if c <= _EPS or c >= 1 - _EPS:
                chances[x] = 0.0 if c <= _EPS else 1.0
                left -= 1
            else:
                chances[x] = c
                stay.append(x)
        pool = stay
    return chances


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Settle a few open documents: of all ways the one whose words, then documents, come nearest to what was due."""
    chances = list(chances)
    still = [i for i, c in enumerate(chances) if _EPS < c < 1 - _EPS]
    chances = [c if i in still else float(round(c)) for i, c in enumerate(chances)]
    if still:
        ways = (np.arange(1 << len(still))[:, None] >> np.arange(len(still))) & 1
        s, c = np.array([sizes[i] for i in still]), np.array([chances[i] for i in still])
        off_words, off_docs = np.abs(ways @ s - c @ s), np.abs(ways.sum(1) - c.sum())
        best = ways[np.lexsort((np.arange(len(ways)), off_docs, off_words))[0]]
        for i, taken in zip(still, best):
            chances[i] = float(taken)
    return chances


def _run(block: pd.DataFrame, seed: str, last: bool) -> pd.DataFrame:
    block = block.sort_values(["doc_id", "size", "row_key", "twin_key"], kind="stable", na_position="last")
    sizes = block["size"].astype(float).tolist()
    chances = flight(sizes, block["chance"].tolist(), LANDING, random.Random(seed))
    return block.assign(chance=land(sizes, chances) if last else chances)


def flights(units: DataFrame, step: int, seed: int, last: bool) -> DataFrame:
    def fly(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return _run(block, f"{seed}|{step}|{key[0]}|{key[1]}", last)

    return units.groupBy("source", "block").applyInPandas(fly, units.schema)


def with_blocks(units: DataFrame, rows: Column, step: int) -> DataFrame:
    """A block number: ``rows`` units of a source are dealt by hash over blocks of about BLOCK_ROWS."""
    return units.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(step)), F.ceil(rows / BLOCK_ROWS)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Iterable[float] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, seed: int = 20, twin_key: Column | None = None) -> DataFrame:
    """doc_id, row_key, twin_key, size, source_size, target, copies, taken for every row of ``docs``.

    ``size`` counts words (null text: 0), ``copies`` says how often the document is taken (0 to ceil(most)), ``taken``
    is size times copies. Sources without words take nothing. Null sources form one source; repeated rows are separate
    documents; other columns are not read. ``row_key`` is a hash of id, source and text, ``twin_key`` (the row's
    key by default) tells rows apart that agree in these. The same rows and seed give the same mix however they are
    partitioned. Texts of any length are counted whole; an empty table gives an empty mix. A source's words miss its target by less than its landing problem does:
    the best of 2 ** LANDING ways to settle its last documents, or of all ways if it has no more documents than that.
    """
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), (key.cast("string") if twin_key is None else twin_key).alias("twin_key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = checkpoint(sizes)
    per_source = checkpoint(source_targets(sizes, tuple(weights), share, most).withColumnRenamed("source", "of_source"))
    units = sizes.join(per_source, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    due = F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0))
    due = F.when(F.abs(due - F.round(due)) < _EPS, F.round(due)).otherwise(due)
    units = units.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no long column with nulls
    units = units.withColumn("due", F.when(F.col("size") > 0, due).otherwise(0.0))
    units = units.withColumn("whole", F.floor("due")).withColumn("chance", F.col("due") - F.col("whole"))
    units = with_blocks(units.drop("due"), F.col("n_docs"), 0).drop("n_docs")
    flown = checkpoint(flights(units, 0, seed, last=False))
    open_rows = (F.col("chance") > _EPS) & (F.col("chance") < 1 - _EPS)
    settled, left, step = flown.filter(~open_rows), flown.filter(open_rows), 0
    while True:  # open documents shrink by BLOCK_ROWS / LANDING each time
        step += 1
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("open")).withColumnRenamed("source", "of_source")
        largest = counts.agg(F.max("open").alias("n")).first()["n"] or 0
        if largest <= BLOCK_ROWS:
            landed = flights(left.withColumn("block", F.lit(0).cast("long")), step, seed, last=True)
            break
        left = left.join(counts, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        flown = checkpoint(flights(with_blocks(left, F.col("open"), step).drop("open"), step, seed, last=False))
        settled, left = settled.unionByName(flown.filter(~open_rows)), flown.filter(open_rows)
    done = settled.unionByName(landed).withColumn("copies", (F.col("whole") + F.round("chance")).cast("long"))
    return done.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "row_key", "twin_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    Rows that differ in any column are separate documents, so that none lends its columns to another; rows equal in all
    columns are told apart by nothing and share their copies. An empty table gives an empty one.
    """
    key = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    due = mix(docs, id_col, text_col, source_col, twin_key=key, **how).filter("copies > 0")
    due = due.groupBy(F.col("twin_key").alias("__key")).agg(F.sum("copies").alias("__copies"))
    # One key for the join and for equal rows: texts are shuffled once.
    met = docs.withColumn("__key", key).join(due, "__key").dropDuplicates(["__key"])
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
