"""Phrase collocations: frequent phrases by SON partitioning, scored by their least surprising cut.

A shard is a block of one language's text in one task. It is mined completely at the local support that its share of
the language's words leaves of SUPPORT, and sends what is locally frequent: a 32-bit cell in a hash bucket for each
phrase, and how far its count passes the local support. A phrase's counts above, summed over the shards, must reach
what the shards that did not send it can not have held; those that do are the candidates (a superset of the frequent
phrases: cells may collide, which adds to them only). They are kept as a bit set of fixed size. A second scan counts
all phrases that the bit set lets through, as strings and over all shards, so the counts do not rest on hashes.
Savasere, Omiecinski and Navathe, An efficient algorithm for mining association rules in large databases, VLDB 1995.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import ascii_lower, mix64, text_or_empty
from wayflux.llm.spans import _BYTE, _power

SUPPORT, TOP, SHADOW = 10, 2000, 50
#: Bytes of a shard, all languages of a task's block together, and of what is hashed in one go.
SHARD_BYTES, SCAN_BYTES = 8 << 20, 1 << 20
#: Cells that meet in one bucket at most, and bits of the candidate set in all and in one part of it.
BUCKET_CELLS, SET_BITS, PART_BITS = 1 << 21, 28, 18
#: Parts by which the leaders of a language are found before they meet.
SALTS = 64

BREAKS, SPACES = r".,;:!?\x0A-\x0D", r"\x20\x09"
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_NEXT_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_WORD_BITS = 21


class Shard(NamedTuple):
    """The words of a shard in order: hash, begin and end in ``data``; ``next_``: the next word is in the same piece."""

    lang: str
    data: bytes
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    next_: np.ndarray

    def keys(self) -> list[np.ndarray]:
        """Hashes of the phrases of 1, 2 and 3 words, in order of their first words."""
        h, joined = self.hashes, self.next_
        two = np.flatnonzero(joined[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
        three = two[joined[two + 1]] if len(two) else two
        pair = mix64(h[two] * _MULTIPLY + h[two + 1] + np.uint64(2))
        triple = mix64((h[three] * _MULTIPLY + h[three + 1]) * _MULTIPLY + h[three + 2] + np.uint64(3))
        return [h, pair, triple]

    def firsts(self) -> list[np.ndarray]:
        """Places of the first words of these phrases."""
        two = np.flatnonzero(self.next_[:-1])
        return [np.arange(len(self.hashes)), two, two[self.next_[two + 1]] if len(two) else two]


def _parts(text: bytes) -> Iterator[bytes]:
    """``text`` cut at breaks into parts of about SCAN_BYTES; phrases do not reach over a break."""
    begin = 0
    while len(text) - begin > SCAN_BYTES:
        m = _NEXT_BREAK.search(text, begin + SCAN_BYTES)
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.end()
    yield text[begin:]


def scanned(lang: str, parts: list[bytes]) -> Shard:
    found, base = [], 0
    for data in parts:
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        edge = np.diff(np.concatenate([[True], kind > 0, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=prefix[1:])
        hashes = mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        found.append((hashes, (starts + base).astype(np.int64), (ends + base).astype(np.int64), np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, bool)))
        base += len(data)
    return Shard(lang, b"".join(parts), *(np.concatenate(x) for x in zip(*found)))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of batches (lang, text lower-cased), one for each language in a block of about SHARD_BYTES."""
    held: dict[str, list[list[bytes]]] = {}
    size = 0

    def flush() -> Iterator[Shard]:
        for lang, parts in held.items():
            joined, sizes = [], 0
            for part in parts:  # small texts are hashed together
                if not joined or sizes + len(part) > SCAN_BYTES:
                    joined.append([])
                    sizes = 0
                joined[-1].append(part)
                sizes += len(part) + 1
            yield scanned(lang, [b"\n".join(x) for x in joined])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for part in _parts(text.as_py().encode("utf-8", "surrogatepass")):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
    yield from flush()


def _buckets(words: int) -> int:
    return max(1, -(-3 * words // BUCKET_CELLS))


def _placed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit cell of each key, as one number."""
    return (keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def _bits(lang: str, placed: np.ndarray) -> np.ndarray:
    """Places in the candidate set."""
    return (mix64(placed ^ np.uint64(zlib.crc32(lang.encode()) << 31)) >> np.uint64(64 - SET_BITS)).astype(np.int64)


def mined(docs: DataFrame, totals: dict[str, int], support: int) -> DataFrame:
    """lang, bucket, below, cells, above: of each shard the locally frequent phrases, with counts beyond ``below``.

    ``below`` is the count up to which the shard says nothing of a phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            buckets, below = _buckets(totals[shard.lang]), -(-support * len(shard.hashes) // max(totals[shard.lang], 1)) - 1
            if not len(shard.hashes):
                continue
            placed, counts = np.unique(_placed(np.concatenate(shard.keys()), buckets), return_counts=True)
            often = counts > below
            placed, above = placed[often], np.minimum(counts[often] - below, support).astype(np.uint8)
            bucket = (placed >> np.uint64(32)).astype(np.int64)
            named = np.arange(buckets) if below else np.unique(bucket)
            begins, ends = np.searchsorted(bucket, named), np.searchsorted(bucket, named, "right")
            cells = (placed & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = {"bucket": pa.array(named, pa.int64()), "below": pa.array(np.full(len(named), below), pa.int64())}
            rows |= {n: pa.array([x[b:e].tobytes() for b, e in zip(begins, ends)], pa.binary()) for n, x in (("cells", cells), ("above", above))}
            yield pa.RecordBatch.from_pydict({"lang": pa.array([shard.lang] * len(named), pa.string()), **rows})

    return docs.mapInArrow(run, "lang string, bucket long, below long, cells binary, above binary")


def candidate_parts(local: DataFrame, support: int) -> DataFrame:
    """part, bits: the candidate set, from what the shards hold to be locally frequent."""

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, bucket = key
        cells = np.frombuffer(b"".join(rows["cells"]), "<u4")
        above = np.frombuffer(b"".join(rows["above"]), np.uint8)
        order = np.argsort(cells, kind="stable")
        cells, above = cells[order], above[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        total = np.add.reduceat(above.astype(np.int64), first) if len(first) else first
        passed = cells[first[total >= support - int(rows["below"].sum())]].astype(np.uint64)
        bits = np.unique(_bits(lang, np.uint64(bucket) << np.uint64(32) | passed))
        parts, begins = np.unique(bits >> PART_BITS, return_index=True)
        return pd.DataFrame({"part": parts, "at": [x.astype("<i4").tobytes() for x in np.split(bits & (1 << PART_BITS) - 1, begins[1:])] if len(parts) else []})

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PART_BITS, bool)
        for at in rows["at"]:
            bits[np.frombuffer(at, "<i4")] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return local.groupBy("lang", "bucket").applyInPandas(joined, "part long, at binary").groupBy("part").applyInPandas(merged, "part long, bits binary")


def _strings(shard: Shard, places: np.ndarray) -> pa.Array:
    view = shard.data
    return pa.array([view[b:e] for b, e in zip(shard.begins[places].tolist(), shard.ends[places].tolist())], pa.binary()).cast(pa.string(), safe=False)


def counted(docs: DataFrame, totals: dict[str, int], candidates: list) -> DataFrame:
    """lang, phrase, f: exact counts of all phrases that the candidate set lets through, by shard."""
    full = np.zeros(1 << SET_BITS - 3, np.uint8)
    for row in candidates:  # a fixed number of bytes in all
        begin = row["part"] << PART_BITS - 3
        full[begin : begin + (1 << PART_BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(full.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.frombuffer(shared.value, np.uint8)
        for shard in shards(batches):
            if not len(shard.hashes):
                continue
            buckets = _buckets(totals[shard.lang])
            _, seen, word = np.unique(shard.hashes, return_index=True, return_inverse=True)
            spelt: pa.Array = None
            for width, (keys, firsts) in enumerate(zip(shard.keys(), shard.firsts()), 1):
                bits = _bits(shard.lang, _placed(keys, buckets))
                firsts = firsts[(allowed[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)]
                exact = word[firsts].astype(np.int64)
                for k in range(1, width):
                    if k == 2 and len(seen) > 1 << _WORD_BITS:  # else three word numbers fit in 63 bits
                        exact = np.unique(exact, return_inverse=True)[1]
                    exact = exact * len(seen) + word[firsts + k]
                _, one, counts = np.unique(exact, return_index=True, return_counts=True)
                if spelt is None:
                    spelt = _strings(shard, seen)
                place = firsts[one]
                columns = [spelt.take(pa.array(word[place + k])) for k in range(width)]
                phrase = pc.binary_join_element_wise(*columns, " ") if width > 1 else columns[0]
                for begin in range(0, len(phrase), 50_000):
                    part = phrase.slice(begin, 50_000)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([shard.lang] * len(part), pa.string()), "phrase": part, "f": pa.array(counts[begin : begin + 50_000], pa.int64())})

    return docs.mapInArrow(run, "lang string, phrase string, f long")


def word_totals(docs: DataFrame) -> DataFrame:
    """lang, n: all words of each language."""
    words = F.regexp_count("text", F.lit(f"[^{SPACES}{BREAKS}]+")).cast("long")
    return docs.groupBy("lang").agg(F.sum(words).alias("n"))


def frequent_phrases(docs: DataFrame, totals: dict[str, int], support: int = SUPPORT) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to 3 words with f >= support; docs(lang, text lower-cased)."""
    found = candidate_parts(mined(docs, totals, support), support).collect()
    return counted(docs, totals, found).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) over decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)).cast("long")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of 2 and 3 words that no longer one stands for."""
    words = F.split("phrase", " ")
    frequent = frequent.withColumn("words", words)
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.lit(0).alias("side"), F.array_join(F.slice("words", 1, k), " ").alias("part"))
    rest = lambda k: F.struct(F.lit(k).alias("k"), F.lit(1).alias("side"), F.array_join(F.slice("words", k + 1, 3), " ").alias("part"))
    asked = F.when(F.size("words") == 2, F.array(cut(1), rest(1))).otherwise(F.array(cut(1), rest(1), cut(2), rest(2)))
    asks = frequent.filter(F.size("words") > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(asked).alias("ask")).select("lang", "phrase", "a", "ask.*")
    told = checkpoint(asks.join(frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]))
    shadowed = told.filter((F.instr("part", " ") > 0) & (100 * F.col("a") >= SHADOW * F.col("f"))).select("lang", F.col("part").alias("phrase")).distinct()
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = told.groupBy("lang", "phrase", "a").agg(*[side(k, s).alias(f"f{k}{s}") for k in (1, 2) for s in (0, 1)])
    one = lambda k: F.when(F.col(f"f{k}0").isNotNull(), F.struct(_score(F.col("a"), F.col(f"f{k}0"), F.col(f"f{k}1")).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
    least = cuts.select("lang", "phrase", "a", F.least(one(1), one(2)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    return least.join(shadowed, ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 and 3 words of each language.

    Texts (null: empty) are read whole, A-Z lower-cased, cut into pieces at . , ; : ! ? and line ends, and those into
    words at spaces and tabs; counts are per language (null: ``und``). A phrase counts ``a`` >= ``support`` times. Of
    its cuts into a first and a last part with counts l and r the one with the lowest floor(1000000 a a / (l r)) is
    its score, the earliest of equal ones. Phrases within a longer one of at least half their count are left out.
    Equal scores are ordered by ``a``, then by the phrase's bytes. Repeated rows count each time; other columns are not
    read; an empty table gives no rows. The driver holds one number for each language and a bit set of fixed size.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), ascii_lower(text_or_empty(F.col(text_col))).alias("text"))
    totals = {r["lang"]: r["n"] for r in word_totals(docs).collect()}
    kinds = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not any(totals.values()):
        return docs.sparkSession.createDataFrame([], kinds)
    found = checkpoint(frequent_phrases(docs, totals, support))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    leaders = scored(found).withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("place") <= top)
    ranked = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = docs.sparkSession.createDataFrame(sorted(totals.items()), "lang string, n long")
    return ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
