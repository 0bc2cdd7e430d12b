"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (a line) is hashed to a wide vector of 32-bit lanes, and a text's fingerprint is the sum of its
paragraphs' vectors modulo 2 ** 32 in every lane. Sums do not depend on the order, and adding or subtracting the vector
of a paragraph inserts or deletes it without reading the rest. The first lanes are uniform (SHAKE-128 of the
paragraph): these tell multisets apart. The others are a count sketch of the paragraph's runs of three words, of small
values, so that their inner products estimate how much two texts have in common even within paragraphs.
Bellare and Micciancio, A new paradigm for collision-free hashing, EUROCRYPT 1997; Charikar et al., ICALP 2002.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.llm.common import chunks, text_or_empty
from wayflux.llm.spans import shingle_hashes, word_hashes

#: Lanes of 32 bits that tell multisets apart, and lanes that sketch what a text says. A sketch lane is read as a signed
#: number: it is right while no text has 2 ** 31 runs of words in a lane.
UNIFORM, SKETCH = 32, 128
WORDS = 3
#: Paragraphs whose vectors are held at once.
_HELD = 4096
#: Ranges of ids per partition; several small ones even out what long texts add to some.
RANGES = 4


def _uniform(paragraphs: list[bytes]) -> np.ndarray:
    total = np.zeros(UNIFORM, np.uint32)
    for i in range(0, len(paragraphs), _HELD):
        drawn = b"".join([hashlib.shake_128(p).digest(4 * UNIFORM) for p in paragraphs[i : i + _HELD]])
        total += np.frombuffer(drawn, "<u4").reshape(-1, UNIFORM).sum(0, dtype=np.uint32)
    return total


def _sketch(words: np.ndarray) -> np.ndarray:
    return _counted(shingle_hashes(words, WORDS))


def _counted(grams: np.ndarray) -> np.ndarray:
    lanes = (grams % np.uint64(SKETCH)).astype(np.int64)
    signs = ((grams >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return np.bincount(lanes, signs, SKETCH).astype(np.int64).astype(np.uint32)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text; the empty text has no paragraph and the sum zero."""
    out = []
    for begin, end in chunks(texts):
        owner, lines = [], []
        for i, text in enumerate(texts[begin:end]):
            found = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
            lines += found
            owner.append(len(found))
        hashes, counts = word_hashes(lines)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        for n in owner:
            uniform = _uniform(lines[at : at + n])
            sketch = np.zeros(SKETCH, np.uint32)
            if n:
                # Runs of words end with their paragraph, so each paragraph's share depends on nothing else.
                sketch = _paragraph_sketches(hashes[ends[at] : ends[at + n]], counts[at : at + n])
            out.append(np.concatenate([uniform, sketch]))
            at += n
    return out


def _paragraph_sketches(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the paragraphs' sketches. Paragraphs shorter than a run have one run of all their words."""
    total = np.zeros(SKETCH, np.uint32)
    ends = np.cumsum(counts)
    for short in np.flatnonzero((counts > 0) & (counts < WORDS)):
        total += _sketch(words[ends[short] - counts[short] : ends[short]])
    if len(words) >= WORDS:
        grams = shingle_hashes(words, WORDS)
        paragraph = np.repeat(np.arange(len(counts)), counts)
        total += _counted(grams[paragraph[: len(grams)] == paragraph[WORDS - 1 :]])
    return total


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of both multisets together."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint after deleting the paragraphs of ``b``."""
    return a - b


def to_text(value: np.ndarray) -> str:
    return value.astype("<u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), "<u4").copy()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches (at most just below 1, at least 0)."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[UNIFORM:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(max(x @ y / norm, 0.0), 0.999999)) if norm else 0.0


def _starts(docs: DataFrame, parts: int) -> list:
    """Ids at which ranges of about equally many rows begin; at most ``parts`` numbers reach the driver.

    A range is off by a tenth of its rows at most, which bounds the summary of the ids at some ten numbers a range.
    """
    found = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("at")).first()["at"] if parts > 1 else None
    return sorted(set(found or []))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text, by ascending id; the last is followed by the first. Null texts count as empty; rows of equal id
    follow one another by text, null ids come first. Texts are dealt once, by ranges of ids; the first row of each
    range is also sent to the range before it. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = ids.agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    starts = np.array([s for s in _starts(ids, RANGES * parts) if s != ends["least"] or ends["nulls"]], np.int64)
    nulls, least = ends["nulls"], ends["least"]

    @F.pandas_udf("array<long>")
    def ranges(doc_id: pd.Series) -> pd.Series:
        """The range of an id; for the id that begins one, the range before as well (the last for the very first)."""
        known = doc_id.notna().to_numpy()
        value = doc_id.fillna(0).astype("int64").to_numpy()
        own = np.where(known, np.searchsorted(starts, value, "right"), 0)
        first = ~known if nulls else known & (value == least)
        begins = known & np.isin(value, starts)
        return pd.Series([[o, len(starts) + (1 << 32)] if f else [o, o - 1 + (1 << 32)] if b else [o] for o, f, b in zip(own.tolist(), first, begins)])

    dealt = rows.withColumn("to", F.explode(ranges("doc_id")))
    dealt = dealt.withColumn("ahead", F.col("to") >= (1 << 32)).withColumn("range", F.col("to") % (1 << 32)).drop("to")
    # Ranges go round the partitions, so each has as many of them as any other.
    dealt = dealt.repartitionById(min(parts, len(starts) + 1), F.col("range").cast("int")).sortWithinPartitions("range", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ended, size = None, 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "ahead", "range"))):
                if row[3] == ended:
                    continue  # only the first row ahead counts
                if row[2]:
                    ended = row[3]
                held.append(row)
                size += len(row[1])
                if size > 1_000_000:
                    yield _judged(held)
                    held, size = [] if row[2] else [row], 0
        if held:
            yield _judged(held)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    """Results for all rows but those that only serve as the next of another one; the last row may be such."""
    texts = [r[1] for r in rows]
    plain = fingerprints(texts)
    judged = [i for i in range(len(rows) - 1) if not rows[i][2]]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in judged]
    changed = fingerprints(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([rows[i][0] for i in judged], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in judged], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array([to_text(plain[i]) for i in judged], pa.string()),
            "edited_fingerprint": pa.array([to_text(c) for c in changed], pa.string()),
            "near_edited": pa.array([likeness(plain[i], c) for i, c in zip(judged, changed)], pa.float64()),
            "near_next": pa.array([likeness(plain[i], plain[i + 1]) for i in judged], pa.float64()),
        }
    )
