"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, and links confirmed on full sets.

A document is its set of distinct word shingles. Its signature has PARTS components of 32 bits; two documents differ
in a component with probability 1 - similarity. The signature is split into chunks of CHUNK components and a chunk may
have ERRORS wrong components: for each choice of those, a key is made from the others. By the pigeonhole principle any
two signatures that differ in fewer than (PARTS / CHUNK) * (ERRORS + 1) components share a key; at similarity 0.75 a
pair shares none with a probability of about 1e-7.

Equal sets are one node. Nodes that share a key are compared on their full sets, but never as a list of all pairs. The
pivot of a key is its smallest node, and each node is filed under its home, the smallest pivot of its keys. Homes are
cut into blocks of bounded size, and the pivot goes to every block of its home. A task holds one block, counts
intersections of whole rows of documents at once, and returns a spanning forest of the links it finds. The components
of those links are labels. A second pass compares blocks that share a key whose nodes still have different labels; only
such nodes travel, and what it returns are links between labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import chunks, mix64, text_or_empty
from wayflux.llm.spans import shingle_hashes, word_hashes
from wayflux.operators.graph import connected_components

WIDTH, SIMILARITY = 5, 75
PARTS, CHUNK, ERRORS = 48, 4, 1
#: Shingles of the documents of a home's block, and of a block of the second pass; a task holds two of these at most.
#: Each document counts ROW_SHINGLES more, which bounds the rows of a block of short documents.
BLOCK_SHINGLES, FAR_SHINGLES, ROW_SHINGLES = 1 << 14, 1 << 16, 64

_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 2**63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PARTS, dtype=np.uint64)


def shingle_sets(texts: list[str], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, after lower-casing A-Z; empty without words."""
    for begin, end in chunks(texts):
        hashes, counts = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts[begin:end]])
        at = 0
        for n in counts:
            yield np.unique(shingle_hashes(hashes[at : at + n], width))
            at += n


def signature(shingles: np.ndarray) -> np.ndarray:
    """PARTS components of 32 bits."""
    least = np.full(PARTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (_MULTIPLY[:, None] * shingles[None, i : i + 4096] + _ADD[:, None]).min(1), out=least)
    return least >> np.uint64(32)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): for each chunk and each choice of ERRORS = 1 wrong component, a hash of the rest."""
    chunked = signatures.reshape(len(signatures), PARTS // CHUNK, CHUNK)
    out = np.zeros((len(signatures), PARTS // CHUNK, CHUNK), np.uint64)
    for wrong in range(CHUNK):
        key = np.arange(PARTS // CHUNK, dtype=np.uint64)[None, :] * np.uint64(CHUNK) + np.uint64(wrong + 1) + np.zeros((len(signatures), 1), np.uint64)
        for part in range(CHUNK):
            if part != wrong:
                key = mix64(key) * np.uint64(0x9E3779B97F4A7C15) + chunked[:, :, part]
        out[:, :, wrong] = mix64(key)
    return out.reshape(len(signatures), -1)


def _digest(shingles: np.ndarray) -> bytes:
    """Of a whole set: its size, sum and a second sum of mixed hashes."""
    with np.errstate(over="ignore"):
        return np.array([len(shingles), shingles.sum(), mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes()


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, digest (null for an empty set), signature (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), _digest(s), signature(s).astype(np.uint32).tobytes()) for s in shingle_sets(batch["text"].to_pylist(), width)]
            sizes, full = pa.array([s[0] for s in sets], pa.int64()), [s[0] > 0 for s in sets]
            packed = [pa.array([s[k] if f else None for s, f in zip(sets, full)], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], sizes, *packed], names=["doc_id", "hash", "n_shingles", "digest", "signature"])

    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, hash long, n_shingles long, digest binary, signature binary")


def filed_keys(nodes: DataFrame) -> DataFrame:
    """node, key: every key of each signature of nodes(node, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32)
            keys = index_keys(packed.reshape(-1, PARTS).astype(np.uint64)).view(np.int64)
            owners = np.repeat(batch["node"].to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(keys.ravel())], names=["node", "key"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, key long")


def _first() -> Column:
    """What stands for a set: of the rows that have it the one with the smallest id (null last), then text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "hash"))


def full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """members(node, first, home, block, hosted) with shingles (packed 64-bit hashes) of the text that ``first`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for begin, end in chunks(texts):
                packed = pa.array([s.tobytes() for s in shingle_sets(texts[begin:end], width)], pa.binary())
                kept = [batch[c].slice(begin, end - begin) for c in ("node", "home", "block", "hosted")]
                yield pa.RecordBatch.from_arrays([*kept, packed], names=["node", "home", "block", "hosted", "shingles"])

    def keyed(doc_id: Column, hashed: Column) -> list[Column]:
        return [F.coalesce(doc_id, F.lit(0)).alias("id_"), hashed.alias("hash_")]  # one text hash is one text per id

    text = text_or_empty(F.col(text_col))
    rows = docs.select(*keyed(F.col(id_col), F.xxhash64(text)), text.alias("text")).dropDuplicates(["id_", "hash_"])
    wanted = members.select(*keyed(F.col("first.doc_id"), F.col("first.hash")), "node", "home", "block", "hosted")
    met = rows.join(wanted, ["id_", "hash_"]).select("node", "home", "block", "hosted", "text")
    return met.mapInArrow(run, "node long, home long, block long, hosted long, shingles binary")


def forest(ids: list, sets: list[np.ndarray], labels: list, sides: list[int], similarity: int = SIMILARITY) -> list[tuple]:
    """A spanning forest of all links between documents of unlike labels (and of unlike sides, 0 and 1, where given).

    A document's intersections with all others are counted at once, through marks on the block's own vocabulary;
    shingles of one document alone, or of one side alone, are left out of the counting.
    """
    sizes, side = np.array([len(s) for s in sets]), np.array(sides)
    label = np.unique(np.array(labels, object).astype(str), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    vocabulary, places, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    across = (side >= 0).all()
    if across:
        first = np.bincount(places, weights=side[owner] == 0, minlength=len(vocabulary))
        useful = ((first > 0) & (first < times))[places]
        small = int((side == 0).sum() > (side == 1).sum())
        rows, columns = np.flatnonzero(side == small), np.flatnonzero(side != small)
    else:
        useful = times[places] > 1
        rows = columns = np.arange(len(sets))
    places, owner = places[useful], owner[useful]
    begins = np.searchsorted(owner, np.arange(len(sets) + 1))
    counted = np.flatnonzero(np.isin(np.arange(len(sets)), columns) & (np.diff(begins) > 0))
    others = np.isin(owner, counted)
    targets, starts = places[others], np.searchsorted(owner[others], counted)
    marks, found = np.zeros(len(vocabulary), np.int32), []
    for p in rows[np.lexsort((rows, -sizes[rows]))]:
        open_ = (label[counted] != label[p]) & (100 * np.minimum(sizes[counted], sizes[p]) >= similarity * np.maximum(sizes[counted], sizes[p]))
        if not open_.any():
            continue
        own = places[begins[p] : begins[p + 1]]
        marks[own] = 1
        shared = np.add.reduceat(marks[targets], starts)
        marks[own] = 0
        for q in counted[open_ & (100 * shared >= similarity * (sizes[counted] + sizes[p] - shared))]:
            if label[q] != label[p]:
                found.append((ids[p], ids[q]))
                label[label == label[q]] = label[p]
    return found


def _links(block: pd.DataFrame) -> pd.DataFrame:
    """The block's links as stars: each label that a link reaches, with the smallest one it is joined with."""
    block = block.drop_duplicates(["node", "side"]).sort_values("node")
    labels, root = block["label"].tolist(), {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for p, q in forest(list(range(len(block))), [np.frombuffer(s, np.uint64) for s in block["shingles"]], labels, block["side"].tolist()):
        low, high = sorted((top(labels[p]), top(labels[q])))
        root[high] = low
    return pd.DataFrame([(x, top(x)) for x in root], columns=["src", "dst"], dtype="int64")


def _weight() -> Column:
    return F.col("n_shingles") + ROW_SHINGLES


def home_blocks(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """node, first, home, total, block, hosted for every node that shares a key: its block, and of how many it is the pivot."""
    homes = shared.groupBy("node").agg(F.min("pivot").alias("home"))
    members = homes.join(nodes.select("node", "first", "n_shingles"), "node")
    totals = members.groupBy("home").agg(F.sum(_weight()).alias("total")).withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES))
    hosts = totals.select(F.col("home").alias("node"), F.col("blocks").alias("hosted"))
    members = members.join(hosts, "node", "left").fillna({"hosted": 0})
    block = F.pmod(F.xxhash64("node"), "blocks")
    return checkpoint(members.join(totals, "home").select("node", "first", "home", "total", block.alias("block"), "hosted"))


def near_links(sets: DataFrame) -> DataFrame:
    """src, dst: links within the blocks of each home, its pivot in every one of them."""
    own = F.array(F.struct("home", "block"))
    hosted = F.when(F.col("hosted") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("hosted") - 1), lambda b: F.struct(F.col("node").alias("home"), b.alias("block"))))
    places = F.explode(F.array_distinct(F.concat(own, F.coalesce(hosted, F.array().cast("array<struct<home:bigint,block:bigint>>")))))
    tasks = sets.select(places.alias("at"), "node", F.col("node").alias("label"), F.lit(-1).alias("side"), "shingles").select("at.*", "node", "label", "side", "shingles")
    return tasks.groupBy("home", "block").applyInPandas(_links, "src long, dst long")


def far_links(shared: DataFrame, labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: links between labels, from blocks that share a key whose nodes have different labels."""
    at = shared.select("key", "node").join(labelled, "node")
    held = at.groupBy("key", "block", "home", "whole").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.collect_set(F.struct("node", "label")).alias("docs"))
    open_keys = held.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("key")
    held = held.join(open_keys, "key")
    a, b = held.alias("a"), held.alias("b")
    done = (F.col("a.home") == F.col("b.home")) & F.col("a.whole")
    alike = (F.col("a.lo") == F.col("b.hi")) & (F.col("a.hi") == F.col("b.lo"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & ~done & ~alike)
    # What a block has under a key is bounded by the block.
    pairs = met.groupBy(F.col("a.block").alias("x"), F.col("b.block").alias("y")).agg(*[F.array_distinct(F.flatten(F.collect_set(f"{k}.docs"))).alias(k) for k in "ab"])
    one = F.array(F.struct(F.lit(-1).alias("side"), F.col("a").alias("docs")))
    two = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("docs")), F.struct(F.lit(1).alias("side"), F.col("b").alias("docs")))
    sent = pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), one).otherwise(two)).alias("s")).select("x", "y", "s.side", F.explode("s.docs").alias("d")).select("x", "y", "side", "d.*")
    return sent.join(sets.select("node", "shingles"), "node").groupBy("x", "y").applyInPandas(_links, "src long, dst long")


def components(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """node, keeper for every node of nodes(node, first, n_shingles, signature) that shares a key: its component's least ``first``."""
    filed = filed_keys(nodes)
    crowded = filed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("node").alias("pivot")).filter("crowd > 1")
    shared = checkpoint(filed.join(crowded.select("key", "pivot"), "key"))
    members = home_blocks(nodes, shared)
    sets = checkpoint(full_sets(docs, members, id_col, text_col, width))
    labels = connected_components(near_links(sets)).withColumnRenamed("component", "label")
    # Linked nodes and single ones in blocks of their own: most of the linked ones of a home have one label.
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / FAR_SHINGLES))
    labelled = members.join(labels, "node", "left").withColumn("block", F.xxhash64("home", F.col("label").isNull(), part))
    labelled = labelled.select("node", "first", "home", "block", F.coalesce("label", "node").alias("label"), (F.col("total") <= BLOCK_SHINGLES).alias("whole"))
    labelled = checkpoint(labelled)
    joined = connected_components(far_links(shared, labelled.drop("first"), sets)).withColumnRenamed("node", "label")
    classes = labelled.join(joined, "label", "left").select("node", "first", F.coalesce("component", "label").alias("component"))
    keepers = classes.groupBy("component").agg(F.min("first").alias("keeper"))
    # In other partitions than the aggregation left them, so that the join deals out both sides and can split a large component.
    keepers = keepers.coalesce(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2))
    return classes.join(keepers, "component").select("node", "keeper")


def judged(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc_id, hash, n_shingles, keeper(lone, doc_id, hash) for every row: what stays of its component; null for an empty set."""
    sketches = checkpoint(sketch(docs, id_col, text_col, width))
    nodes = sketches.filter("digest is not null").groupBy("digest", "n_shingles", "signature").agg(_first().alias("first"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = components(docs, nodes, id_col, text_col, width)
    of_set = nodes.select("node", "digest", "first").join(found, "node", "left").select("digest", F.coalesce("keeper", "first").alias("keeper"))
    return sketches.drop("signature").join(of_set, "digest", "left").select("doc_id", "hash", "n_shingles", "keeper")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (ids are integers).

    Words are runs of characters other than space and \\t-\\r of the text with A-Z lower-cased; a document with fewer
    than ``width`` words has its whole sequence as its one shingle, one without words (or with a null text) has none
    and is linked with nothing. Documents are linked when 100 * shared >= 75 * united shingles. ``component_id`` is the
    smallest id reachable. Equal sets are joined first and stand in for each other, so groups of copies cost one row.
    Rows are told apart by their sets, so rows that repeat an id with different texts each belong to their own text's
    component; repeated rows have equal results. A null id belongs to its text's component and is never kept before an
    id; a component of null ids alone has a null ``component_id``. Texts of any length are read whole, an empty table
    gives no rows, and other columns are not read, whatever their names.
    """
    found = judged(docs, id_col, text_col, width)
    component = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with all its columns; of each group of near copies one row stays.

    That is the row with the smallest id (null last), of equal ids the one with the smallest text hash; of rows that
    repeat both, any one. Rows without words all stay. Other cases are those of ``near_duplicates``.
    """
    found = checkpoint(judged(docs, id_col, text_col, width))
    stays = F.col("keeper").isNull() | (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("hash") == F.col("keeper.hash")))
    gone = found.filter(~stays).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    hashed = F.xxhash64(text_or_empty(docs[text_col]))
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (hashed == gone["__hash"]), "left_anti")
    twice = found.filter(stays & F.col("keeper").isNotNull()).groupBy("doc_id", "hash").count().filter("count > 1")
    if twice.isEmpty():
        return left
    # Only tables with repeated rows come here: rows without words stay, of the others one per id and text.
    words = F.regexp_like(text_or_empty(F.col(text_col)), F.lit(r"[^\x20\x09-\x0D]"))
    names = left.columns
    hashed = left.withColumns({"__hash": F.xxhash64(text_or_empty(F.col(text_col))), "__words": words})
    once = hashed.filter("__words").dropDuplicates([id_col, "__hash"])
    return once.unionByName(hashed.filter("not __words")).select(*names)
