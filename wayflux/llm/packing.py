"""Best-fit packing of token pieces into sequences of bounded length, improved by swap-based local search.

Documents become pieces in one scan; a piece is a row of a few numbers from then on. Blocks of BLOCK pieces are packed
best fit by falling length, and the bins that are not full are improved by local search: the emptiest bin gives pieces
to fuller ones by moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared fills, until it
is empty or no exchange helps. The first blocks are parts of the input's partitions and need no shuffle. What lies in
bins that are still not full is dealt out anew, bin by bin, in fewer blocks, until one block holds it all or a round
empties next to nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import slices, text_or_empty

#: Tokens of a sequence, and the id that closes a document.
SIZE, CLOSING = 2048, 0
#: Pieces that one task packs at once.
BLOCK = 4096
#: Receivers with more pieces give one piece at a time: their pairs are too many, and small pieces fit in anyway.
PAIRED = 24
#: Receivers that are looked through for the best exchange at once, and donors in a row that may fail before a search ends.
NEAR, PATIENCE = 128, 64
#: A round that empties a smaller share of the bins that are not full is the last.
LEAST_GAIN = 0.002
#: Distinct white-space separated strings, and bytes of them and their ids, that a worker remembers; then it starts anew.
CACHE_STRINGS, CACHE_BYTES = 1_200_000, 96_000_000

_PIECE = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: White space for str.split, but not for the tokenizer.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as the tokenizers library gives them; it is asked once for each string between white space.

    This holds for tokenizers that drop white space before anything else is decided, as word-end vocabularies do.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lowers = "Lowercase" in str(json.loads(spec).get("normalizer"))
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """The worker's own encoder of a vocabulary; it outlives a task."""
        name = hashlib.sha256(spec.encode()).hexdigest()
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = cls(spec)
        return _encoders[name]

    def _ask(self, texts: list[str]) -> list[bytes]:
        ask = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in ask(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in _SEPARATORS)]
        # A special token is told by its case; without one, lower case first lets more strings be alike.
        texts = [t.lower() if t.isascii() and self.lowers and "<|" not in t else t for t in texts]
        split = [t.split() for t in texts]
        for i in odd:
            split[i] = []
        known = self.known
        new = list(set().union(*split).difference(known))
        for begin in range(0, len(new), 20_000):
            some = new[begin : begin + 20_000]
            packed = self._ask(some)
            known.update(zip(some, packed))
            self.held += sum(map(len, some)) + sum(map(len, packed))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i, packed in zip(odd, self._ask([texts[i] for i in odd]) if odd else []):
            out[i] = packed
        if len(known) > CACHE_STRINGS or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        return out


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each document and a closing 0, cut every ``size`` tokens."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        closing = CLOSING.to_bytes(4, "little")
        for batch in batches:
            for begin, end in slices(batch["text"]):
                packed = [x + closing for x in encoder.encode(batch["text"].slice(begin, end - begin).to_pylist())]
                at, rows = [], []
                for i, ids in enumerate(packed):
                    for piece, start in enumerate(range(0, len(ids), 4 * size)):
                        part = memoryview(ids)[start : start + 4 * size]
                        at.append(begin + i)
                        rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], names=["doc_id", *_PIECE.names])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Bins of places in ``lengths``: each piece, longest first, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r is set where a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = size, len(bins)
            bins.append([])
        bins[at].append(i)
        with_room[room - need].append(at)
        if room > need:
            rooms |= 1 << (room - need)
    return bins


class _Search:
    """Bins that are not full, as sorted lists of (length, place); what a donor may exchange with the others."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int) -> None:
        self.size = size
        self.bins = [sorted((lengths[i], i) for i in b) for b in bins]
        self.fill = [sum(x for x, _ in b) for b in self.bins]
        self.offers = [self._offer(k) for k in range(len(bins))]

    def _offer(self, k: int) -> tuple[np.ndarray, list[tuple]]:
        """What a receiver can give back: nothing, one piece, or two; and the room that it has then."""
        held = self.bins[k]
        given = [(), *((p,) for p in held), *(combinations(held, 2) if len(held) <= PAIRED else ())]
        return np.array([sum(x for x, _ in g) for g in given], np.int64), given

    def exchange(self, donor: int, others: np.ndarray) -> bool:
        """Of the exchanges with ``others`` the one that moves most tokens out of the donor, if it raises the sum of squared fills."""
        held = self.bins[donor]
        one = np.array([x for x, _ in held], np.int64)
        back = np.concatenate([self.offers[k][0] for k in others])
        sizes = np.array([len(self.offers[k][0]) for k in others])
        place = np.arange(len(back)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.arange(len(others)), sizes)
        fill = np.array([self.fill[k] for k in others])
        room = self.size - fill[owner] + back
        at = np.searchsorted(one, room, "right") - 1
        gain = np.where(at >= 0, one[at], 0) - back
        pairs = list(combinations(range(len(held)), 2)) if len(held) <= PAIRED else []
        if pairs:
            two = np.array([one[a] + one[b] for a, b in pairs], np.int64)
            order = np.argsort(two, kind="stable")
            at_two = np.searchsorted(two[order], room, "right") - 1
            single = place <= np.array([len(self.bins[k]) for k in others])[owner]  # two for at most one
            gain_two = np.where((at_two >= 0) & single, two[order[at_two]], 0) - back
            moved = np.maximum(gain, gain_two)
        else:
            moved = gain
        moved = np.where(fill[owner] + moved > self.fill[donor], moved, 0)
        best = int(np.argmax(moved))
        if moved[best] <= 0:
            return False
        k = int(others[owner[best]])
        out = [held[at[best]]] if gain[best] == moved[best] else [held[i] for i in pairs[order[at_two[best]]]]
        for p in out:
            held.remove(p)
            insort(self.bins[k], p)
        for p in self.offers[k][1][place[best]]:
            self.bins[k].remove(p)
            insort(held, p)
        self.fill[k] += int(moved[best])
        self.fill[donor] -= int(moved[best])
        self.offers[k] = self._offer(k)
        return True

    def empties(self, donor: int, others: list[int]) -> bool:
        """Whether exchanges with ``others``, NEAR at a time, leave nothing in the donor."""
        begin, moved = 0, False
        while self.fill[donor] and begin < len(others):
            near = np.array([k for k in others[begin : begin + NEAR] if self.size > self.fill[k] >= self.fill[donor]], np.int64)
            if len(near) and self.exchange(donor, near):
                moved = True
            else:
                begin += NEAR
                if begin >= len(others) and moved:  # what the donor holds now may suit receivers that were looked at before
                    begin, moved = 0, False
        self.offers[donor] = self._offer(donor)
        return not self.fill[donor]


def local_search(bins: list[list[int]], lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Bins with the same pieces, as few as exchanges between bins that are not full can make them.

    The emptiest bin gives to those at least as full, the most tokens first; each exchange raises the sum of squared
    fills, so this ends. It stops at the lowest number of bins that the total allows, or when PATIENCE donors in a row
    could not be emptied and a turn empties none.
    """
    full = [b for b in bins if sum(lengths[i] for i in b) >= size]
    open_ = [b for b in bins if sum(lengths[i] for i in b) < size]
    search = _Search(open_, lengths, size)
    left = set(range(len(open_)))
    least = -(-sum(search.fill) // size)
    emptied = True
    while emptied and len(left) > least:
        emptied, failed = False, 0
        for donor in sorted(left, key=lambda k: (search.fill[k], k)):
            if len(left) <= least or failed == PATIENCE:
                break
            if search.empties(donor, sorted(left - {donor}, key=lambda k: (search.fill[k], k))):
                left.discard(donor)
                emptied, failed = True, 0
            else:
                failed += 1
    return full + [[i for _, i in search.bins[k]] for k in sorted(left)]


def pack_block(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int], list[bool]]:
    """Bin, offset in it, and whether the bin is full, of each piece of a block."""
    at, offset, full = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
    for k, held in enumerate(local_search(best_fit(lengths, size), lengths, size)):
        filled = 0
        for i in held:
            at[i], offset[i] = k, filled
            filled += lengths[i]
        for i in held:
            full[i] = filled == size
    return at, offset, full


_PACKED = ("sequence_id", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_())


def _packed(block: pa.Table, first: int, size: int) -> pa.Table:
    at, offset, full = pack_block(block["length"].to_pylist(), size)
    for (name, kind), values in zip(_PACKED, ([first + k for k in at], offset, full)):
        block = block.append_column(name, pa.array(values, kind))
    return block


def first_round(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` packed in blocks of their own partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            yield from _packed(pa.Table.from_batches(waiting), first, size).combine_chunks().to_batches()

        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                if rows and rows + part.num_rows > BLOCK:
                    yield from packed()
                    first, waiting, rows = first + rows, [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield from packed()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, offset long, full boolean")


def next_round(open_pieces: DataFrame, blocks: int, number: int, size: int) -> DataFrame:
    """Pieces of bins that are not full, dealt bin by bin over ``blocks`` blocks and packed anew."""
    dealt = open_pieces.withColumn("block", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(blocks))).drop("sequence_id", "offset", "full")

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")]
        block = block.drop_columns(["block"]).sort_by(order)
        return _packed(block, (number << 56) + (key[0].as_py() << 32), size)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "block")
    return dealt.groupBy("block").applyInArrow(run, f"{kinds}, sequence_id long, offset long, full boolean")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``.

    A document's tokens are those of its whole text and a closing id 0 (a null or empty text: that alone); only longer
    documents than ``size`` are cut, every ``size`` tokens. A sequence holds whole pieces, at most ``size`` tokens, laid
    without gaps from offset 0; sequence numbers are unique and say nothing else. Rows that repeat an id, null ids
    included, are documents of their own; other columns are not read, whatever their names; an empty table gives no
    rows. The driver sees two numbers a round.
    """
    pieces = checkpoint(token_pieces(docs, vocabulary, size, id_col, text_col))
    packed = checkpoint(first_round(pieces, size))
    done, number = packed.filter("full"), 0
    left = packed.filter("not full")
    while True:
        bins, rows = left.agg(F.count(F.when(F.col("offset") == 0, 1)), F.count(F.lit(1))).first()
        blocks, number = -(-rows // BLOCK), number + 1
        if bins < 2:
            break
        again = checkpoint(next_round(left, blocks, number, size))
        now = again.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
        done, left = done.unionByName(again.filter("full")), again.filter("not full")
        if blocks == 1 or bins - now < LEAST_GAIN * bins:
            break
    return done.unionByName(left).drop("full")
