"""BPE encoding and decoding with a pair occurrence index.

A task takes the distinct words of a chunk of its partition that it has not met yet, lays their symbols out as one
linked list, and maps every pair of neighbours that has a merge rank to all its positions. Active ranks come off a
heap in ascending order; each is applied at all its positions from left to right, and only the lists of the pairs that
a merge creates are touched. Words are independent of one another, so this gives each word the merges that it would
have on its own. The vocabulary file is a parameter; it is read on the driver and its tables (bounded by the
vocabulary) are broadcast. Nothing is trained here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflux.llm.common import slices, text_or_empty

#: Words whose tokens a task remembers; beyond that it starts anew.
CACHE_WORDS = 120_000

_SHIFT = 24
#: From so many occurrences on, a pair's merges are applied as one array operation.
_BULK = 32
#: Characters of text whose new words share one index.
_INDEXED_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable and no space, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Token ids, merge ranks and special tokens of a word-end BPE file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        every = ids | self.special
        self.tokens = [""] * (max(every.values()) + 1)
        for token, i in every.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = [ids.get(s, -3) for s in symbols]
        self.final = [ids.get(s + suffix, -3) for s in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        born: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = ids[left + right]
            born.setdefault(new, rank)
            self.merges.setdefault(ids[left] << _SHIFT | ids[right], (rank, new))
        if any(max(born.get(key >> _SHIFT, -1), born.get(key & (1 << _SHIFT) - 1, -1)) >= rank for key, (rank, _) in self.merges.items()):
            raise ValueError("a merge uses a token that only a later merge makes")
        self.by_rank = {rank: (key >> _SHIFT, key & (1 << _SHIFT) - 1, new) for key, (rank, new) in self.merges.items()}
        self.keys = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[k][0] for k in self.keys.tolist()], np.int64)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (no rule for a final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order; a special token is recognised before normalising."""
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(self.normal(text))
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self.words.findall(self.normal(text[at : found.start()]))
            out.append(found[0])
            at = found.end()
        return out + self.words.findall(self.normal(text[at:]))

    def _lay_out(self, words: list[str]) -> tuple[array, array, array]:
        """Symbols of all words in a row, each word closed by -1, with the place after and before each symbol."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        codes = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        token = np.full(len(codes) + len(words), -1, np.int32)
        token[np.arange(len(codes)) + owner] = np.array(self.inner, np.int32)[codes]
        last = np.cumsum(sizes) - 1
        token[last + np.arange(len(words))] = np.array(self.final, np.int32)[codes[last]]
        place = np.arange(len(token), dtype=np.int32)
        return tuple(array("i", x.tobytes()) for x in (token, place + 1, place - 1))

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of each (non-empty) word, by the pair occurrence index over all of them."""
        if not words:
            return []
        token, after, before = self._lay_out(words)
        tokens, afters, befores = (np.frombuffer(x, np.int32) for x in (token, after, before))  # the same memory
        merges, keys, ranks = self.merges, self.keys, self.ranks
        many: dict[int, list[np.ndarray]] = {}  # rank -> positions, found in bulk
        few: dict[int, list[int]] = {}  # rank -> positions, found one by one
        active: list[int] = []

        def note(left: int, right: int, position: int) -> None:
            found = merges.get(left << _SHIFT | right)
            if found is not None:
                if found[0] not in few and found[0] not in many:
                    heapq.heappush(active, found[0])
                few.setdefault(found[0], []).append(position)

        def note_all(left: np.ndarray, right: np.ndarray, position: np.ndarray) -> None:
            wanted = left.astype(np.int64) << _SHIFT | right
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = (keys[at] == wanted) & (left >= 0) & (right >= 0)
            found, position = ranks[at[known]], position[known]
            order = np.argsort(found, kind="stable")
            found, position = found[order], position[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for rank, held in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(position, cuts)):
                if rank not in few and rank not in many:
                    heapq.heappush(active, rank)
                many.setdefault(rank, []).append(held)

        note_all(tokens[:-1], tokens[1:], np.arange(len(token) - 1, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.by_rank[rank]
            single, bulk = few.pop(rank, []), many.pop(rank, [])
            if left != right and len(single) + sum(map(len, bulk)) >= _BULK:
                # Occurrences of a pair of unlike symbols cannot overlap, so all are merged at once.
                p = np.unique(np.concatenate([*bulk, np.array(single, np.int32)]))
                s = afters[p]
                ok = (tokens[p] == left) & (tokens[s] == right)
                p, s = p[ok], s[ok]
                t = afters[s]
                tokens[p], tokens[s], afters[p], befores[t] = new, -2, t, p
                f = befores[p]
                same = np.full(len(p), new, np.int32)
                note_all(np.concatenate([same, tokens[f]]), np.concatenate([tokens[t], same]), np.concatenate([p, f]))
                continue
            for position in sorted({*single, *(x for b in bulk for x in b.tolist())}):
                second = after[position]
                if token[position] != left or token[second] != right:
                    continue
                third, first = after[second], before[position]
                token[position], token[second] = new, -2
                after[position], before[third] = third, position
                if token[third] >= 0:
                    note(new, token[third], position)
                if first >= 0 and token[first] >= 0:
                    note(token[first], new, first)
        closed = np.flatnonzero(tokens == -1)
        ends = np.cumsum(tokens >= 0)[closed].tolist()
        ids = tokens[tokens >= 0].tolist()
        return [tuple(ids[b:e]) for b, e in zip([0, *ends], ends)]

    def encoder(self) -> Iterator[list[list[int]]]:
        """A coroutine: send it texts, get the token ids of each; it remembers words between calls."""
        known: dict[str, tuple[int, ...]] = {s: (i,) for s, i in self.special.items()}
        out: list[list[int]] = []
        while True:
            texts = yield out
            split = [self.split(t) for t in texts]
            new = list(set().union(*split).difference(known)) if split else []
            known.update(zip(new, self.encode_words(new)))
            out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
            if len(known) > CACHE_WORDS:
                known = {s: (i,) for s, i in self.special.items()}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: What encode() can return of each document: Spark's and Arrow's type.
OUTPUTS = {
    "n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string()),
}


def encode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``outputs`` of every row of ``docs``: token ids, their number and digest, the decoded text and its.

    Whole texts are encoded, without adding special tokens; a special token's string in a text is that token. A null
    text counts as empty and has no tokens; repeated rows are all returned; other columns are not read. A word that
    has a character outside the vocabulary loses it. Digests are of the decimal ids joined by a space, and of the
    decoded text in UTF-8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        encoder = vocab.encoder()
        next(encoder)
        decimal = [str(i) for i in range(len(vocab.tokens))]
        for batch in batches:
            for begin, end in slices(batch["text"], _INDEXED_CHARS):
                ids = encoder.send(batch["text"].slice(begin, end - begin).to_pylist())
                out: dict = {}
                if "n_tokens" in outputs:
                    out["n_tokens"] = [len(x) for x in ids]
                if "ids" in outputs:
                    out["ids"] = ids
                if "ids_sha256" in outputs:
                    out["ids_sha256"] = [_hex(" ".join(map(decimal.__getitem__, x))) for x in ids]
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = [vocab.decode(x) for x in ids]
                    out |= {"decoded": decoded, "decoded_sha256": [_hex(x) for x in decoded]}
                columns = [pa.array(out[k], OUTPUTS[k][1]) for k in outputs]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, end - begin), *columns], names=["doc_id", *outputs])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{k} {OUTPUTS[k][0]}" for k in outputs)]))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the tokens of its ids joined by spaces (a null array: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    @F.pandas_udf("string")
    def joined(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: "" if x is None else shared.value.decode(x))

    return encoded.withColumn("decoded", joined(F.col(ids_col)))
