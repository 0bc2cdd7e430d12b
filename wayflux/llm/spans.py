"""Word and shingle hashes of many texts at once, in numpy and in bounded blocks."""

from __future__ import annotations

import re

import numpy as np

from wayflux.llm.common import mix64

#: Bytes whose hashes are computed in one go.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> list[bytes]:
    """``text`` cut at white space into pieces of about a block."""
    if len(text) <= BLOCK:
        return [text]
    out, begin = [], 0
    while len(text) - begin > BLOCK:
        m = _NEXT_SPACE.search(text, begin + BLOCK)
        if not m:
            break
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    found, held, owner, size = [], [], [], 0

    def flush() -> None:
        hashes, starts = _block(b"\n".join(held))
        begins = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        np.add.at(counts, np.array(owner), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
        found.append(hashes)
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence if it is shorter (none: empty)."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : len(words) - width + 1 + i]
    return mix64(out + np.uint64(width))
