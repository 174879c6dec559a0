"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes that are not white space (``[^\\x20\\x09-\\x0D]+``), optionally with A-Z
lower-cased. Texts are taken whole; they are worked through in pieces of a quarter of a megabyte, cut
between words, so memory does not depend on how long a single text is beyond its own arrays.

A word's hash is a polynomial in a random odd base over random values of its bytes, modulo 2**64,
taken from running sums, and then mixed; sequences of words are hashed from word hashes the same way.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            ladder = [np.full(size, x, np.uint64) for x in (self.base, self.inverse)]
            for x in ladder:
                x[0] = 1
            self.up, self.down = (np.cumprod(x) for x in ladder)
        return self.up, self.down


_IN_BYTES, _IN_WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of texts in order: text i has the words ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray):
    """Where to cut the bytes into pieces: after white space, or at the end."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            back = 256
            while True:
                low = max(at, end - back)
                found = np.flatnonzero(_SPACE[data[low:end]])
                if len(found):
                    end = low + int(found[-1]) + 1
                    break
                if low == at:
                    rest = np.flatnonzero(_SPACE[data[end : end + PIECE]])
                    end = end + int(rest[0]) + 1 if len(rest) else min(end + PIECE, n)
                    if len(rest) or end == n:
                        break
                back *= 16
        yield at, end
        at = end


def words(texts, *, lower: bool) -> Words:
    data, offsets = utf8(texts)
    values = _BYTE_LOWER if lower else _BYTE
    hashes, starts, ends = [], [], []
    for at, end in _cuts(data):
        piece = data[at:end]
        inside = ~_SPACE[piece]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        begin[own] = inside[own]
        before = own[own > 0] - 1
        finish[before] = inside[before]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        up, down = _IN_BYTES.upto(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(h, np.searchsorted(s, offsets).astype(np.int64), s, e, data)


def counted(texts) -> np.ndarray:
    """The number of words of each text."""
    data, offsets = utf8(texts)
    total = np.zeros(len(offsets), np.int64)
    for at, end in _cuts(data):
        inside = ~_SPACE[data[at:end]]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        low, high = np.searchsorted(offsets, at), np.searchsorted(offsets, end)
        own = offsets[low:high] - at
        begin[own] = inside[own]
        seen = np.concatenate(([0], np.cumsum(begin)))
        total[low:high] += seen[own]
        total[high:] += seen[-1]
    return np.diff(total)


def sequences(hashes: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hashes of the ``length`` values (a number, or one for each place) that begin at each place."""
    up, down = _IN_WORDS.upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at] + np.asarray(length).astype(np.uint64))


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """The places at which a window of that many words begins and ends within one text."""
    counts = np.diff(bounds)
    room = np.maximum(counts - length + 1, 0)
    shift = np.repeat(bounds[:-1] - (np.cumsum(room) - room), room)
    return np.arange(room.sum(), dtype=np.int64) + shift
