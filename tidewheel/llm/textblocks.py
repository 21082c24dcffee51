"""Words and word n-grams of Arrow text columns as numpy arrays.

Texts are taken in blocks of bounded size, so that the arrays stay small however long the Arrow
batch is. A word is a longest run of bytes other than space and 0x09-0x0D; in UTF-8 those bytes
never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Bytes of words that are hashed at once: arrays of this size stay in a core's cache.
RUN_BYTES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDED = np.random.Generator(np.random.PCG64(20240607))
_PLACE_KEYS = _SEEDED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    told = h >> np.uint64(33)
    told ^= h
    h = told
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run of bytes data[start:end]; runs are in order and don't overlap.

    A sum of a pseudorandom value for each pair of byte and place in the run. Unlike a polynomial
    modulo 2**64, it has no structure that makes long unequal runs collide. Runs are taken a block at a
    time, so that temporary arrays stay small for a text of any length.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    size = end - start
    upto = np.cumsum(size)
    values = _byte_values(seed)
    i = 0
    while i < len(start):
        before = upto[i] - size[i]
        j = max(i + 1, int(np.searchsorted(upto, before + RUN_BYTES, side="right")))
        n, first = size[i:j], upto[i:j] - size[i:j] - before
        every = np.arange(int(upto[j - 1] - before), dtype=np.int32)
        place = every - np.repeat(first.astype(np.int32), n)
        own = data[every + np.repeat((start[i:j] - first).astype(np.int64), n)]
        value = values[(place & 63) << 8 | own]
        if n.max() > 64:  # the table has 64 places: later ones get another key for each 64
            value *= mix((place >> 6).astype(np.uint64)) | np.uint64(1)
        out[i:j] = np.add.reduceat(value, first)
        i = j
    return mix(out + size.astype(np.uint64))


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    """A value for each place in 64 and byte."""
    return mix(np.arange(64 * 256, dtype=np.uint64) + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % 2**64))


def text_array(column: pa.Array) -> pa.LargeStringArray:
    """The column with null as the empty text."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(texts: pa.LargeStringArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows within bytes); a block holds one row or at most ``most`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a block: byte ``start`` and ``end`` of each, and ``first``: for row r, words first[r] to first[r+1]-1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word; those of two seeds are independent of each other."""
        return run_hashes(self.data, self.start, self.end, seed)


def ngrams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n words; runs over the end of a row are in it too and are the caller's to leave out."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        h += words[j : len(words) - n + 1 + j] * _PLACE_KEYS[(j + salt) % 64]
    h += np.uint64(n + (salt << 8))
    return mix(h)
