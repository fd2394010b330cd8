"""Vectorised text work on Arrow batches: bytes, words, shingles.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.  They
are kept as 64-bit hashes; two different words of a corpus share a hash with a
chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = mix(np.arange(300, 332, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return off, data


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """Words of rows a..b: ``hash`` in text order, ``at`` with the row borders, ``start`` and ``end`` byte positions."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        base = off[0]
        text = data[base : off[-1]]
        off = off - base
        full = ~_SPACE[text]
        first = full.copy()
        first[1:] &= ~full[:-1]
        last = full.copy()
        last[:-1] &= ~full[1:]
        inner = off[(off > 0) & (off < len(text))]
        first[inner] = full[inner]
        last[inner - 1] = full[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, off)
        self.off = off
        size = self.end - self.start
        self.text = _LOWER[text]
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        where = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(where, size)
        power = _POWERS if size.max() <= len(_POWERS) else _powers(int(size.max()))
        self.hash = mix(np.add.reduceat(_BYTE[self.text[full]] * power[inside], where) + size.astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of a row, and the row borders in them; a row of 1 to n-1 words gives one, of all its words."""
        count = np.diff(self.at)
        rows = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        border = np.concatenate(([0], np.cumsum(rows)))
        total = len(self.hash)
        if not total:
            return np.zeros(0, np.uint64), border
        take = np.arange(int(border[-1])) - np.repeat(border[:-1], rows) + np.repeat(self.at[:-1], rows)
        left = np.repeat(self.at[1:], rows) - take
        sums = np.zeros(len(take), np.uint64)
        for k in range(n):
            ok = left > k
            sums += np.where(ok, self.hash[np.minimum(take + k, total - 1)] * _STEP[k], np.uint64(0))
        return mix(sums), border


def words_of(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    off, data = raw(col)
    for a, b in chunks(off, size):
        yield a, b, Words(off[a : b + 1], data)


def sets_of(col: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-word shingles, as uint64."""
    for a, b, w in words_of(col):
        grams, border = w.grams(n)
        for k in range(b - a):
            yield np.unique(grams[border[k] : border[k + 1]])
