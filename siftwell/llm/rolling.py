"""Vectorised hashing of words, word windows and byte windows over Arrow string batches.

Everything here is a few NumPy passes over one batch's contiguous byte buffer; no Python
loop runs per word or per byte.  A span's hash is a polynomial modulo 2**64 read off a
prefix sum, then finished with an avalanche step; callers that need more certainty than 64
bits draw a second hash from independent constants or compare the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLES = [np.random.default_rng(20240917 + i).integers(1, 2**64 - 1, 256, dtype=np.uint64) for i in range(2)]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of a base and of its inverse modulo 2**64, grown by doubling."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            out.append(p)
        _POWERS[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def avalanche(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[s:e] for each span; equal sequences give equal hashes."""
    power, inverse = powers(which, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[:-1], out=total[1:])
    return avalanche((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def byte_values(buf: np.ndarray, table: int = 0) -> np.ndarray:
    return _TABLES[table][buf]


#: Bytes that are hashed at once.
BLOCK = 1 << 18


class Batch:
    """The UTF-8 bytes of one Arrow string column; nulls count as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of all words, and per document the first word's index."""
        solid = ~_SPACE[self.buf]
        n = len(solid)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit word hashes; lower folds A-Z only."""
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):  # a block of text at a time, so temporaries stay small
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
            low, high = int(starts[at]), int(ends[end - 1])
            buf = self.buf[low:high]
            if lower:
                buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
            out[at:end] = span_hashes(byte_values(buf), starts[at:end] - low, ends[at:end] - low, 0)
            at = end
        return out


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of width keys, the place of its smallest key (leftmost on ties)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place = keys, np.arange(len(keys), dtype=np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        take = right < left
        value = np.where(take, right, left)
        place = np.where(take, place[step:], place[:-step])
        have += step
    return place[:n]


def cuts(nbytes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose bytes stay under a bound (single rows may exceed it)."""
    out, start, held = [], 0, 0
    for i, b in enumerate(nbytes.tolist()):
        if i > start and held + b > most:
            out.append((start, i))
            start, held = i, 0
        held += b
    if start < len(nbytes):
        out.append((start, len(nbytes)))
    return out
