"""Whole-batch text work on Arrow buffers with numpy.

A chunk is a few documents whose UTF-8 bytes lie side by side. Positions are
found on the bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Odd multiplier of the polynomial hash; any fixed odd number does.
RADIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE
#: Letters and digits of ASCII and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], m = 1, 1
        while m < size:
            have[m : 2 * m] = have[:m] * np.uint64(pow(base, m, 1 << 64))
            m *= 2
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """Hashes of any spans of one array of integers, by prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(RADIX, n), out=self.sums[1:])
        self.back = powers(pow(RADIX, -1, 1 << 64), n + 1)

    def __call__(self, start, end) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + np.asarray(end - start, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    rows: slice  # of the batch
    data: np.ndarray  # the bytes
    offsets: np.ndarray  # where documents start, and the end

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each document where its words begin."""
        inside = kind[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first[full] = inside[full]
        ends = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        last[ends] = inside[ends]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null has no bytes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if large else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The whole column in runs of documents of about limit bytes; a longer text is a chunk alone."""
    data, offsets = column_bytes(col)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Chunk(slice(row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element, the index of the run that it lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """min(values[p:p+w]) for each p with a full window; values are not negative as unsigned."""
    n = len(values)
    if n < w:
        return values[:0]
    if w == 1:
        return values
    size = -(-n // w) * w
    grid = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
