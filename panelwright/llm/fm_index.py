"""A compressed FM-index over integer symbols, searched for many patterns at once.

The Burrows-Wheeler transform is kept as a wavelet tree whose levels are packed
bits with counts per 64 (a wavelet matrix: all nodes of a level side by side).
Of the suffix order every ``SAMPLE``-th text position stays (and the first of
each sequence), and the others are found by walking; of the shared lengths one byte a suffix, and for the way up
two 32-bit places. Runs of suffixes that share a length are marked by packed
bits. The suffix order itself lives only while an index is built.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the lengths that neighbours share.

    Symbol 0 ends a sequence, and no two ends are equal: earlier ones are
    smaller. So nothing is compared beyond the end of a sequence.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    ranks, k = [rank], 1
    while True:
        ahead = np.zeros(n, np.int64)
        if k < n:
            ahead[:-k] = rank[k:]
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        k *= 2
        if new.all():
            break
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    share = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[ok] = ranks[j][a[ok]] == ranks[j][b[ok]]
        step = same.astype(np.int64) << j
        a, b, share = a + step, b + step, share + step
    lcp[1:] = share
    return order, lcp


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 if none."""
    at = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo):
        up = at[todo]
        todo = todo[(up >= 0) & (values[np.maximum(up, 0)] >= values[todo])]
        at[todo] = at[at[todo]]
    return at


#: Every how many text positions the place in the order is kept, besides those where a sequence begins.
SAMPLE = 32


class FMIndex:
    """Index of a text of symbols 0 .. sigma-1; 0 ends every sequence, the last too, and is in no pattern.

    depth: the longest match that is told apart, below 256. values: a number for
    each text position, of which ``least`` gives the smallest.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int, values: np.ndarray | None = None):
        if not 0 < depth < 256:
            raise ValueError("depth is from 1 to 255")
        self.n, self.depth = len(text), depth
        order, lcp = suffix_order(text)
        self.lcp = np.minimum(lcp, depth).astype(np.uint8)
        del lcp
        bwt = text[order - 1].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1 > 0
            self.levels.append((shift, Bits(bit)))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(sigma)
        self.begin = self._descend(symbols, np.zeros(sigma, np.int64))
        self._left, self._segment = None, {}
        # The first symbol of a sequence too, so that no walk passes an end.
        sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.is_sampled, self.samples = Bits(sampled), order[sampled].astype(np.int32)
        self._least = None
        if values is not None and self.n:
            starts, _ = self._segments(depth)
            self._least = np.minimum.reduceat(values[order], starts[:-1])

    def symbol_at(self, at: np.ndarray) -> np.ndarray:
        """The symbols of the transform at these places."""
        found = np.zeros(len(at), np.int64)
        for shift, bits in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            found |= one.astype(np.int64) << shift
            at = np.where(one, bits.zeros + ones, at - ones)
        return found

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their places: steps back to a sampled one."""
        at, out, todo = place.copy(), np.zeros(len(place), np.int64), np.arange(len(place))
        steps = 0
        while len(todo):
            here = self.is_sampled.get(at[todo])
            done = todo[here]
            out[done] = self.samples[self.is_sampled.rank(at[done])] + steps
            todo, steps = todo[~here], steps + 1
            symbol = self.symbol_at(at[todo])
            at[todo] = self._descend(symbol, at[todo]) + self.first[symbol] - self.begin[symbol]
        return out

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the symbol followed by what the given intervals stand for."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        both += np.concatenate([self.first[symbol] - self.begin[symbol]] * 2)
        return both[: len(low)], both[len(low) :]

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        if self._left is None:
            edge = self._edge(np.arange(self.n + 1))
            self._left = nearest_smaller(edge).astype(np.int32)
            self._right = (self.n - nearest_smaller(edge[::-1])[::-1]).astype(np.int32)
        return self._left, self._right

    def _edge(self, at: np.ndarray) -> np.ndarray:
        """What the suffixes at at - 1 and at share; -1 at both ends of the order."""
        inside = (at > 0) & (at < self.n)
        return np.where(inside, self.lcp[np.minimum(at, self.n - 1)].astype(np.int64), -1)

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger intervals, of shorter matches, and their lengths."""
        left, right = self._neighbours()
        a, b = self._edge(low), self._edge(high)
        size = np.maximum(a, b)
        new_low = np.where(a == size, left[low], low)
        new_high = np.where(b == size, right[high], high)
        top = size < 0
        return np.where(top, 0, new_low), np.where(top, self.n, new_high), np.where(top, -1, size)

    def matches(self, patterns: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the patterns the length of the longest match that begins there, up to depth, and where it stands in the order.

        Patterns are read from right to left, all at once. A symbol the text
        does not have is any number from sigma up.
        """
        length = np.zeros(len(patterns), np.int64)
        place = np.zeros(len(patterns), np.int64)
        lanes = np.flatnonzero(np.diff(offsets))
        at = offsets[1:][lanes] - 1
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n)
        size = np.zeros(len(lanes), np.int64)
        while len(lanes):
            full = size == self.depth  # a match of depth has no room for one more symbol
            while full.any():
                low[full], high[full], size[full] = self.parent_to(low[full], high[full], self.depth - 1)
                full = size == self.depth
            symbol = patterns[at]
            todo = np.flatnonzero(symbol < len(self.begin))
            strange = np.flatnonzero(symbol >= len(self.begin))
            low[strange], high[strange], size[strange] = 0, self.n, 0
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                good = a < b
                hit = todo[good]
                low[hit], high[hit] = a[good], b[good]
                size[hit] += 1
                todo = todo[~good]
                low[todo], high[todo], up = self.parent(low[todo], high[todo])
                size[todo] = np.maximum(up, 0)
                todo = todo[up >= 0]
            length[at], place[at] = size, low
            at = at - 1
            on = at >= offsets[:-1][lanes]
            lanes, at, low, high, size = lanes[on], at[on], low[on], high[on], size[on]
        return length, place

    def parent_to(self, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of the first ``size`` symbols of what the given intervals stand for."""
        starts, marks = self._segments(size)
        seg = marks.rank(low + 1) - 1
        return starts[seg].astype(np.int64), starts[seg + 1].astype(np.int64), np.full(len(low), size)

    def _segments(self, size: int) -> tuple[np.ndarray, Bits]:
        """Where runs of suffixes that share ``size`` symbols begin, and these places as bits."""
        if size not in self._segment:
            new = self.lcp < size
            new[0] = True
            self._segment[size] = np.append(np.flatnonzero(new), self.n).astype(np.int32), Bits(new)
        return self._segment[size]

    def least(self, place: np.ndarray) -> np.ndarray:
        """The least of values over suffixes that share ``depth`` symbols with the one at each place."""
        return self._least[self._segments(self.depth)[1].rank(place + 1) - 1]
