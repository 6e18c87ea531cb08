"""A compressed index of word sequences: the Burrows-Wheeler transform in a wavelet matrix, searched backwards in numpy.

Rows are ordered by their first DEPTH symbols, which is all that a search of at most DEPTH symbols needs. Bits are packed
with a rank directory; a symbol takes about log2 of the alphabet in bits. Many sequences are searched at a time, a symbol
of each in a step.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector and the ones before each of its words."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        part = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)


class Wavelet:
    """Ranks of any symbol of a sequence: a bit vector for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n, self.height = len(symbols), max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        rest = symbols
        for shift in range(self.height - 1, -1, -1):
            one = (rest >> shift & 1).astype(bool)
            bits = Bits(one)
            self.levels.append((bits, self.n - bits.ones))
            rest = np.concatenate([rest[~one], rest[one]])
        every = np.arange(alphabet, dtype=np.int64)
        self.start = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (bits, zeros) in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.start[symbol]


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks) of pairs of numbers below 2**32."""
    both = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    fresh = np.ones(len(both), np.int64)
    sorted_ = both[order]
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(both), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return order, rank


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """The ranks of the places `by` further on, 0 behind the end and above 0 before it."""
    out = np.zeros_like(rank)
    if by < len(rank):
        out[:-by] = rank[by:] + 1
    return out


class Index:
    """Sequences of symbols from 1 on, each with a mark; the least mark of all places where a match begins is kept.

    symbols: all sequences, one behind the other, each followed by a 0. marks: for each symbol.
    """

    def __init__(self, symbols: np.ndarray, marks: np.ndarray, alphabet: int, depth: int):
        self.depth = depth
        order, rank = _ranked(symbols, np.zeros_like(symbols))
        size = 1
        while size < depth:
            step = min(size, depth - size)  # the last step overlaps: exactly `depth` symbols are compared
            order, rank = _ranked(rank, _shifted(rank, step))
            size += step
        self.order = order
        self._symbols = symbols
        before = np.concatenate([symbols[-1:], symbols])[order]  # the symbol before each row's
        self.wavelet = Wavelet(before, alphabet)
        held = np.bincount(symbols, minlength=alphabet)
        self.first = np.cumsum(held) - held
        starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        self.least = np.repeat(np.minimum.reduceat(marks[order], starts), np.diff(starts, append=len(order)))
        self._bounds: dict[int, np.ndarray] = {}

    def _bounds_of(self, size: int) -> np.ndarray:
        """First rows of the runs that share `size` symbols, and the end."""
        if size not in self._bounds:
            if size == 0:
                found = np.array([0, len(self.order)])
            else:
                whole = _symbols_from(self._symbols, self.order, size)
                found = np.append(np.flatnonzero(np.append(True, whole)), len(self.order))
            self._bounds[size] = found
        return self._bounds[size]

    def widen(self, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share the first `size` symbols of the row at each place."""
        bounds = self._bounds_of(size)
        at = np.searchsorted(bounds, low, "right") - 1
        return bounds[at], bounds[at + 1]

    def statistics(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, least mark) for each place of the sequences symbols[begin:end]: of the longest match, of at most
        `depth` symbols, that begins there.

        Sequences are read backwards. A match grows by the symbol before it; where it can't, or is as long as it may be,
        its last symbol is given up.
        """
        length, mark = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        turn = np.argsort(begin - end, kind="stable")  # the longest first: those still read are a prefix
        begin, at = begin[turn], end[turn] - 1
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64), np.zeros(len(at), np.int64)
        while len(at) and at[0] >= begin[0]:
            n = int(np.searchsorted(begin - at, 0, "right"))
            begin, at, lo, hi, size = begin[:n], at[:n], lo[:n], hi[:n], size[:n]
            c = symbols[at]
            full = np.flatnonzero(size == self.depth)
            if len(full):
                lo[full], hi[full] = self.widen(lo[full], self.depth - 1)
                size[full] = self.depth - 1
            todo = np.arange(n)
            while len(todo):
                both = self.wavelet.rank(np.tile(c[todo], 2), np.concatenate([lo[todo], hi[todo]]))
                a, b = self.first[c[todo]] + both[: len(todo)], self.first[c[todo]] + both[len(todo) :]
                fits = a < b
                good, bad = todo[fits], todo[~fits]
                lo[good], hi[good] = a[fits], b[fits]
                size[good] += 1
                none = bad[size[bad] == 0]  # a symbol that the index lacks
                lo[none], hi[none] = 0, len(self.order)
                todo = bad[size[bad] > 0]
                for k in np.unique(size[todo]):
                    own = todo[size[todo] == k]
                    lo[own], hi[own] = self.widen(lo[own], int(k) - 1)
                    size[own] = k - 1
            length[at] = size
            whole = size == self.depth
            mark[at[whole]] = self.least[lo[whole]]
            at = at - 1
        return length, mark


def _symbols_from(symbols: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each row but the first: whether it differs from the one before in its first `size` symbols."""
    n = len(symbols)
    differs = np.zeros(len(order) - 1, bool)
    for k in range(size):
        at = order + k
        c = np.where(at < n, symbols[np.minimum(at, n - 1)], -1)
        differs |= c[1:] != c[:-1]
    return differs
