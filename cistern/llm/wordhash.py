"""Hashes of all words of many texts at once, in numpy.

A word hash is a polynomial in its bytes modulo 2**64, mixed afterwards. Texts are handled in pieces of bounded
size that end at a separator, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def lowered(space: bytes = b" \t\n\x0b\x0c\r") -> tuple[np.ndarray, np.ndarray]:
    """(which bytes separate words, byte -> value of its letter with A-Z as a-z)."""
    separates = np.zeros(256, bool)
    separates[np.frombuffer(space, np.uint8)] = True
    of = np.arange(256, dtype=np.uint64)
    of[65:91] += np.uint64(32)
    values = mix(of + np.uint64(1)) | np.uint64(1)
    values[separates] = 0
    return separates, values


#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese. First and last code points of three bytes.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def unspaced_breaks(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 before and behind each character of a script without spaces."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    lead, second, third = (data[at + k].astype(np.int64) for k in range(3))
    code = (lead & 15) << 12 | (second & 63) << 6 | third & 63
    own = np.zeros(len(at), bool)
    for a, b in UNSPACED:
        own |= (lead < 0xF0) & (code >= a) & (code <= b)
    wide = at[(lead == 0xF0) & (second >= 0xA0)]  # planes 2 and 3, four bytes
    own = at[own]
    return np.concatenate([own, own + 3, wide, wide + 4])


class WordHasher:
    def __init__(self, space: bytes = b" \t\n\x0b\x0c\r", characters: bool = False):
        """characters: in scripts without spaces each character is a word."""
        self.separates, self.values = lowered(space)
        self.characters = characters
        self._grow(PIECE + 1)

    def _grow(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
        self.down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte behind) of every word of the texts that begin at `starts`."""
        found = [self._piece(data, starts, a, b) for a, b in self._cuts(data)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _cuts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        a, n = 0, len(data)
        while a < n:
            b = min(n, a + PIECE)
            if b < n:
                if len(at := np.flatnonzero(self.separates[data[a:b]])):
                    b = a + int(at[-1]) + 1
                else:
                    while b < n and not self.separates[data[b]]:
                        b += 1
            yield a, b
            a = b

    def _piece(self, data: np.ndarray, starts: np.ndarray, a: int, b: int):
        part = data[a:b]
        inside = ~self.separates[part]
        breaks = np.zeros(len(part) + 1, bool)
        breaks[0] = breaks[-1] = True
        own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        breaks[own] = True
        if self.characters:
            breaks[unspaced_breaks(part)] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | breaks[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | breaks[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(begin):
            return np.zeros(0, np.uint64), begin, end
        if len(part) > len(self.up):
            self._grow(len(part) + 1)
        h = np.add.reduceat(self.values[part] * self.up[: len(part)], begin)
        return mix(h * self.down[begin]), begin + a, end + a


def text_blocks(column: pa.Array, limit: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind, bytes, offsets of the rows and the end) of runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b
