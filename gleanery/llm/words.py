"""Words and word shingles of many texts at once, as 64-bit hashes of their bytes.

The hash of a word is a polynomial in per-byte random values, modulo 2**64, taken
from running sums over the whole buffer, then mixed; it depends on the word's
bytes alone. Shingle hashes combine the word hashes by place.
"""

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SHINGLE = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@cache
def _byte_values() -> np.ndarray:
    """A random value per byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    return values


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words: all but those in ``ranges`` (both ends included); A-Z go with a-z."""
    member = np.ones(256, bool)
    for first, last in ranges:
        member[first : last + 1] = False
    member[65:91] = member[97:123]
    return member


#: words are runs without space, tab, line feed, vertical tab, form feed and carriage return
SPACED = [(0x20, 0x20), (0x09, 0x0D)]
#: words are runs of ASCII letters and digits and of all characters beyond ASCII
ALPHANUMERIC = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


class Words:
    """Words of one step: per word its row, hash and byte range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        n = len(data)
        if n == 0:
            self.row = self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        inside = member[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (first[:-1] | ~before))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        size = 1 << max(20, int(n).bit_length())
        up, down = _powers(size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words in one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, combine([self.hash[at + j] for j in range(k)])

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of words; its length counts."""
    total, factor = np.full_like(hashes[0], len(hashes)), 1
    for h in hashes:
        factor = factor * _SHINGLE % (1 << 64)
        total = total + h * np.uint64(factor)
    return mix(total)
