"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Separators of the word patterns used here are ASCII, so words can be told by bytes. A word's hash is
a polynomial over its bytes taken from prefix sums; a window's hash is one over its words' hashes.
Both are modulo 2**64, over random-looking coefficients and mixed, so that equal hashes stand for
equal words but for a chance of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix, utf8

#: [^\x20\x09-\x0D]
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z were put in lower case
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of an odd base, and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[base] = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, b, U64))])[:size] for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    up, down = _power(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(values)])])
    return (sums[stops] - sums[starts]) * down[starts]


class Words:
    """``starts`` and ``stops`` (bytes) of all words; the words of row r are ``rows[r]:rows[r + 1]``."""

    def __init__(self, texts, pattern: np.ndarray, lower: bool = False):
        data, offsets = utf8(texts)
        self.data = LOWER[data] if lower else data
        inside = pattern[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        first[at] = inside[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = inside[at]
        self.starts, self.stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.rows)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        h = _ranges(_BYTE[self.data], self.starts, self.stops, _BASES[0])
        return mix(h + (self.stops - self.starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, hashes: np.ndarray, length: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``length`` words from each word on, and whether its row goes that far."""
        n = len(hashes)
        out, whole = np.zeros(n, U64), np.zeros(n, bool)
        if n >= length:
            at = np.arange(n - length + 1)
            out[at] = mix(_ranges(hashes, at, at + length, _BASES[which]) ^ U64(length))
            whole[at] = self.rows[self.row[at] + 1] >= at + length
        return out, whole


def ranges_hash(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """Hash of ``values[start:stop]`` for each range."""
    return mix(_ranges(values, starts, stops, _BASES[which]) ^ (stops - starts).astype(U64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each value and the next ``width - 1`` (cut at the end), ties leftmost."""
    best, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = best[: len(best) - step], best[step:]
        if len(right):
            best[: len(left)] = np.where(values[right] < values[left], right, left)
        done += step
    return best
