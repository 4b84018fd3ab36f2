"""A compressed FM-index over integer symbols: bit-packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; every suffix ends at the text's end, which sorts first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        order = np.lexsort((ahead, rank))
        a, b = rank[order], ahead[order]
        new = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank[order] = new
        if n == 0 or new[-1] == n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector with a count per 64 bits for each bit of a symbol."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            ones = ((values >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(_U)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(int(len(ones) - ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            word = i >> 6
            mask = (_U(1) << (i & 63).astype(_U)) - _U(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i."""
        return self._walk(symbol, i) - self.first[symbol]


class FMIndex:
    """Symbols are 0 .. sigma-1; symbol 0 must not occur in the text."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.r_[np.asarray(text, np.int64), 0]
        self.sa = suffix_array(text)
        self.wavelet = WaveletMatrix(text[self.sa - 1], sigma)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals [low, high) of the rows of patterns, which take their backward steps together."""
        last = patterns[:, -1]
        low, high = self.below[last], self.below[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, j]
            low = self.below[c] + self.wavelet.rank(c, low)
            high = self.below[c] + self.wavelet.rank(c, high)
        return low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first text position of each interval; -1 for an empty one."""
        found = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(high > low)
        if len(some):
            pairs = np.stack([low[some], high[some]], 1).ravel()
            found[some] = np.minimum.reduceat(np.r_[self.sa, len(self.sa)], pairs)[::2]
        return found
