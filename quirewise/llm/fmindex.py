"""A compressed FM-index over integer symbols: packed wavelet matrix, vectorised backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in any prefix, for arrays of queries at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.size = len(symbols)
        self.words, self.ranks, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.ranks.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(self.size - int(bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])
        # Where the occurrences of each symbol begin after the last level.
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ranks[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        return self._down(symbol, at) - self.begin[symbol]


class FmIndex:
    """Backward search for patterns of up to ``depth`` symbols (a power of two) in ``text``.

    Suffixes are ordered by their first ``depth`` symbols, which is all that
    patterns of that length can tell apart.  Symbols are 0 to sigma - 1; the
    text ends in 0, which no pattern holds.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int = 32):
        size = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            second = np.zeros(size, np.int64)
            second[: max(0, size - width)] = rank[width:] + 1
            rank = np.unique(rank * (size + sigma + 1) + second, return_inverse=True)[1]
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        self.size = size

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` put in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.before[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least text position in each interval; the intervals are equal or apart."""
        if not len(lo):
            return lo
        order, back = np.unique(lo, return_inverse=True)
        ends = np.zeros(len(order), np.int64)
        ends[back] = hi
        edges = np.stack([order, ends], axis=1).ravel()
        return np.minimum.reduceat(np.append(self.suffixes, self.size), edges)[::2][back]
