"""An FM-index over integer symbols: suffix order, Burrows-Wheeler transform and wavelet matrix in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletMatrix:
    """Rank of symbols over a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(int(n_symbols - 1).bit_length(), 1)
        self.levels, self.zeros = [], []
        for b in reversed(range(self.depth)):
            bit = (symbols >> b & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

        self.bucket = self.descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` comes in the order of the last level, along the bits of each symbol."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.descend(symbol, at) - self.bucket[symbol]


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Starts of the suffixes in order; equal ones are told apart by at least their first ``least`` symbols (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if width >= least or fresh[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """Backward search over symbol sequences, each ended by symbol 0."""

    def __init__(self, text: np.ndarray, longest: int):
        """text: symbols from 1 and separators 0. Patterns may have up to ``longest`` symbols."""
        self.order = suffix_order(text, longest + 1)
        self.n_symbols = int(text.max()) + 1 if len(text) else 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])[:-1]
        self.matrix = WaveletMatrix(text[self.order - 1], self.n_symbols)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns of low and high with a symbol put before each."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.starts[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the rows of ``patterns`` (equally long), searched in step from the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.order), np.int64)
        for k in reversed(range(patterns.shape[1])):
            low, high = self.extend(patterns[:, k], low, high)
        return low, high

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end in a stream that is itself indexed: the length, at most ``longest``, of the longest run up to it
        that stands more than once in the index, and that run's suffix interval. Runs do not pass separators."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        length, alive = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for k in range(longest):
            alive = alive[ends[alive] >= k]
            symbol = stream[ends[alive] - k]
            alive, symbol = alive[symbol > 0], symbol[symbol > 0]
            if not len(alive):
                break
            a, b = self.extend(symbol, low[alive], high[alive])
            more = b - a > 1
            alive = alive[more]
            low[alive], high[alive], length[alive] = a[more], b[more], k + 1
        return length, low, high
