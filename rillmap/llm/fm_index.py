"""An FM-index over integer sequences: a wavelet matrix of the Burrows-Wheeler transform, backward search and sampled suffix positions."""
from __future__ import annotations

import numpy as np

SAMPLE = 8


class RankBits:
    """A bit vector with the number of ones before every 64 positions."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Rank and access over symbols below ``size``, one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.digits = range(max(1, int(size - 1).bit_length()) - 1, -1, -1)
        self.levels, rest = [], symbols
        for d in self.digits:
            ones = (rest >> d) & 1 > 0
            self.levels.append(RankBits(ones))
            rest = np.concatenate([rest[~ones], rest[ones]])
        self.first = np.zeros(size, np.int64)
        self.first = self._descend(np.arange(size), self.first)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for d, level in zip(self.digits, self.levels):
            ones = level.rank(at)
            at = np.where((symbol >> d) & 1 > 0, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.first[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before that position."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            bit, ones = level[at], level.rank(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, level.zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; a suffix that is a prefix of another comes first."""
    n, step = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        key = rank * (n + 2)
        key[:max(0, n - step)] += rank[step:]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if n else 0
        if n == 0 or new[order[-1]] == n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Symbols are positive and below ``size``; 0 separates stretches and never matches. All are raised by one to make room for the only end mark."""

    def __init__(self, symbols: np.ndarray, size: int):
        text, size = np.append(symbols + 1, 0), size + 1
        order = suffix_array(text)
        self.n = len(text)
        self.last = WaveletMatrix(text[order - 1], size)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:size]
        held = order % SAMPLE == 0
        self.held, self.samples = RankBits(held), order[held]

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (one per row): the range of suffixes that start with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, step] + 1
            both = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.below[symbol] + both[:len(live)], self.below[symbol] + both[len(live):]
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by rank: walk back to a sampled one."""
        place, open_, rows, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.held[rows]
            place[open_[found]] = self.samples[self.held.rank(rows[found])] + steps
            open_, rows = open_[~found], rows[~found]
            symbol, rank = self.last.access_rank(rows)
            rows, steps = self.below[symbol] + rank, steps + 1
        return place
