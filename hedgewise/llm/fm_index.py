"""An FM-index over integer symbols: suffix sorting, wavelet-matrix ranks, backward search, sampled positions.

Everything is vectorised over many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # every SAMPLE-th text position is kept; others are reached by stepping back


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order. The last symbol must be smaller than all others.

    Ranks by prefixes of doubling length; only suffixes that are still tied are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(symbols[order])
    tied = np.flatnonzero(_in_groups(rank[order]))
    width = 1
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[np.minimum(at + width, n - 1)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        rank[at] = tied[_group_starts(key)]
        tied = tied[_in_groups(rank[at])]
        width *= 2
    return order


def _group_starts(values: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the index of the first equal one."""
    first = np.concatenate([[True], values[1:] != values[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))


def _in_groups(values: np.ndarray) -> np.ndarray:
    """Whether an element of a sorted array has an equal neighbour."""
    same = values[1:] == values[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


class Bits:
    """A bit vector with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    """``symbols``: non-negative numbers below ``alphabet``. Patterns must not contain ``separator`` symbols to cross records."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        text = np.concatenate([np.asarray(symbols, np.int64) + 1, [0]])
        order = suffix_array(text)
        last = text[order - 1]  # the symbol before each suffix; position 0 is preceded by the end mark
        self.size, self.alphabet = len(text), alphabet + 1
        counts = np.bincount(text, minlength=self.alphabet)
        self.first = np.cumsum(counts) - counts
        self.levels: list[tuple[Bits, int]] = []
        row = last
        self.depth = max(1, int(self.alphabet - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            one = (row >> level & 1).astype(bool)
            self.levels.append((Bits(one), int(len(row) - one.sum())))
            row = np.concatenate([row[~one], row[one]])
        self.start = self._descend(np.arange(self.alphabet), np.zeros(self.alphabet, np.int64))
        kept = order % SAMPLE == 0
        self.kept, self.positions = Bits(kept), order[kept]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before row ``at`` in the last column."""
        return self._descend(symbol, at) - self.start[symbol]

    def _symbol(self, row: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros(len(row), np.int64), row
        for bits, zeros in self.levels:
            one = bits[at]
            ones = bits.rank(at)
            symbol, at = symbol * 2 + one, np.where(one, zeros + ones, at - ones)
        return symbol

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern (rows of a padded matrix)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.flatnonzero(lengths > 0)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - step] + 1
            low[live] = self.first[symbol] + self._rank(symbol, low[live])
            high[live] = self.first[symbol] + self._rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled position is met."""
        out, steps, pending, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(pending):
            done = self.kept[at]
            out[pending[done]] = self.positions[self.kept.rank(at[done])] + steps
            pending, at = pending[~done], at[~done]
            symbol = self._symbol(at)
            at = self.first[symbol] + self._rank(symbol, at)
            steps += 1
        return out
