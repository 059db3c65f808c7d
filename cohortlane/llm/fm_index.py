"""FM-index over a shard of a corpus: backward search and location of phrases.

A shard is one array of symbols; 0 separates, everything else is a word. Words
that no test phrase holds are separators too: no phrase can cross them.
Separators count as different from each other, in order of their place, so no
comparison of suffixes crosses one and the sort ends after a few doublings.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes in sorted order; the last symbol must be a separator.

    The first key packs as many symbols as fit in a machine word; then ranks
    are doubled for those rows alone that still tie.
    """
    n, width = len(symbols), max(1, 62 // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        ahead = np.zeros(n, np.int64)
        ahead[: n - j] = symbols[j:] if j < n else 0
        key = (key << bits) | np.where(alive, ahead, 0)
        alive &= ahead != 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    group = np.repeat(first, np.diff(np.append(first, n)))
    # suffixes that have ended tie only by place, which the stable sort has settled
    open_ = alive[order]
    group = np.where(open_, group, np.arange(n))
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = np.diff(np.append(first, n))
    rows = np.flatnonzero(open_ & (np.repeat(size, size) > 1))
    step = width
    while len(rows):
        suffix = order[rows]
        key = rank[suffix] * (n + 1) + rank[suffix + step]
        turn = np.argsort(key, kind="stable")
        key, suffix = key[turn], suffix[turn]
        order[rows] = suffix
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(rows)))
        rank[suffix] = np.repeat(rows[first], size)
        rows = rows[np.repeat(size, size) > 1]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit row per binary digit, most significant first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, n = bits, len(symbols)
        self.ones, self.zeros = [], []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            high = bit.astype(bool)
            symbols = np.concatenate((symbols[~high], symbols[high]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(end)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            high = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[start], ones[end]
            start = np.where(high, zeros + a, start - a)
            end = np.where(high, zeros + b, end - b)
        return end - start


class FMIndex:
    """Backward search by wavelet ranks; places from samples of the suffix order.

    Every ``sample``-th place and every first place after a separator is
    sampled, so a walk to the left ends before it meets a separator.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        bits = max(1, int(n_symbols - 1).bit_length())
        order = suffix_order(symbols, bits)
        self.last = symbols[order - 1]  # place 0 follows the final separator
        self.tree = WaveletMatrix(self.last, bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols))))
        self.marked = (self.last == 0) | (order % sample == 0)
        self.samples = order[self.marked]
        self.marks = np.cumsum(self.marked, dtype=np.int32) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, the rows of a matrix that is aligned to the left."""
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.last), np.int64)
        for t in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > t) & (high > low))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - t]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes given by their rows."""
        places, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            at = rows[todo]
            hit = self.marked[at]
            places[todo[hit]] = self.samples[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.last[at]
            rows[todo] = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return places
