"""A full-text index in little space: Burrows-Wheeler text, wavelet matrix, sampled positions.

All operations take many patterns or many positions at once, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length until every rank is unique."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    ordered = text[order]
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    step = 1
    while rank[order[-1]] < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol before any position, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.zeros_before, self.n_zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            one = ((symbols >> level) & 1).astype(bool)
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros_before.append(zeros)
            self.n_zeros.append(int(zeros[-1]))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before `position`."""
        begin, at = np.zeros(len(position), np.int64), position.astype(np.int64)
        for i, (zeros, n_zeros) in enumerate(zip(self.zeros_before, self.n_zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            zb, za = zeros[begin], zeros[at]
            begin = np.where(one, n_zeros + begin - zb, zb)
            at = np.where(one, n_zeros + at - za, za)
        return at - begin

    def access(self, position: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        at, out = position.astype(np.int64), np.zeros(len(position), np.int64)
        for zeros, n_zeros in zip(self.zeros_before, self.n_zeros, strict=True):
            zb = zeros[at]
            one = zeros[at + 1] == zb
            out = out * 2 + one
            at = np.where(one, n_zeros + at - zb, zb)
        return out


class FMIndex:
    """Index of a sequence of symbols 1..largest; 0 separates its runs."""

    def __init__(self, text: np.ndarray, largest: int, sample: int = 8):
        text = np.concatenate([text + 1, [0]])  # a smallest end mark, once
        order = suffix_array(text)
        previous = text[order - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 3))])
        self.tree = WaveletMatrix(previous, largest + 1)
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the sorted suffixes that begin with each pattern, read backwards.

        `patterns` is padded on the left: pattern i is the last `lengths[i]` entries of its row.
        """
        n, width = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, width - back] + 1
            base = self.before[symbol]
            lo[live] = base + self.tree.rank(symbol, lo[live])
            hi[live] = base + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step to the previous symbol until a sampled one."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = at[left]
            found = self.marks[here + 1] > self.marks[here]
            done = left[found]
            out[done] = self.sampled[self.marks[at[done]]] + steps[done]
            left = left[~found]
            symbol = self.tree.access(at[left])
            at[left] = self.before[symbol] + self.tree.rank(symbol, at[left])
            steps[left] += 1
        return out
