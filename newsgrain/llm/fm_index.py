"""A full-text index of word sequences: Burrows-Wheeler transform, wavelet-matrix ranks, sampled suffix positions.

All steps work on arrays of queries at once. Symbols are small integers; 0 separates runs and never matches.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling; separators (0) count as distinct, earlier ones as smaller."""
    n = len(text)
    seps = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    order = np.argsort(rank, kind="stable")
    step = 1
    rank = _ranks(rank[order], order)
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, dtype=bool)
        tied[1:] = sorted_rank[1:] == sorted_rank[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)  # only suffixes that still tie are sorted again
        if not len(at):
            break
        second = np.full(n, -1, dtype=np.int64)
        second[: max(n - step, 0)] = rank[step:]
        sub = order[at]
        # a rank is the number of smaller suffixes, so the sort key keeps groups in place
        key = sorted_rank[at] * (n + 1) + second[sub] + 1
        by = np.argsort(key, kind="stable")
        order[at] = sub[by]
        key = key[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2
    return order


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    return out


class WaveletMatrix:
    """Bit planes of a symbol sequence, most significant first, each with 64-bit words and the counts before them."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.before, self.zeros = [], [], []
        s = symbols.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (s >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.words.append(words)
            self.before.append(counts)
            self.zeros.append(self.n - int(counts[-1]))
            s = np.concatenate((s[one == 0], s[one == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Number of ones in the plane before each position."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << off) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            one = (self.words[k][word] >> off) & np.uint64(1) == 1
            ones = self._ones(k, at)
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """text: symbols below sigma, runs separated and ended by 0."""
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]  # before the first position stands the last one, a separator
        self.tree = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        begins = np.ones(self.n, dtype=bool)
        begins[1:] = text[:-1] == 0
        keep = begins | (np.arange(self.n) % SAMPLE == 0)
        marked = keep[order]
        self.marked = WaveletMatrix(marked.astype(np.uint32), 1)
        self.sampled = order[marked]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns (m x length): the range of suffixes that begin with each."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        alive = np.arange(m)
        for k in range(length - 1, -1, -1):
            s = patterns[alive, k].astype(np.int64)
            lo[alive] = self.first[s] + self.tree.rank(s, lo[alive])
            hi[alive] = self.first[s] + self.tree.rank(s, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marked.access(at) == 1
            out[todo[hit]] = self.sampled[self.marked._ones(0, at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            s = self.tree.access(at)
            at = self.first[s] + self.tree.rank(s, at)
            steps += 1
        return out
