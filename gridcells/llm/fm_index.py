"""FM-index of a bounded sequence of integer symbols, with numpy: every call works on arrays of
queries.  The Burrows-Wheeler transform is held in a wavelet tree (one bit vector a level)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """Bit vector with counts of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(U64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1)


class Wavelet:
    """Symbols split by one bit a level, the highest first; zeros go to the left."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        start = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            s, a = bits.ones(start), bits.ones(at)
            start = np.where(one, zeros + s, start - s)
            at = np.where(one, zeros + a, at - a)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(bool)
            out |= one.astype(at.dtype) << shift
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only smallest one."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Symbols are 1..sigma-1; an end mark 0 is added.  Every ``sample``-th position is kept."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.wavelet = Wavelet(text[order - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        sampled = order % sample == 0
        self.sampled, self.positions, self.n = Bits(sampled), order[sampled], len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns, given as rows aligned to the right; the search goes
        from the last symbol to the first and drops patterns that have no rows left."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        live = np.arange(len(patterns))
        for k in range(width):
            live = live[(lengths[live] <= k) | (hi[live] > lo[live])]
            now = live[lengths[live] > k]
            now = now[hi[now] > lo[now]]
            if not len(now):
                continue
            symbol = patterns[now, width - 1 - k]
            lo[now] = self.smaller[symbol] + self.wavelet.rank(symbol, lo[now])
            hi[now] = self.smaller[symbol] + self.wavelet.rank(symbol, hi[now])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled position."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled.get(rows[live]).astype(bool)
            done = live[known]
            out[done] = self.positions[self.sampled.ones(rows[done])] + steps[done]
            live = live[~known]
            symbol = self.wavelet.access(rows[live])
            rows[live] = self.smaller[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return out
