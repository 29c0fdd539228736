"""Suffix arrays, common prefixes and FM-indexes over integer sequences, in numpy, for shards of bounded size."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Suffix array by prefix doubling over unresolved groups only.

    ``symbols`` must end in a symbol that occurs once, and every separator must be a symbol of its own, so that no common
    prefix reaches over one. The ranks of each doubling step are kept: they give common prefixes without a second pass.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols = np.ascontiguousarray(symbols, np.int64)
        n = len(symbols)
        width = int(symbols.max() + 1).bit_length() if n else 1
        self.first = first = max(1, 62 // width)
        padded = np.concatenate([symbols + 1, np.zeros(first, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(first):
            key = key << width | padded[j:j + n]
        self.order = order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
        slots = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
        self.levels = [(first, rank)]
        open_slots, length = self._open(fresh), first
        while len(open_slots):
            at = order[open_slots]
            key = rank[at] * (n + 1) + rank[at + length]
            turn = np.argsort(key)
            at, key = at[turn], key[turn]
            order[open_slots] = at
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(fresh, open_slots, 0))
            length *= 2
            self.levels.append((length, rank))
            open_slots = open_slots[self._open(fresh)]

    @staticmethod
    def _open(fresh: np.ndarray) -> np.ndarray:
        """Places in groups of two and more; ``fresh`` marks each group's first."""
        last = np.concatenate([fresh[1:], [True]]) if len(fresh) else fresh
        return np.flatnonzero(~(fresh & last))

    def common(self) -> np.ndarray:
        """Common prefix of each suffix in order with the one before it; 0 for the first."""
        n = len(self.symbols)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        at = np.flatnonzero(self.symbols[self.order[1:]] == self.symbols[self.order[:-1]]) + 1
        a, b, got = self.order[at - 1].copy(), self.order[at].copy(), np.zeros(len(at), np.int64)
        for length, rank in reversed(self.levels):
            same = rank[a] == rank[b]
            step = same * length
            a, b, got = a + step, b + step, got + step
        for _ in range(self.first):
            same = self.symbols[a] == self.symbols[b]
            a, b, got = a + same, b + same, got + same
        out[at] = got
        return out

    def longest(self) -> np.ndarray:
        """For each position, the length of the longest substring that starts there and occurs elsewhere too: the
        deeper of the two prefix intervals beside its suffix."""
        common = self.common()
        out = np.zeros(len(common), np.int64)
        out[self.order] = np.maximum(common, np.concatenate([common[1:], [0]])) if len(common) else common
        return out


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit vector per bit of the alphabet, with a count per 64-bit block."""

    def __init__(self, values: np.ndarray, width: int):
        self.levels, values = [], values.copy()
        for bit in reversed(range(width)):
            ones = values >> bit & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            blocks = np.zeros(len(values) // 64 + 1, np.uint64)
            blocks.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])
            self.levels.append((bit, blocks, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(blocks[block] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low, high = np.zeros(len(at), np.int64), at
        for bit, blocks, before, zeros in self.levels:
            one = symbol >> bit & 1 == 1
            left, right = self._ones(blocks, before, low), self._ones(blocks, before, high)
            low, high = np.where(one, zeros + left, low - left), np.where(one, zeros + right, high - right)
        return high - low


class FMIndex:
    """Counts and places of phrases by backward search.

    ``words`` holds symbols from 1 on; 0 separates segments. Suffix positions are sampled every ``rate`` places and at
    segment starts, so that no walk steps over a separator.
    """

    def __init__(self, words: np.ndarray, rate: int = 16):
        words = np.concatenate([np.asarray(words, np.int64), [0]])
        gaps = words == 0
        count = int(gaps.sum())
        self.n = len(words)
        order = SuffixArray(np.where(gaps, np.cumsum(gaps) - 1, words + count - 1)).order
        self.last = words[order - 1]
        self.top = int(words.max())
        self.tree = WaveletMatrix(self.last, max(1, self.top.bit_length()))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=self.top + 1))])
        self.sampled = (order % rate == 0) | np.concatenate([[True], gaps[:-1]])[order] | (words[order] == 0)
        self.samples = np.where(self.sampled, order, -1)[self.sampled]
        self.sample_of = np.cumsum(self.sampled) - 1

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the rows of equally long phrases that occur at all."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[which, j]
            known = (symbol > 0) & (symbol <= self.top)
            which, low, high, symbol = which[known], low[known], high[known], symbol[known]
            low = self.starts[symbol] + self.tree.rank(symbol, low)
            high = self.starts[symbol] + self.tree.rank(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in ``rows``: walk back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_of[rows[done]]] + steps
            rows, left = rows[~done], left[~done]
            symbol = self.last[rows]
            rows, steps = self.starts[symbol] + self.tree.rank(symbol, rows), steps + 1
        return out
