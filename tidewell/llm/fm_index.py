"""An FM-index over sequences of numbers: suffix sorting, wavelet ranks, backward search, sampled places.

A sequence holds symbols from 1 on and separators (0). Separators differ from one another and are smaller than all symbols, so two
suffixes are told apart at the first separator at the latest, and no pattern reaches over one. Everything works on whole numpy
arrays: all patterns are searched, and all occurrences located, together.
"""

from __future__ import annotations

import numpy as np

#: Every so many places of the sequence the suffix position is kept; first symbols after separators are always kept.
SAMPLED = 16


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The places of the sequence by the order of the suffixes that start there (prefix doubling; only ties are sorted again)."""
    n = len(sequence)
    rank = sequence.astype(np.int64)
    apart = np.flatnonzero(sequence == 0)
    rank[sequence != 0] += len(apart)
    rank[apart] = np.arange(len(apart))
    order = np.argsort(rank, kind="stable")
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    number = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # rows with the same symbols so far have the same number
    rank[order] = number
    width = 1
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        after = at + width
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((key, rank[at]))
        at, key, group = at[again], key[again], rank[at][again]
        order[rows] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        first[rows] = new
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        width *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks and symbols of a sequence, one bit vector for each bit of a symbol, highest first."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = sequence
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = ((now >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(now) - ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, stop = np.zeros(len(at), np.int64), at
        for bit, bits, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(stop)
            start, stop = np.where(one, zeros + a, start - a), np.where(one, zeros + b, stop - b)
        return stop - start

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for _, bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            out = out * 2 + one
        return out


class FMIndex:
    def __init__(self, sequence: np.ndarray, largest: int):
        """Of a sequence that starts with a separator; ``largest`` is the largest symbol that patterns hold."""
        n = len(sequence)
        order = suffix_order(sequence)
        self.wavelet = Wavelet(sequence[order - 1], largest)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=largest + 1))])
        kept = (np.arange(n) % SAMPLED == 0) | (sequence == 0)
        kept[1:] |= sequence[:-1] == 0
        kept = kept[order]
        self.kept, self.places = Bits(kept), order[kept]
        self.n = n

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first suffix row that starts with each pattern, and the row after the last; patterns are rows filled up with 0."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for step in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > step) & (low < high))
            symbols = patterns[on, sizes[on] - 1 - step]
            start = self.before[symbols]
            both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = start + both[: len(on)], start + both[len(on) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each suffix row: back to the next kept place, all rows together."""
        out, open_, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(open_):
            done = self.kept.get(rows)
            out[open_[done]] = self.places[self.kept.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbols = self.wavelet.get(rows)
            rows = self.before[symbols] + self.wavelet.rank(symbols, rows)
            steps += 1
        return out
