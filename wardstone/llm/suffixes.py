"""Suffix ordering by a difference cover, and a compressed FM-index; both over one shard's arrays."""

from __future__ import annotations

import numpy as np


def _named(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row, in the rows' lexicographic order."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        base = int(column.max()) + 1 if len(column) else 1
        if len(key) and (int(key.max()) + 1) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + column
    return key


def _fewer(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many of a, and of b, are less than each of a; and than each of b. One sort of both together."""
    order = np.argsort(np.concatenate([a, b]))
    of_b = order >= len(a)
    new = np.ones(len(order), bool)
    both = np.concatenate([a, b])[order]
    new[1:] = both[1:] != both[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    before = (np.cumsum(of_b) - of_b)[first]
    less_b = np.zeros(len(order), np.int64)
    less_b[order] = before
    less_a = np.zeros(len(order), np.int64)
    less_a[order] = first - before
    return less_a[: len(a)], less_b[: len(a)], less_a[len(a) :], less_b[len(a) :]


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Integers that order all suffixes of s (values of 1 and more) by their first `depth` symbols at least.

    Difference cover modulo 3: triples at places 1 and 2 modulo 3 are sorted and named, the
    sequence of names is ordered by recursion to a third of the depth, and the places 0 modulo 3
    are ordered by (symbol, rank of the next place) and merged. Suffixes that agree further than
    the depth may share a rank.
    """
    n = len(s)
    if n < 6 or depth <= 1:
        padded = np.concatenate([s.astype(np.int64), np.zeros(n, np.int64)])
        names = _named(*[padded[i : i + n] for i in range(n if n < 6 else 1)])
        return np.unique(names, return_inverse=True)[1] + 1
    padded = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    triples = np.unique(_named(padded[sample], padded[sample + 1], padded[sample + 2]), return_inverse=True)[1] + 1
    if depth > 3 and triples.max() < len(sample):
        gap = np.zeros(1, np.int64)
        deeper = suffix_ranks(np.concatenate([triples[: len(one)] + 1, gap + 1, triples[len(one) :] + 1]), -(-depth // 3))
        triples = np.concatenate([deeper[: len(one)], deeper[len(one) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = triples

    by_two = _named(np.concatenate([padded[zero], padded[one]]), np.concatenate([rank[zero + 1], rank[one + 1]]))
    by_three = _named(
        np.concatenate([padded[zero], padded[two]]),
        np.concatenate([padded[zero + 1], padded[two + 1]]),
        np.concatenate([rank[zero + 2], rank[two + 2]]),
    )
    zeros, ones, before_one, _ = _fewer(by_two[: len(zero)], by_two[len(zero) :])
    _, twos, before_two, _ = _fewer(by_three[: len(zero)], by_three[len(zero) :])
    below = np.bincount(triples)
    below = np.cumsum(below) - below
    out = np.zeros(n, np.int64)
    out[zero] = zeros + ones + twos
    out[one] = below[rank[one]] + before_one
    out[two] = below[rank[two]] + before_two
    return out + 1


class BitRanks:
    """A bit vector in 64-bit words, with a running count for every fourth word and one byte for each: a quarter more than its bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 256) * 256, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).reshape(-1, 4).astype(np.int64)
        fours = counts.sum(axis=1)
        self.ones = int(fours.sum())
        self.before = (np.cumsum(fours) - fours).astype(np.uint32)
        self.inside = (np.cumsum(counts, axis=1) - counts).astype(np.uint8).reshape(-1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word >> 2].astype(np.int64) + self.inside[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """FM-index over integers: the Burrows-Wheeler transform in a wavelet matrix, a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """Patterns of up to `depth` symbols can be searched. Symbols are 0 (between texts) and more."""
        order = np.argsort(suffix_ranks(symbols + 1, depth + 1), kind="stable")
        transform = symbols[order - 1]
        self.size = len(symbols)
        self.bits = max(1, int(symbols.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bits = ((transform >> level) & 1).astype(bool)
            self.levels.append(BitRanks(bits))
            self.zeros.append(len(bits) - self.levels[-1].ones)
            transform = np.concatenate([transform[~bits], transform[bits]])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The backward step: intervals of symbol + pattern from those of patterns, for many at once."""
        start, lo_at, hi_at = np.zeros(len(symbol), np.int64), lo, hi
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ranks, zeros = self.levels[k], self.zeros[k]
            start_1, lo_1, hi_1 = ranks.rank(start), ranks.rank(lo_at), ranks.rank(hi_at)
            start = np.where(one, zeros + start_1, start - start_1)
            lo_at = np.where(one, zeros + lo_1, lo_at - lo_1)
            hi_at = np.where(one, zeros + hi_1, hi_at - hi_1)
        return self.first[symbol] + lo_at - start, self.first[symbol] + hi_at - start

    def statistics(self, ends: np.ndarray, text: np.ndarray, limit: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end in text, the longest string ending there, up to limit, with `least` occurrences in the index."""
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        for step in range(limit):
            lo, hi = self.extend(text[ends[active] - 1 - step], lo, hi)
            on = hi - lo >= least
            active, lo, hi = active[on], lo[on], hi[on]
            if not len(active):
                break
            length[active] = step + 1
        return length
