"""A compressed FM-index of word sequences: suffix order, Burrows-Wheeler transform, wavelet matrix.

Everything is a numpy array and every query runs for many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (non-negative ids) in which each separator is a symbol of its own, ordered by place."""
    n = len(text)
    n_separators = int(separator.sum())
    rank = text.astype(np.int64) + n_separators
    rank[separator] = np.arange(n_separators)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (max(int(rank.max(initial=0)), n) + 2) + ahead
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        if not n or new[-1] == n - 1:
            return order
        rank[order] = new
        width *= 2


class WaveletMatrix:
    """Rank of any symbol at any place, in one bit vector with counts for each bit of the symbols."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        values = values.astype(np.int64)
        for level in reversed(range(self.bits)):
            ones = (values >> level & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, np.uint8)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed), np.uint32)
            np.cumsum(np.bitwise_count(packed)[:-1], out=counts[1:])
            zeros = len(ones) - int(ones.sum())
            self.levels.append((level, packed, counts, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, packed, counts, zeros in self.levels:
            at = place >> 6
            ones = counts[at].astype(np.int64) + np.bitwise_count(packed[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Index of sequences of positive word numbers, each of which stands for one text or for several.

    It keeps the wavelet matrix of the transform, one start a word number, and
    one bit a place that says whether its sequence stands for several; neither
    the sequences nor their suffix order.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, several: np.ndarray):
        n, m = len(words), len(lengths)
        separator = np.zeros(n + m, bool)
        separator[np.cumsum(lengths + 1) - 1] = True
        text = np.zeros(n + m, np.int64)
        text[~separator] = words
        order = suffix_order(text, separator)
        transform = text[order - 1]  # the place before the first holds a separator: the last
        n_symbols = int(text.max(initial=0)) + 1
        starts = np.cumsum(np.bincount(text, minlength=n_symbols)) - np.bincount(text, minlength=n_symbols)
        self.size = n + m
        self.tree = WaveletMatrix(transform, n_symbols)
        self.base = starts - self.tree.descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        self.several = np.packbits(np.repeat(several, lengths + 1)[order], bitorder="little")

    def extend_left(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.base[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def repeats(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which intervals of suffixes stand for two texts or more."""
        bit = (self.several[np.minimum(lo, self.size - 1) >> 3] >> (lo & 7)) & 1
        return (hi - lo > 1) | ((hi - lo == 1) & (bit == 1))

    def backward(self, words: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Matching statistics of streamed texts: for each pattern words[first + left : first + right],
        searched from its right end leftwards, the first place (relative to ``first``) whose suffix
        doesn't occur twice, or left - 1 if all do."""
        out = left - 1
        active = np.flatnonzero(right > left)
        at = right[active] - 1
        lo, hi = np.zeros(len(active), np.int64), np.full(len(active), self.size)
        while len(active):
            lo, hi = self.extend_left(words[first[active] + at], lo, hi)
            more = self.repeats(lo, hi)
            out[active[~more]] = at[~more]
            go = more & (at > left[active])
            active, at, lo, hi = active[go], at[go] - 1, lo[go], hi[go]
        return out


def repeated_windows(index: FMIndex, words: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi): windows lo..hi-1 of each streamed text (``words``, of the given lengths) occur more than once in the index.

    For the windows that end at ``end`` or before, a probe of their common core
    settles most that don't repeat; else the search from ``end`` gives the
    matching statistics as far as the next place that fails.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own, first = np.arange(len(lengths)), np.cumsum(lengths) - lengths
    end = lengths.astype(np.int64).copy()
    half = window // 2
    live = own[end >= window]
    while len(live):
        stop = end[live]
        skip = np.minimum(half, stop - window)
        failed = index.backward(words, first[live], stop - window, stop - skip)
        core_repeats = failed < stop - window
        end[live[~core_repeats]] -= skip[~core_repeats] + 1
        check = live[core_repeats]
        stop = end[check]
        failed = index.backward(words, first[check], np.zeros(len(check), np.int64), stop)
        hit = stop - (failed + 1) >= window
        found.append((check[hit], failed[hit] + 1, stop[hit] - window + 1))
        end[check] = np.minimum(stop - 1, failed + window)
        live = live[end[live] >= window]
    if not found:
        return own[:0], own[:0], own[:0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
