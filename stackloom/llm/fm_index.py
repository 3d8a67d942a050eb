"""A compressed FM-index over word sequences: bounded-context BWT, entropy-shaped wavelet tree
for backward search, and a wavelet matrix over owners for the smallest owner of an interval.

All searches are vectorised: thousands of patterns take a backward step together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits for each symbol, about log2 of its rarity: within one bit of the entropy on average."""
    return np.maximum(1, np.ceil(np.log2(counts.sum() / counts)).astype(np.int64))


class WaveletTree:
    """Ranks of symbols in a sequence; frequent symbols have short codes and few levels.

    Codes are canonical (shorter codes come first), so the symbols that still have bits at a
    level are those from `first[level]` on, in the order of their codes.
    """

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        counts = np.bincount(sequence, minlength=n_symbols)
        lengths = code_lengths(np.maximum(counts, 1))
        order = np.argsort(lengths, kind="stable")
        self.place = np.empty(n_symbols, np.int64)  # of a symbol in the order of codes
        self.place[order] = np.arange(n_symbols)
        self.lengths, counts = lengths[order], counts[order]
        depth = int(self.lengths[-1])
        widths = np.int64(1) << (depth - self.lengths)
        self.codes = np.cumsum(widths) - widths  # left-aligned
        self.depth, self.levels, self.start, self.start_ones, self.first = depth, [], [], [], []
        now = self.place[sequence]
        for level in range(depth):
            first = int(np.searchsorted(self.lengths, level, "right"))
            now = now[now >= first]  # codes that have ended leave
            who = now - first
            prefix = self.codes[first:] >> (depth - level)
            begins = np.cumsum(counts[first:]) - counts[first:]
            heads = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            sizes = np.diff(np.append(heads, len(prefix)))
            start, ends = np.repeat(begins[heads], sizes), np.repeat(np.append(begins[heads[1:]], len(now)), sizes)
            bit = (self.codes >> (depth - 1 - level) & 1).astype(bool)[now]
            bits = Bits(bit)
            start_ones = bits.ones(start)
            self.first.append(first)
            self.levels.append(bits)
            self.start.append(start)
            self.start_ones.append(start_ones)
            # Zeros go before ones within each node, in order.
            zeros_in_node = ends - start - bits.ones(ends) + start_ones
            ones = np.cumsum(bit) - bit
            to = np.where(bit, (start + zeros_in_node - start_ones)[who] + ones, np.arange(len(now)) - ones + start_ones[who])
            after = np.empty_like(now)
            after[to] = now
            now = after

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        place, at, open_ = self.place[symbol], at.copy(), np.arange(len(at))
        for level in range(self.depth):
            open_ = open_[self.lengths[place[open_]] > level]
            if not len(open_):
                break
            who = place[open_]
            below = who - self.first[level]
            ones = self.levels[level].ones(self.start[level][below] + at[open_]) - self.start_ones[level][below]
            bit = (self.codes[who] >> (self.depth - 1 - level)) & 1
            at[open_] = np.where(bit == 1, ones, at[open_] - ones)
        return at


class WaveletMatrix:
    """Smallest value of intervals of a sequence of small numbers."""

    def __init__(self, values: np.ndarray):
        self.levels, self.zeros = [], []
        for shift in reversed(range(max(1, int(values.max(initial=0)).bit_length()))):
            bit = (values >> shift & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value in each non-empty interval low:high."""
        out = np.zeros(len(low), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = bits.ones(low), bits.ones(high)
            ones = (high - low) == (b - a)  # no zero is there
            out = 2 * out + ones
            low, high = np.where(ones, zeros + a, low - a), np.where(ones, zeros + b, high - b)
        return out


class FMIndex:
    """Sequences of words, each with an owner, searched backward for patterns of up to `context` words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, context: int):
        known, symbols = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # 0 ends a sequence
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = symbols + 1
        self.text, self.starts, self.context = text, ends - lengths - 1, context
        # Suffixes in the order of their first `context` words, by doubling.
        rank, span = text, 1
        order = np.argsort(rank, kind="stable")
        while span < context:
            ahead = np.zeros(len(text), np.int64)
            ahead[:-span] = rank[span:] + 1 if len(text) > span else 0
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(len(text), np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else key
            span *= 2
        counts = np.bincount(text, minlength=len(known) + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletTree(text[order - 1], len(known) + 1)
        self.owners, number = np.unique(owners, return_inverse=True)
        self.documents = WaveletMatrix(np.repeat(number, lengths + 1)[order])

    def backward(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched words, low, high) of the patterns text[at : at + words], searched from their last
        word; a search ends early when only one occurrence, the pattern's own, is left."""
        matched = np.ones(len(at), np.int64)
        last = self.text[at + words - 1]
        low, high = self.below[last], self.below[last + 1]
        open_ = np.arange(len(at))
        for step in range(words - 2, -1, -1):
            open_ = open_[high[open_] - low[open_] > 1]
            if not len(open_):
                break
            symbol = self.text[at[open_] + step]
            both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low[open_], high[open_])))
            low[open_], high[open_] = self.below[symbol] + both[: len(open_)], self.below[symbol] + both[len(open_) :]
            matched[open_] += 1
        return matched, low, high

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.owners[self.documents.smallest(low, high)]
