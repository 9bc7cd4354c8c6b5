"""A compressed full-text index over integer symbols, searched backwards.

``WaveletMatrix`` keeps a sequence as one packed bit vector a level, with a
running count a 64-bit word; ``rank`` is a table look-up and a population count
a level, for whole arrays of queries.  ``FMIndex`` is the wavelet matrix over a
collection's Burrows-Wheeler transform.  ``matching_statistics`` extends all
queries to the left together, one symbol a step, and drops those whose interval
becomes empty.
"""

from __future__ import annotations

import numpy as np

from terrane.llm.collection_bwt import Collection


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1
            self.levels.append((shift, BitVector(bits.astype(np.uint8))))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank_pair(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place where the symbol's run starts on the last level, and the
        places that ``low`` and ``high`` are mapped to."""
        base = np.zeros_like(low)
        both = np.concatenate([base, low, high])
        n = len(low)
        for shift, bits in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            ones = bits.rank1(both)
            both = np.where(np.tile(one, 3), bits.zeros + ones, both - ones)
        return both[:n], both[n : 2 * n], both[2 * n :]


class FMIndex:
    """Index of a collection of strings of symbols 1..top."""

    def __init__(self, symbols: np.ndarray, offs: np.ndarray):
        self.collection = Collection(symbols, offs)
        self.pos, bwt, _ = self.collection.suffix_order()
        top = int(symbols.max(initial=1))
        self.tree = WaveletMatrix(bwt.astype(np.int64), top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=top + 1))])
        # Suffixes that start with symbol c are as many as places that c precedes; the strings' ends come first.
        self.first = self.first - self.first[1] + self.collection.strings
        self.size = len(bwt)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (exclusive), the length of the longest match that ends
        there, up to ``limit``, and its interval of suffixes."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        matched = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(1, limit + 1):
            live = live[ends[live] - step >= 0]
            c = text[ends[live] - step].astype(np.int64)
            known = (c > 0) & (c < len(self.first) - 1)
            live, c = live[known], c[known]
            if not len(live):
                break
            base, lo, hi = self.tree.rank_pair(c, low[live], high[live])
            lo, hi = self.first[c] + lo - base, self.first[c] + hi - base
            found = hi > lo
            live = live[found]
            low[live], high[live], matched[live] = lo[found], hi[found], step
        return matched, low, high
