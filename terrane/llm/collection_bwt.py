"""Burrows-Wheeler transform and common prefixes of a collection of strings,
built column-wise: round j inserts one symbol of every string.

The state is a few flat arrays in suffix order.  A round reads the transform
front to back, and the places of the new suffixes follow from it: the suffixes
that begin with a symbol c stand in the order of the suffixes that c precedes
(the LF property), after the strings' ends.  The new suffixes' remainders are
those that came in the round before.  Where a new suffix meets a neighbour with
the same first symbol, their common prefix is one more than the least common
prefix between their remainders; other values are copied on.
"""

from __future__ import annotations

import numpy as np

from terrane.llm import kernels as K


class Collection:
    """Symbols of all strings with a 0 before each and one at the end."""

    def __init__(self, symbols: np.ndarray, offs: np.ndarray):
        self.strings = len(offs) - 1
        self.offs = offs
        self.text = np.zeros(len(symbols) + self.strings + 1, symbols.dtype)
        length = np.diff(offs)
        self.begin = offs[:-1] + np.arange(self.strings) + 1
        self.end = self.begin + length
        self.text[K.ranges(self.begin, length)] = symbols
        self.rounds = int(length.max(initial=0))

    def suffix_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start in ``text``, transform and common prefix with the suffix before,
        for every suffix in order; the strings' ends come first."""
        m = self.strings
        pos, lcp = self.end.astype(np.int32), np.zeros(m, np.int32)
        bwt = self.text[pos - 1]
        fresh = np.ones(m, bool)
        for _ in range(self.rounds):
            # Remainders by the symbol that precedes them, then by place; whole strings (0) lead and are left out.
            order = _by_symbol(bwt)
            whole = len(bwt) - np.count_nonzero(bwt)
            at = np.flatnonzero(fresh[order[whole:]]) + whole
            if not len(at):
                break
            place = order[at]
            target = m + at - whole
            fresh = np.zeros(len(bwt) + len(at), bool)
            fresh[target] = True
            # Common prefix with the neighbour before, and of the neighbour after with the new suffix.
            symbol = bwt[place]
            before = order[np.maximum(at - 1, 0)]
            after = order[np.minimum(at + 1, len(order) - 1)]
            has_before, has_after = (at > 0) & (bwt[before] == symbol), (at + 1 < len(order)) & (bwt[after] == symbol)
            ahead = _least(lcp, before, place, has_before)
            behind = _least(lcp, place, after, has_after)
            follower = target + 1
            old = ~fresh
            grown = np.empty(len(fresh), np.int32)
            grown[old] = lcp
            grown[target] = ahead
            inside = follower < len(fresh)
            grown[follower[inside]] = behind[inside]
            # A new suffix that follows a new suffix has both values: they agree.
            lcp = grown
            first = pos[place] - 1
            grown = np.empty(len(fresh), np.int32)
            grown[old] = pos
            grown[target] = first
            pos = grown
            grown = np.empty(len(fresh), bwt.dtype)
            grown[old] = bwt
            grown[target] = self.text[first - 1]
            bwt = grown
        return pos, bwt, lcp


def _by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Places in order of symbol, then place.  Sorting both packed in one number
    is several times faster here than a stable argsort."""
    n = len(bwt)
    kind, bits = (np.uint32, 20) if n < 1 << 20 and bwt.dtype == np.uint8 else (np.uint64, 40)
    packed = (bwt.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)
    packed.sort()
    return (packed & kind((1 << bits) - 1)).astype(np.int64)


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray, where: np.ndarray) -> np.ndarray:
    """1 + min(lcp[low+1 .. high]) where asked, else 0."""
    out = np.zeros(len(low), np.int32)
    if where.any():
        begin, length = low[where] + 1, high[where] - low[where]
        out[where] = 1 + np.minimum.reduceat(lcp[K.ranges(begin, length)], np.cumsum(length) - length)
    return out
