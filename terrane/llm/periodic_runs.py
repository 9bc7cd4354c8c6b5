"""Runs of repeated words (period q, at least four times over), by Re-Pair.

Every document is worked on alone, in numpy over Arrow batches:

1. Inside a run every pair of neighbouring words occurs at least three times.
   Texts are cut at pairs that occur less often, again and again until nothing
   changes; no run crosses a cut, and what is left is the grammar's input.
2. Re-Pair: in rounds, every pair of symbols that is more frequent than the
   pairs beside it becomes a nonterminal, until no pair occurs twice; the
   symbols left over are paired level by level, so that each stretch has one
   root.
3. For every nonterminal X -> A B, once: for each period p, how far the words
   around the border of A and B go on with that period inside X (longest common
   extensions, by hashes of 2**k words).
4. These intervals are translated to every position at which X is derived, and
   intervals of one period that share a period or more are merged.  A run is
   found whole at the lowest nonterminal that spans it, so what is left after
   merging is maximal; equal stretches keep their smallest period.

Memory: a few arrays over the words of one slice (``K.SLICE_BYTES``, or one
longer document), and ``CHUNK`` pairs of nonterminal and period at a time.

Defined results: null, empty and blank texts have no words and no runs; a null
id repeats nothing and is else treated as any document; rows that repeat an id
are rows of their own; of runs that are equally long the first is named, then
the one with the smaller period; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm import kernels as K
from terrane.llm.substring_dedup import joined
from terrane.workspace import bounded_batches

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: A pair of neighbouring words in a run occurs so often at least.
PAIR_TIMES = 3
#: (nonterminal, period) pairs that are looked at together.
CHUNK = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def planted(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """The word that stands at each place once every tenth document (by crc32 of
    its id) repeats itself from some word on."""
    src = np.arange(first[-1])
    for k, i in enumerate(ids):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n = int(first[k + 1] - first[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            src[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return src


def frequent_stretches(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, stretch) of the words that may be in a run; groups are contiguous."""
    at, group = np.arange(len(codes)), group.astype(np.int64)
    while len(at):
        code = codes[at]
        same = group[1:] == group[:-1]
        pair = K.mix(code[:-1] * _M1 + code[1:] * _M2 + group[:-1].astype(np.uint64))
        _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
        often = same & (times[back] >= PAIR_TIMES)
        # A stretch begins where no frequent pair leads in.
        lead = np.append(True, ~often)
        stretch = np.cumsum(lead) - 1
        keep = np.bincount(stretch)[stretch] >= MIN_WORDS
        done = keep.all() and (~often == ~same).all()
        at, group = at[keep], stretch[keep]
        if done:
            break
    return at, group


class Grammar:
    """Re-Pair over several stretches: rules, and the symbols that are left."""

    def __init__(self, ids: np.ndarray, stretch: np.ndarray, words: int):
        self.words = words
        self.left, self.right = [], []
        self.size = [np.ones(words, np.int64)]
        self.count = words
        s, g = ids.astype(np.int64), stretch
        while True:
            key = np.where(g[1:] == g[:-1], s[:-1] * self.count + s[1:], -1)
            pairs, back, times = np.unique(key, return_inverse=True, return_counts=True)
            times[pairs < 0] = 0
            if not (times > 1).any():
                break
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((K.mix(pairs.astype(np.uint64)), times))] = np.arange(len(pairs))
            rank[times < 2] = -1
            r = np.concatenate([[-1], rank[back], [-1]])
            peak = (r[1:-1] >= 0) & (r[1:-1] >= r[:-2]) & (r[1:-1] >= r[2:])
            s, g = self._replace(s, g, self._alternate(peak))
        while (g[1:] == g[:-1]).any():
            s, g = self._replace(s, g, self._alternate(g[1:] == g[:-1]))
        self.roots = s
        self.lefts, self.rights = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right))
        self.sizes = np.concatenate(self.size)

    @staticmethod
    def _alternate(peak: np.ndarray) -> np.ndarray:
        """Every other place of each run of neighbouring places (they overlap)."""
        place = np.flatnonzero(peak)
        lead = np.append(True, place[1:] > place[:-1] + 1)
        begin = place[lead][np.cumsum(lead) - 1] if len(place) else place
        return place[(place - begin) % 2 == 0]

    def _replace(self, s: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs, back = np.unique(s[at] * self.count + s[at + 1], return_inverse=True)
        a, b = pairs // self.count, pairs % self.count
        sizes = np.concatenate(self.size) if len(self.size) > 1 else self.size[0]
        self.left.append(a), self.right.append(b)
        self.size = [sizes, sizes[a] + sizes[b]]
        s = s.copy()
        s[at] = self.count + back
        self.count += len(pairs)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        return s[keep], g[keep]

    def derivation(self) -> tuple[np.ndarray, np.ndarray]:
        """(nonterminal, first word) of every node above the words."""
        symbol = self.roots
        place = np.cumsum(self.sizes[symbol]) - self.sizes[symbol]
        out_s, out_p = [], []
        while len(symbol):
            inner = symbol >= self.words
            symbol, place = symbol[inner], place[inner]
            out_s.append(symbol), out_p.append(place)
            a, b = self.lefts[symbol - self.words], self.rights[symbol - self.words]
            symbol, place = np.concatenate([a, b]), np.concatenate([place, place + self.sizes[a]])
        return np.concatenate(out_s), np.concatenate(out_p)


class Extensions:
    """Longest common extensions by hashes of 2**k words, whatever k."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.tables = [K.mix(ids.astype(np.uint64) + _M1)]
        while 2 ** len(self.tables) <= longest:
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(K.mix(t[:-half] * _M2 + t[half:]))

    def right(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j > i on, which end at ``end``."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            t, step = self.tables[k], 1 << k
            fits = np.flatnonzero(j + got + step <= end)
            same = fits[t[i[fits] + got[fits]] == t[j[fits] + got[fits]]]
            got[same] += step
        return got

    def left(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, down to ``begin``."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            t, step = self.tables[k], 1 << k
            fits = np.flatnonzero(i - got - step >= begin)
            same = fits[t[i[fits] - got[fits] - step] == t[j[fits] - got[fits] - step]]
            got[same] += step
        return got


def _least_length(p: np.ndarray) -> np.ndarray:
    return np.maximum(MIN_WORDS, MIN_PERIODS * p)


def crossing(g: Grammar, ids: np.ndarray, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbol, start, end, period) of the intervals across each nonterminal's
    border, relative to the nonterminal; symbols are looked at once each."""
    symbol, at = np.unique(symbol, return_index=True)
    place = place[at]
    long_enough = g.sizes[symbol] >= MIN_WORDS
    symbol, place = symbol[long_enough], place[long_enough]
    size = g.sizes[symbol]
    border = place + g.sizes[g.lefts[symbol - g.words]]
    ext = Extensions(ids, int(size.max(initial=1)))
    found = [np.zeros((0, 4), np.int64)]
    periods = size // MIN_PERIODS
    done = np.concatenate([[0], np.cumsum(periods)])
    lo = 0
    while lo < len(symbol):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + CHUNK, "right")) - 1)
        k = np.repeat(np.arange(lo, hi), periods[lo:hi])
        p = K.ranges(np.ones(hi - lo, np.int64), periods[lo:hi])
        begin, end = place[k], place[k] + size[k]
        # A run across the border holds one of these two words and the one a period on.
        for anchor in (border[k] - 1, border[k] - p):
            ok = np.flatnonzero((anchor >= begin) & (anchor + p < end))
            ok = ok[ids[anchor[ok]] == ids[anchor[ok] + p[ok]]]
            i, q = anchor[ok], p[ok]
            s = i - ext.left(i, i + q, begin[ok])
            e = i + q + ext.right(i, i + q, end[ok])
            whole = e - s >= _least_length(q)
            found.append(np.stack([symbol[k[ok]], s - begin[ok], e - begin[ok], q], axis=1)[whole])
        lo = hi
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Multiples of a period give the same interval again.
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    return tuple(rows[new].T)


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals, each with its smallest period, by start and period."""
    order = np.lexsort((-end, start, period))
    s, e, p = start[order], end[order], period[order]
    if not len(s):
        return s, e, p
    # The furthest end so far within a period: periods lie far apart on one axis.
    width = int(e.max()) + 1
    reach = np.maximum.accumulate(e + p * width) - p * width
    lead = np.append(True, (p[1:] != p[:-1]) | (s[1:] + p[1:] > reach[:-1]))
    begin = np.flatnonzero(lead)
    s, e, p = s[begin], np.maximum.reduceat(e, begin), p[begin]
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1]))
    s, e, p = s[new], e[new], p[new]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs; rows are words first[k] to first[k + 1]."""
    none = np.zeros(0, np.int64)
    at, stretch = frequent_stretches(codes, np.repeat(np.arange(len(first) - 1), np.diff(first)))
    if not len(at):
        return none, none, none
    vocabulary, ids = np.unique(codes[at], return_inverse=True)
    g = Grammar(ids, stretch, len(vocabulary))
    symbol, place = g.derivation()
    x, s, e, p = crossing(g, ids, symbol, place)
    # Every place at which a nonterminal with intervals is derived.
    order = np.argsort(symbol, kind="stable")
    symbol, place = symbol[order], place[order]
    a, b = np.searchsorted(symbol, x, "left"), np.searchsorted(symbol, x, "right")
    of, where = np.repeat(np.arange(len(x)), b - a), place[K.ranges(a, b - a)]
    s, e, p = merged(s[of] + where, e[of] + where, p[of])
    # A stretch's words lie side by side in the text.
    return at[s], at[e - 1] + 1, p


def _kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:-1] == 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        whole, all_offs = K.text_bytes(batch.column(1))
        for lo, hi in K.slices(all_offs):
            buf, offs = whole[all_offs[lo] : all_offs[hi]], all_offs[lo : hi + 1] - all_offs[lo]
            words = K.find_words(buf, offs)
            src = planted(ids[lo:hi], words.first)
            start, end, period = runs(K.word_codes(buf, words)[src], words.first)
            words = K.Words(words.start[src], words.end[src], words.first)
            kept = _kept(len(src), start, end, period)
            row = np.searchsorted(words.first, start, "right") - 1
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            out = []
            for k in range(hi - lo):
                s = (start[cut[k] : cut[k + 1]] - words.first[k]).tolist()
                n = (end[cut[k] : cut[k + 1]] - start[cut[k] : cut[k + 1]]).tolist()
                q = period[cut[k] : cut[k + 1]].tolist()
                listing = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, q, strict=True))
                best = min(zip((-x for x in n), s, q, strict=True)) if s else None
                named = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
                out.append((ids[lo + k], int(words.first[k + 1] - words.first[k]), len(s), *named, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(joined(buf, words, kept, k)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_COLUMNS)


_COLUMNS = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2


def op11(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _COLUMNS)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_digest, schema)
