"""Benchmark decontamination: BM25 retrieval of test items, then overlap.

The test items are the indexed collection and every passage of every document
is a query.  An item's BM25 impacts are divided by the item's score for its own
text, so that a passage that holds the whole item scores 1 and one threshold
serves all items.  Passages are windows of twice the longest item's length that
advance by that length, so each stretch of an item's length lies in one window.

Retrieval is block-max WAND.  Items are numbered and postings lie in blocks of
``BLOCK`` numbers with the largest impact of each.  A slice's passages are
bounded together: by the sum of their terms' largest impacts, then by the sum
of block maxima in each block.  In the blocks that remain, the cursors of the
passage's terms are moved by the WAND pivot rule, and items at or above the
threshold are scored in full.  Bounds only ever drop what cannot reach the
threshold, so the retrieval is exact.

A retrieved item is confirmed when the passage holds enough of its question's
word 3-grams and of its answer's words (the answer is the last sentence; an item
of one sentence is all question).  It is also confirmed without its answer, by
nearly all of a question of ``ALONE_WORDS`` words or more, or, where the answer
is shorter than a word 3-gram, by enough of the whole item's 3-grams.  So that
such a question is retrieved, what is held against the threshold is divided by
the score of the question's words; the score given is the whole item's share.

The index is built on the driver and travels in the task's closure, so its size
is checked: more than ``INDEX_ITEMS`` items are indexed in parts, one after the
other, each with its own pass over the documents whose result is written before
the next part is built; numbers of items with a word and the mean length are
those of all items.  Documents are never shuffled.

Defined results: null and blank texts hold nothing; items with a null id or
without words are never found; a document with a null id is reported under it;
repeated rows are reported each; repeated items too; items of equal score are
reported each; texts of any length are searched whole; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.workspace import Workspace, bounded_batches

THRESHOLD = 0.6
QUESTION_SHARE, ANSWER_SHARE, GRAM = 0.5, 0.5, 3
#: A question that stands for its item without the answer: share of its 3-grams, and its words at least.
ALONE_SHARE, ALONE_WORDS = 0.8, 8
K1, B = 1.2, 0.75
BLOCK = 4
#: Items of one index; at 200 words each, some 40 MB on the driver.
INDEX_ITEMS = 20_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = K.text_bytes(pa.array(texts, pa.large_string()))
    buf = K.lower_case(buf)
    words = K.find_words(buf, offs, K.NOT_LETTER)
    return K.word_codes(buf, words), words.first


@dataclass
class Index:
    ids: np.ndarray
    codes: np.ndarray  # words of all items
    first: np.ndarray
    answer: np.ndarray  # words in each item's question
    terms: np.ndarray  # sorted codes
    maybe: np.ndarray  # by a code's 16 high bits: some term has them
    top: np.ndarray  # largest impact of each term
    posting: np.ndarray  # first posting of each term
    item: np.ndarray
    impact: np.ndarray
    block_of: np.ndarray  # (term, block) rows: block, and its first posting and largest impact
    block_at: np.ndarray
    block_max: np.ndarray
    block_row: np.ndarray  # first row of each term
    stride: int
    whole: np.ndarray  # each item's score for its own text


@dataclass
class Totals:
    """Of all items: their number, the sorted codes of their words, the number
    of items with each, and the mean number of words."""

    items: int
    terms: np.ndarray
    df: np.ndarray
    mean: float


def totals(parts: Iterator[list[str]]) -> Totals:
    items, filled, words = 0, 0, 0
    terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for texts in parts:
        codes, first = _codes(texts)
        length = np.diff(first)
        own, term = np.unique(codes, return_inverse=True)
        pair = np.unique(term * max(1, len(texts)) + np.repeat(np.arange(len(texts)), length))
        both, at = np.unique(np.concatenate([terms, own]), return_inverse=True)
        df = np.bincount(at, np.concatenate([df, np.bincount(pair // max(1, len(texts)), minlength=len(own))]), minlength=len(both)).astype(np.int64)
        terms = both
        items, filled, words = items + len(texts), filled + int((length > 0).sum()), words + int(length.sum())
    return Totals(items, terms, df, words / max(1, filled))


def stride_of(words: int) -> int:
    """Stride of the passages in which an item of so many words is sought."""
    stride = 32
    while stride < words:
        stride *= 2
    return stride


def build_indexes(ids: list[int], texts: list[str], known: Totals | None = None) -> list[Index]:
    """An index for each stride that the items need."""
    known = known or totals(iter([texts]))
    stride = np.array([stride_of(n) for n in np.diff(_codes(texts)[1])], np.int64)
    out = []
    for s in np.unique(stride):
        own = np.flatnonzero(stride == s)
        index = build_index([ids[i] for i in own], [texts[i] for i in own], known, int(s))
        if index is not None:
            out.append(index)
    return out


def build_index(ids: list[int], texts: list[str], known: Totals | None = None, stride: int = 32) -> Index | None:
    codes, first = _codes(texts)
    length = np.diff(first)
    if not len(codes):
        return None
    # Questions end before the last sentence.
    heads = []
    for t in texts:
        body = (t or "").rstrip()
        cut = max(body[:-1].rfind(mark) for mark in (". ", "? ", "! ", ".\n", "?\n", "!\n"))
        heads.append(body[: cut + 1] if cut >= 0 else body)
    answer = np.diff(_codes(heads)[1])
    terms, term = np.unique(codes, return_inverse=True)
    item = np.repeat(np.arange(len(ids)), length)
    pair, tf = np.unique(term * len(ids) + item, return_counts=True)
    of_term, of_item = pair // len(ids), pair % len(ids)
    known = known or totals(iter([texts]))
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    mean = known.mean
    impact = idf[of_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[of_item] / mean))
    # A question that may stand alone is the measure of its item.
    place = np.arange(len(codes)) - np.repeat(first[:-1], length)
    in_head = np.isin(pair, (term * len(ids) + item)[place < answer[item]])
    total = np.bincount(of_item, impact, minlength=len(ids))
    own = np.where(answer >= ALONE_WORDS, np.bincount(of_item, impact * in_head, minlength=len(ids)), total)
    impact = impact / own[of_item]
    whole = np.divide(total, own, out=np.ones(len(ids)), where=own > 0)
    posting = np.searchsorted(of_term, np.arange(len(terms) + 1))
    row_new = np.append(True, (of_term[1:] != of_term[:-1]) | (of_item[1:] // BLOCK != of_item[:-1] // BLOCK))
    block_at = np.flatnonzero(row_new)
    maybe = np.zeros(1 << 16, bool)
    maybe[terms >> np.uint64(48)] = True
    return Index(
        np.array(ids, np.int64), codes, first, answer, terms, maybe, np.maximum.reduceat(impact, posting[:-1]), posting, of_item, impact,
        of_item[block_at] // BLOCK, np.append(block_at, len(pair)), np.maximum.reduceat(impact, block_at), np.searchsorted(of_term[block_at], np.arange(len(terms) + 1)), stride, whole,
    )


def wand(index: Index, rows: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Items of one block at or above the threshold.  rows: the (term, block)
    rows of the passage's terms."""
    begin, end, most = index.block_at[rows].tolist(), index.block_at[rows + 1].tolist(), index.block_max[rows].tolist()
    cursors = [[index.item[a : b].tolist(), index.impact[a : b].tolist(), m, 0] for a, b, m in zip(begin, end, most, strict=True)]
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0][c[3]])
        bound, pivot = 0.0, None
        for items, _, largest, at in cursors:
            bound += largest
            if bound >= threshold - 1e-12:
                pivot = items[at]
                break
        if pivot is None:
            break
        if cursors[0][0][cursors[0][3]] == pivot:
            score = 0.0
            for c in cursors:
                if c[0][c[3]] != pivot:
                    break
                score += c[1][c[3]]
                c[3] += 1
            if score >= threshold - 1e-9:
                found.append((pivot, score))
        else:
            # No item before the pivot can reach the threshold: all cursors go on to it.
            for c in cursors:
                while c[3] < len(c[0]) and c[0][c[3]] < pivot:
                    c[3] += 1
        cursors = [c for c in cursors if c[3] < len(c[0])]
    return found


def overlap(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's word 3-grams and the answer's words in a passage."""
    words = index.codes[index.first[item] : index.first[item + 1]]
    cut = int(index.answer[item])
    head, tail = words[:cut], words[cut:]
    k = min(GRAM, len(head))
    question = float(np.isin(K.grams(head, k), K.grams(passage, k)).mean()) if k else 1.0
    return question, float(np.isin(tail, passage).mean()) if len(tail) else 1.0


def confirmed(index: Index, item: int, passage: np.ndarray, question: float, answer: float) -> bool:
    words = index.codes[index.first[item] : index.first[item + 1]]
    head = int(index.answer[item])
    if question >= QUESTION_SHARE and answer >= ANSWER_SHARE or head >= ALONE_WORDS and question >= ALONE_SHARE:
        return True
    if not 0 < len(words) - head < GRAM:
        return False
    k = min(GRAM, len(words))
    return bool(np.isin(K.grams(words, k), K.grams(passage, k)).mean() >= QUESTION_SHARE)


def search(index: Index, codes: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question, answer) for every text and confirmed item."""
    n = np.diff(first)
    token = np.flatnonzero(index.maybe[codes >> np.uint64(48)])
    at = np.minimum(np.searchsorted(index.terms, codes[token]), len(index.terms) - 1)
    known = index.terms[at] == codes[token]
    token, term = token[known], at[known]
    if not len(token):
        return []
    row = np.searchsorted(first, token, "right") - 1
    # Window w of a text holds its words w * stride .. (w + 2) * stride.
    windows = np.maximum(1, -(-n // index.stride) - 1)
    base = np.cumsum(windows) - windows
    own = (token - first[row]) // index.stride
    where, terms = [], []
    for w in (own, own - 1):
        ok = (w >= 0) & (w < windows[row])
        where.append(base[row[ok]] + w[ok])
        terms.append(term[ok])
    window, term = np.concatenate(where), np.concatenate(terms)
    # A first bound counts repeated terms again; what passes it is bounded by its distinct terms.
    rough = np.bincount(window, index.top[term], minlength=int(windows.sum()))
    passes = rough[window] >= threshold - 1e-9
    pair = np.unique(window[passes] * len(index.terms) + term[passes])
    window, term = pair // len(index.terms), pair % len(index.terms)
    bound = np.bincount(window, index.top[term], minlength=int(windows.sum()))
    live = bound[window] >= threshold - 1e-9
    window, term = window[live], term[live]
    if not len(window):
        return []
    # Block maxima of all remaining windows at once.
    count = index.block_row[term + 1] - index.block_row[term]
    rows = K.ranges(index.block_row[term], count)
    blocks = int(index.block_of.max()) + 1
    key = np.repeat(window, count) * blocks + index.block_of[rows]
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    limit = np.append(begin[1:], len(key))
    total = np.add.reduceat(index.block_max[rows], begin)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for i in np.flatnonzero(total >= threshold - 1e-9):
        w = int(key[begin[i]] // blocks)
        for item, score in wand(index, rows[begin[i] : limit[i]], threshold):
            text = int(np.searchsorted(base, w, "right") - 1)
            start = first[text] + (w - base[text]) * index.stride
            passage = codes[start : min(first[text + 1], start + 2 * index.stride)]
            question, answer = overlap(index, item, passage)
            if confirmed(index, item, passage, question, answer):
                best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (score / index.whole[item], question, answer))
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def _pass(docs: DataFrame, indexes: list[Index], threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            buf, offs = K.text_bytes(batch.column(1))
            for a, b in K.slices(offs):
                part = K.lower_case(buf[offs[a] : offs[b]])
                words = K.find_words(part, offs[a : b + 1] - offs[a], K.NOT_LETTER)
                codes = K.word_codes(part, words)
                for index in indexes:
                    found = search(index, codes, words.first, threshold)
                    rows = [np.array([f[k] for f in found], np.int64 if k < 2 else np.float64) for k in range(5)]
                    shares = [pa.array(np.minimum(1.0, x)) for x in rows[2:]]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0] + a)), pa.array(index.ids[rows[1]]), *shares], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score and overlaps of every confirmed item."""
    bounded_batches(docs.sparkSession)
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-items.count() // INDEX_ITEMS))

    def own(part: int) -> list:
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        return mine.orderBy("item_id", "text").collect()

    if parts == 1:
        rows = own(0)
        return _pass(docs, build_indexes([r["item_id"] for r in rows], [r["text"] for r in rows]), threshold)
    # The driver holds one part at a time: its result is written before the next is read.
    ws = Workspace(docs.sparkSession, "leaks")
    known = totals([r["text"] for r in own(part)] for part in range(parts))
    found = None
    for part in range(parts):
        rows = own(part)
        one = ws.keep(_pass(docs, build_indexes([r["item_id"] for r in rows], [r["text"] for r in rows], known), threshold), f"part-{part}")
        found = one if found is None else found.unionByName(one)
    return found


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contaminated(docs, items)
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
