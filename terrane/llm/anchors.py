"""Repeated windows across a corpus: routing text by content.

A window is ``width`` consecutive items (bytes or words) of one document.  Two
equal windows hold the same k-grams, so they also share the least hash of their
k-grams: their anchor.  Neighbouring windows mostly share their anchor too;
each maximal run of them is a segment.  Whatever finds equal windows therefore
only has to compare segments with equal anchors, and the corpus is dealt out by
anchor in one shuffle of short rows.

``Plan.prepare`` gives the candidates:

* ``spare``: segments that equal a segment of an earlier document (every window
  of them is repeated), found by a combining aggregate;
* ``rivals``: one representative of every class of equal segments whose anchor
  also occurs with other content, with its text, for the operator to compare;
* ``single``: for anchors with more than ``HOT`` classes (the border of a passage
  that very many documents share), the windows one by one under a hash of their
  own content; equal ones meet in a combining aggregate, so no task ever holds
  such an anchor's rows together.

No step gathers an anchor, a class or a document set in one place, nothing is
sent to the driver, and every table is written to the shared folder.

Segments are told apart by two 64-bit hashes, of their anchor and of their
content, so n segments hold a false pair with probability n * n / 2**129 (at
10**13 segments, some 100 TB of text: 10**-13).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.workspace import Workspace

#: Classes of one anchor that are compared together; beyond, windows go alone.
HOT = 4096

_INVERSE = np.uint64(pow(int(K.BASE), -1, 2**64))


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``words`` or bytes, and its width and k-gram size."""

    words: bool
    width: int
    k: int  # bytes: a power of two

    def read(self, buf: np.ndarray, offs: np.ndarray):
        """codes of items, first item of each row, k-gram codes, words or None."""
        if self.words:
            found = K.find_words(buf, offs)
            codes = K.word_codes(buf, found)
            return codes, found.first, K.grams(codes, self.k), found
        return K.BYTE_CODE[buf], offs, K.byte_grams(buf, self.k.bit_length() - 1), None


class Content:
    """Hashes of arbitrary item ranges by prefix sums."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * K.powers(K.BASE, len(codes)), out=self.sums[1:])
        self.back = K.powers(_INVERSE, len(codes) + 1)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return K.mix((self.sums[start + length] - self.sums[start]) * self.back[start] + length.astype(np.uint64))


def _anchor_places(seq: np.ndarray, span: int) -> np.ndarray:
    """For each window, the place of its least k-gram, the leftmost of equals.

    The place is packed under the hash, so that one running minimum gives both;
    long inputs go in blocks, whose places fit the low 20 bits.
    """
    out, step, low = [], 1 << 19, np.uint64((1 << 20) - 1)
    for s in range(0, max(1, len(seq) - span + 1), step):
        part = seq[s : s + step + span - 1]
        packed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((K.window_min(packed, span) & low).astype(np.int64) + s)
    return np.concatenate(out)


def segments(unit: Unit, buf: np.ndarray, offs: np.ndarray):
    """row, anchor, content hash, start (within the row), windows and place of
    the anchor (within the segment) of each segment.

    A segment is a maximal run of windows whose anchor is at one place, so equal
    windows are always in different segments, also in periodic text.
    """
    codes, first, seq, _ = unit.read(buf, offs)
    span = unit.width - unit.k + 1
    count = np.maximum(0, np.diff(first) - unit.width + 1)
    at = K.ranges(first[:-1], count)
    if not len(at):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing.view(np.uint64), nothing.view(np.uint64), nothing, nothing, nothing
    row = np.repeat(np.arange(len(count)), count)
    place = _anchor_places(seq, span)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(at)))
    start = at[begin]
    content = Content(codes).of(start, run + unit.width - 1)
    return row[begin], seq[place[begin]], content, start - first[:-1][row[begin]], run, place[begin] - start


#: A segment's numbers in one long: start, place of the anchor (15 bits), windows (15 bits), and whether the row has it twice.
START, ANCHOR, RUN = 31, 16, 1


def packed(start: np.ndarray, at: np.ndarray, run: np.ndarray, again: np.ndarray) -> np.ndarray:
    return start << START | at << ANCHOR | run << RUN | again


def unpacked(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, place of the anchor, windows."""
    return seg >> START, seg >> ANCHOR & 0x7FFF, seg >> RUN & 0x7FFF


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def segment_batches(unit: Unit, only_anchors: bool):
    """Rows of every segment, or the distinct anchors of each slice with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offs = K.text_bytes(batch.column(1))
            for a, b in K.slices(offs):
                row, anchor, content, start, run, at = segments(unit, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if only_anchors:
                    value, count = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([_i64(value), _i64(count)], names=["h", "n"])
                    continue
                order = np.lexsort((start, content, anchor, row))
                again = np.zeros(len(row), bool)
                here, before = order[1:], order[:-1]
                again[here] = (row[here] == row[before]) & (anchor[here] == anchor[before]) & (content[here] == content[before])
                columns = [anchor, content, ids[a:b][row], packed(start, at, run, again)]
                yield pa.RecordBatch.from_arrays([_i64(c) for c in columns], names=["h", "c", "doc", "seg"])

    return run


#: Text of one batch of rivals; Arrow's offsets have 32 bits.
BATCH_BYTES = 64 << 20


def _rivals(key: np.ndarray, doc: np.ndarray, start: np.ndarray, at: np.ndarray, part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of rivals whose texts are the byte ranges begin .. end of ``part``."""
    offs = np.concatenate([[0], np.cumsum(end - begin)])
    for a, b in K.slices(offs, BATCH_BYTES):
        text = np.ascontiguousarray(part[K.ranges(begin[a:b], (end - begin)[a:b])])
        ends = pa.py_buffer((offs[a : b + 1] - offs[a]).astype(np.int32))
        texts = pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(text)])
        numbers = [_i64(key[a:b]), _i64(np.zeros(b - a, np.int64)), _i64(doc[a:b]), _i64(start[a:b]), pa.array(at[a:b].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*numbers, texts], names=["h", "c", "doc", "start", "at", "text"])


def text_batches(unit: Unit):
    """(doc, text, list of (h, seg, hot)) -> rivals' texts and, for hot anchors,
    each window's content hash (text null; ``at`` 1 marks a window that the
    document has before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offs = K.text_bytes(batch.column(1))
            asked = batch.column(2)
            where = asked.offsets.to_numpy().astype(np.int64)
            h, seg, hot = (asked.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b in K.slices(offs):
                part = buf[offs[a] : offs[b]]
                codes, first, _, words = unit.read(part, offs[a : b + 1] - offs[a])
                lo, hi = where[a], where[b]
                row = np.repeat(np.arange(b - a), np.diff(where[a : b + 1]))
                start, at, n = unpacked(seg[lo:hi])
                is_hot, key, doc = hot[lo:hi].astype(bool), h[lo:hi], ids[a:b][row]
                begin = first[row] + start
                cold = ~is_hot
                if cold.any():
                    s, m = begin[cold], n[cold] + unit.width - 1
                    from_byte, to_byte = (words.start[s], words.end[s + m - 1]) if words is not None else (s, s + m)
                    yield from _rivals(key[cold], doc[cold], start[cold], at[cold], part, from_byte, to_byte)
                if is_hot.any():
                    window = K.ranges(begin[is_hot], n[is_hot])
                    of = np.repeat(np.flatnonzero(is_hot), n[is_hot])
                    c = Content(codes).of(window, np.full(len(window), unit.width))
                    # Within a row the first of equal windows speaks for the others.
                    order = np.lexsort((window, c, row[of]))
                    again = np.zeros(len(window), bool)
                    again[order[1:]] = (row[of][order[1:]] == row[of][order[:-1]]) & (c[order[1:]] == c[order[:-1]])
                    numbers = [_i64(key[of]), _i64(c), _i64(doc[of]), _i64(window - first[row[of]]), pa.array(again.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.nulls(len(window), pa.binary())], names=["h", "c", "doc", "start", "at", "text"])

    return run


def candidates(docs: DataFrame, unit: Unit, ws: Workspace, same_document: bool) -> tuple[DataFrame, DataFrame]:
    """(spans, rivals) for docs(doc, text), doc not null.

    spans: (doc, start, length in items) that are known to be repeated.
    rivals: (h, doc, start, at, text), to be compared within each h, whose
    k-gram is the one at item ``at`` of the text.
    same_document: an equal window earlier in the same document counts too.
    """
    n = docs.mapInArrow(segment_batches(unit, True), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    # Written, so that the join below reads two plain shuffles and a crowded anchor's side of it can be split.
    n = ws.keep(n, "shared")
    rows = docs.mapInArrow(segment_batches(unit, False), "h long, c long, doc long, seg long")
    found = ws.keep(rows.join(n, "h"), "found")

    again = F.col("seg").bitwiseAND(F.lit(1)) == 1
    classes = found.filter(~again).groupBy("h", "c").agg(F.min("doc").alias("first"))
    classes = ws.keep(classes, "classes")
    crowd = ws.keep(classes.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"), "crowd")
    told = found.join(classes, ["h", "c"])
    later = F.col("doc") > F.col("first")
    if same_document:
        later = later | again
    told = ws.keep(told.select("h", "doc", "seg", later.alias("later")), "told")
    length = F.shiftright("seg", RUN).bitwiseAND(F.lit(0x7FFF)) + (unit.width - 1)
    spare = told.filter("later").select("doc", F.shiftright("seg", START).alias("start"), length.alias("length"))

    # Representatives of anchors with several contents (without same_document: their repeats within the document too).
    asked = told.filter("not later").join(crowd, "h").select("h", "doc", "seg", (F.col("classes") > HOT).alias("hot"))
    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "seg", "hot")).alias("asked"))
    with_text = per_doc.join(docs, "doc").select("doc", "text", "asked")
    pulled = ws.keep(with_text.mapInArrow(text_batches(unit), "h long, c long, doc long, start long, at int, text binary"), "pulled")
    rivals = pulled.filter("text is not null").select("h", "doc", "start", "at", "text")

    single = pulled.filter("text is null")
    firsts = ws.keep(single.groupBy("h", "c").agg(F.min("doc").alias("first")), "firsts")
    repeat = F.col("doc") > F.col("first")
    if same_document:
        repeat = repeat | (F.col("at") == 1)
    alone = single.join(firsts, ["h", "c"]).filter(repeat).select("doc", "start", F.lit(unit.width).cast("long").alias("length"))
    return spare.unionByName(alone), rivals


def grouped(rivals: DataFrame, ws: Workspace) -> DataFrame:
    """Rivals with equal anchors next to each other, whole anchors in one task."""
    from terrane.workspace import partitions

    return rivals.repartition(partitions(ws.spark), "h").sortWithinPartitions("h", "doc", "start")


def reach(unit: Unit, codes: np.ndarray, first: np.ndarray, key: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each string another string with its key may share around the
    anchor: (string, begin, end) in items, without the strings that can share no
    window.

    Equal windows have their anchors at the same place.  So a window with l
    items before its anchor is only shared if some other string has the same l
    items before its own, and likewise behind it.  Both lengths are found to
    within ``step`` items; longer ones are allowed, so nothing is lost.
    """
    content = Content(codes)
    place = first[:-1] + at
    most = unit.width - unit.k

    def shared(start_of, room: np.ndarray) -> np.ndarray:
        best, live = np.zeros(len(key), np.int64), np.arange(len(key))
        for size in range(step, most + 1, step):
            live = live[room[live] >= size]
            if not len(live):
                break
            mark = K.mix(key[live].astype(np.uint64) ^ content.of(start_of(size)[live], np.full(len(live), size)))
            _, back, count = np.unique(mark, return_inverse=True, return_counts=True)
            live = live[count[back] > 1]
            best[live] = size
        return np.minimum(np.minimum(best + step - 1, room), most)

    left = shared(lambda size: place - size, at)
    right = shared(lambda size: place + unit.k, np.diff(first) - at - unit.k)
    string = np.flatnonzero(left + right >= most)
    return string, (place - left)[string], (place + unit.k + right)[string]


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Whole anchors, gathered until their texts reach ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False)
        length = np.diff(K.text_bytes(batch.column(4))[1])
        total = np.cumsum(length)
        at = 0
        border = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        if len(h) and last is not None and h[0] == last:
            border = border[1:]
        for p in border:
            here = size + (total[p - 1] if p else 0) - (total[at - 1] if at else 0)
            if here >= limit:
                if p > at:
                    held.append(batch.slice(at, p - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, at = [], 0, p
        if at < len(h):
            held.append(batch.slice(at))
            size += total[-1] - (total[at - 1] if at else 0)
            last = h[-1]
    if held:
        yield pa.Table.from_batches(held)
