"""Exact repeats of 100 bytes, by a collection's Burrows-Wheeler transform.

The rivals of an anchor (see ``anchors``) are a collection of short strings.
``collection_bwt`` sorts their suffixes column-wise, one symbol of each string
a round.  Its arrays are read and written once a round, front to back; they
stand for the external files of a one-machine version, since a cluster's tasks
may not use machine-local folders: what exceeds memory is the shuffle and the
written tables around it.  A task holds one chunk of whole anchors of about
``CHUNK_BYTES``.  Before a chunk is sorted, its strings are cut to what another
string of their anchor may share (``anchors.reach``).

In the finished order, suffixes of 100 bytes or more whose common prefixes are
100 or more are equal windows; all but the earliest are repeats.

Defined results: null and short texts have no window and keep all bytes; equal
windows inside one text count; ids are taken to be unique (rows that repeat an
id are cut by that id's spans together); a null id is never compared and keeps
its bytes; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import anchors
from terrane.llm import kernels as K
from terrane.llm.collection_bwt import Collection
from terrane.workspace import Workspace, bounded_batches

WIDTH = 100
UNIT = anchors.Unit(words=False, width=WIDTH, k=32)
CHUNK_BYTES = 256 << 10
#: Bytes to which shared lengths before and behind an anchor are found.
STEP = 2


def repeated_windows(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that equals an earlier one, where strings
    lie at ``start`` in their documents and (doc, place) says what is earlier."""
    symbols = buf.astype(np.uint16 if (buf == 255).any() else np.uint8) + 1
    coll = Collection(symbols, offs)
    pos, _, lcp = coll.suffix_order()
    string = np.searchsorted(coll.end, pos, "left")
    long = coll.end[string] - pos >= width
    same = lcp >= width
    member = long & (same | np.append(same[1:], False))
    group = np.cumsum(~same)[member]
    string, offset = string[member], (pos - coll.begin[string])[member]
    place = start[string] + offset
    order = np.lexsort((place, doc[string], group))
    later = np.append(False, group[order[1:]] == group[order[:-1]]) if len(order) else np.zeros(0, bool)
    return string[order][later], offset[order][later]


def merged(string: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each string that touch, as (string, offset, length)."""
    if not len(string):
        return string, offset, offset
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + width)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(string)) - 1
    return string[begin], offset[begin], offset[last] - offset[begin] + width


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in anchors.chunks(batches, CHUNK_BYTES):
        buf, offs = K.text_bytes(table.column("text"))
        key, doc, start, at = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "doc", "start", "at"))
        string, begin, end = anchors.reach(UNIT, K.BYTE_CODE[buf], offs, key, at, STEP)
        doc, start = doc[string], start[string] + begin - offs[string]
        cut = np.concatenate([[0], np.cumsum(end - begin)])
        string, offset, length = merged(*repeated_windows(buf[K.ranges(begin, end - begin)], cut, doc, start), WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(doc[string]), pa.array(start[string] + offset), pa.array(length)], names=["doc", "start", "length"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> digest of what is left."""
    for batch in batches:
        buf, offs = K.text_bytes(batch.column(1))
        spans = batch.column(2)
        where = spans.offsets.to_numpy()
        s, n = (spans.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        size, removed, runs, digest = np.diff(offs), [], [], []
        for i in range(batch.num_rows):
            text = buf[offs[i] : offs[i + 1]]
            lo, hi = where[i], where[i + 1]
            if hi > lo:
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, s[lo:hi], 1)
                np.add.at(step, s[lo:hi] + n[lo:hi], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                text = text[~gone]
            else:
                removed.append(0), runs.append(0)
            digest.append(hashlib.sha256(text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc, start, length): bytes that 100-byte repeats cover; spans may overlap."""
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    spare, rivals = anchors.candidates(keyed, UNIT, ws, same_document=True)
    compared = anchors.grouped(rivals, ws).mapInArrow(_compare, "doc long, start long, length long")
    return spare.unionByName(compared)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the list of the document's spans (empty: none)."""
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(lists, F.col("doc_id") == F.col("doc"), "left")
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("spans"))


def op6(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "suffix")
    spans = ws.keep(repeated_spans(docs, ws), "spans")
    ws.drop("shared", "found", "classes", "crowd", "told", "pulled", "firsts")
    return with_spans(docs, spans).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
