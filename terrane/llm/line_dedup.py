"""Lines that many documents share stay in one document only.

Every line gets a key (the line stripped and A-Z lower-cased) and every key of
at least ``MIN_CHARS`` code points a 128-bit hash.  The rows (hash, document,
position) are range-partitioned by hash and document and sorted, documents
downwards; each task streams its range once.  The first document of a key is
the largest that holds it and keeps its lines; as soon as ``MIN_DOCS`` documents
have been seen, all lines of the later ones are dropped.  A task holds back the
lines of at most ``MIN_DOCS - 1`` documents.

A key with many documents is cut over several ranges.  What a task cannot know
(whether its first key began in the range before, how its last key goes on) it
writes down as *open* lines and one summary row for each of those two keys; the
summaries, at most two a range, are added up by key and joined to the open
lines.  No key is ever one task's.

What comes back is a bitmap of kept lines for each document that loses some
(one bit a line, compressed by zlib), not text.

Defined results: a null or empty text is one empty line; a line of white space
has an empty key and stays; texts of any length are split whole; rows that
repeat an id count as one document and lose the same positions; a row with a
null id counts for nothing and keeps all lines; keys in equally many documents
do not compete, so there are no ties; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.workspace import Workspace, bounded_batches, partitions

#: Shorter keys are never dropped.
MIN_CHARS = 40
#: Keys in fewer documents are never dropped.
MIN_DOCS = 5
#: Stripped at both ends of a line.
STRIPPED = " \t\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of streamed rows: a line to drop, a line that other ranges decide on, a key's count of documents.
DROP, OPEN, COUNT = range(3)
_STREAMED = "kind int, h1 long, h2 long, doc long, at int"
_NAMES = ["kind", "h1", "h2", "doc", "at"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, at): the lines that have a long enough key, ``at`` from 0."""
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    lines = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.length("line") >= min_chars)
    keys = lines.select("doc", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "at")


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int = MIN_DOCS) -> Iterator[pa.RecordBatch]:
    """One sorted range of (h1, h2, doc, at), documents downwards -> ``_STREAMED``."""

    def table(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        h1, h2, doc, at = columns
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), kind, np.int32)), *map(pa.array, (h1, h2, doc, at.astype(np.int32)))], names=_NAMES)

    held = [np.zeros(0, np.int64) for _ in range(4)]  # of the key that is still going on
    held_n = np.zeros(0, np.int64)
    key = last = top = None
    count, first_key = 0, True

    def closed() -> list[pa.RecordBatch]:
        """The summary of the first or last key."""
        one = lambda v: np.array([v], np.int64)
        return [table(COUNT, one(key[0]), one(key[1]), one(top), one(count))]

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        n = len(cols[0])
        if not n:
            continue
        new_key = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        new_doc = new_key | np.append(True, cols[2][1:] != cols[2][:-1])
        goes_on = key == (cols[0][0], cols[1][0])
        if goes_on:
            new_key[0], new_doc[0] = False, cols[2][0] != last
        begin = np.flatnonzero(np.append(True, new_key[1:]))
        group = np.cumsum(np.append(False, new_key[1:]))
        # Which document of its key each line is in, from 1.
        nth = np.cumsum(new_doc)
        nth -= (nth[begin] - new_doc[begin])[group]
        if goes_on:
            nth[group == 0] += count
        elif key is not None and first_key:
            yield from closed()
            first_key = False
        if not goes_on and len(held_n):
            held, held_n = [c[:0] for c in held], held_n[:0]  # too few documents: its lines stay
        total = np.maximum.reduceat(nth, begin)
        tops = cols[2][begin]
        if goes_on:
            tops[0] = top
        # The range's first key is left open wherever it ends.
        opened = np.flatnonzero(group == 0) if first_key and (goes_on or key is None) else np.zeros(0, np.int64)
        if len(opened):
            yield table(OPEN, *(c[opened] for c in cols))
        last_group = len(begin) - 1
        mine = np.ones(n, bool)
        mine[opened] = False
        drop = mine & (nth > 1) & (total[group] >= min_docs)
        if goes_on and len(held_n) and total[0] >= min_docs:
            yield table(DROP, *(c[held_n > 1] for c in held))
            held, held_n = [c[:0] for c in held], held_n[:0]
        if drop.any():
            yield table(DROP, *(c[drop] for c in cols))
        if last_group and first_key:
            key, top, count = (cols[0][0], cols[1][0]), tops[0], total[0]
            yield from closed()
            first_key = False
        wait = mine & (group == last_group) & (total[group] < min_docs)
        if last_group:
            held, held_n = [c[:0] for c in held], held_n[:0]
        held, held_n = [np.append(a, c[wait]) for a, c in zip(held, cols, strict=True)], np.append(held_n, nth[wait])
        key, last, top, count = (cols[0][-1], cols[1][-1]), cols[2][-1], tops[-1], total[-1]
    if key is not None:
        yield from closed()
        if len(held_n):
            yield table(OPEN, *held)


def dropped_lines(docs: DataFrame, ws: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, at): the lines that go."""
    lines = ws.keep(keyed_lines(docs, min_chars), "lines")  # written, so that sampling for ranges does not read texts again
    ranges = lines.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "at")
    told = ws.keep(ranges.mapInArrow(lambda batches: streamed(batches, min_docs), _STREAMED), "told")
    ws.drop("lines")
    counts = told.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("at").alias("docs"), F.max("doc").alias("top")).filter(F.col("docs") >= min_docs)
    # At most two rows a range: bounded by the number of partitions, not by the data.
    decided = told.filter(F.col("kind") == OPEN).join(F.broadcast(counts), ["h1", "h2"]).filter(F.col("doc") < F.col("top"))
    return told.filter(F.col("kind") == DROP).select("doc", "at").unionByName(decided.select("doc", "at"))


def packed(at: np.ndarray) -> bytes:
    """Compressed bitmap of kept lines, without those at the given places; it
    ends with the byte of the last one."""
    keep = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
    keep[at] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpacked(bitmap: bytes, lines: int) -> np.ndarray:
    """Which of a text's lines stay."""
    keep = np.ones(lines, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[:lines]
    keep[: len(bits)] = bits
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        where, at = lists.offsets.to_numpy(), lists.values.to_numpy()
        out, kept = [], []
        for a, b in zip(where[:-1], where[1:], strict=True):
            places = np.unique(at[a:b])
            out.append(packed(places))
            kept.append(len(places))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.int64()), pa.array(out, pa.binary())], names=["doc", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, label: str = "lines", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, n_dropped, keep) for each document that loses lines; ``keep`` goes to
    its last dropped line, and all lines after it stay."""
    bounded_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, label)
    # A document's list is no longer than its own lines.
    lists = dropped_lines(docs, ws, min_chars, min_docs).groupBy("doc").agg(F.collect_list("at").alias("at"))
    bitmaps = ws.keep(lists.mapInArrow(_bitmaps, "doc long, n_dropped long, keep binary"), "bitmaps")
    ws.drop("told")
    return bitmaps


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """A text's kept lines, its number of lines and of dropped ones."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    keep = unpacked(bitmap, len(lines)).tolist()
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), keep.count(False)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [kept_text(t.as_py(), b.as_py()) for t, b in zip(batch.column(1), batch.column(2), strict=True)]
        digest = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in rows]
        n, gone = ([r[k] for r in rows] for k in (1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op13(docs: DataFrame) -> DataFrame:
    # Sorted and merged at every size: the bitmaps grow with the documents.
    bitmaps = keep_bitmaps(docs).select(F.col("doc").alias("__doc"), "keep").hint("merge")
    rows = docs.select("doc_id", "text").join(bitmaps, F.col("doc_id").cast("long") == F.col("__doc"), "left").select("doc_id", "text", "keep")
    return rows.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
