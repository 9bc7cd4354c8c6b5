"""Repeated runs of words, by an FM-index per shard.

A window of 13 words is removed when it also starts in a document with a
smaller id.  Shards are chunks of whole anchors (see ``anchors``): each builds
the FM-index of its passages, then streams the passages through it.  Backward
search gives, at every word, the length of the longest match that ends there;
where it reaches 13 words, the interval of suffixes lists every place of the
window, and the least document among them decides.  Before a shard is built,
its passages are cut to what another passage of their anchor may share
(``anchors.reach``).

Defined results: null and short texts have no window and keep all words; a
repeat within one document alone is kept; ids are taken to be unique (rows that
repeat an id are cut by that id's spans together); a null id is never compared
and keeps its words; empty tables give empty results; other columns are ignored
(``cut_texts`` hands them on).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import anchors
from terrane.llm import kernels as K
from terrane.llm.fm_index import FMIndex
from terrane.llm.suffix_dedup import merged, with_spans
from terrane.workspace import Workspace, bounded_batches

WIDTH = 13
UNIT = anchors.Unit(words=True, width=WIDTH, k=5)
CHUNK_BYTES = 128 << 10


def repeated_words(codes: np.ndarray, first: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset in words) of windows that a smaller document has too;
    codes: the strings' words, of which each has those from ``first`` on."""
    _, ids = np.unique(codes, return_inverse=True)
    text = (ids + 1).astype(np.uint16 if ids.max(initial=0) < 65000 else np.int64)
    index = FMIndex(text, first)
    count = np.diff(first)
    windows = np.maximum(0, count - width + 1)
    string = np.repeat(np.arange(len(count)), windows)
    begin = K.ranges(first[:-1], windows)
    matched, low, high = index.matching_statistics(text, begin + width, width)
    # Every streamed window is in its own shard's index; one place is itself.
    hit = np.flatnonzero((matched == width) & (high - low > 1))
    if not len(hit):
        return string[hit], begin[hit]
    of_suffix = doc[np.searchsorted(index.collection.end, index.pos, "left")]
    places, back = np.unique(low[hit], return_inverse=True)
    length = np.zeros(len(places), np.int64)
    length[back] = (high - low)[hit]
    least = np.minimum.reduceat(of_suffix[K.ranges(places, length)], np.cumsum(length) - length)
    hit = hit[least[back] < doc[string[hit]]]
    return string[hit], begin[hit] - first[string[hit]]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in anchors.chunks(batches, CHUNK_BYTES):
        buf, offs = K.text_bytes(table.column("text"))
        key, doc, start, at = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "doc", "start", "at"))
        words = K.find_words(buf, offs)
        codes = K.word_codes(buf, words)
        string, begin, end = anchors.reach(UNIT, codes, words.first, key, at, 1)
        doc, start = doc[string], start[string] + begin - words.first[string]
        cut = np.concatenate([[0], np.cumsum(end - begin)])
        string, offset, length = merged(*repeated_words(codes[K.ranges(begin, end - begin)], cut, doc), WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(doc[string]), pa.array(start[string] + offset), pa.array(length)], names=["doc", "start", "length"])


def kept_words(buf: np.ndarray, offs: np.ndarray, spans: pa.ListArray) -> tuple[K.Words, np.ndarray]:
    """The words of each row and which of them no span covers."""
    words = K.find_words(buf, offs)
    where = spans.offsets.to_numpy()
    s, n = (spans.values.field(i).to_numpy().astype(np.int64)[where[0] : where[-1]] for i in (0, 1))
    base = np.repeat(words.first[:-1], np.diff(where))
    step = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(step, base + s, 1)
    np.add.at(step, base + s + n, -1)
    return words, np.cumsum(step)[:-1] == 0


def joined(buf: np.ndarray, words: K.Words, kept: np.ndarray, row: int) -> bytes:
    """The kept words of a row with one space between them."""
    a, b = words.first[row], words.first[row + 1]
    s, e = words.start[a:b][kept[a:b]], words.end[a:b][kept[a:b]]
    if not len(s):
        return b""
    length = e - s + 1
    out = np.full(int(length.sum()), 0x20, np.uint8)
    out[K.ranges(np.cumsum(length) - length, length - 1)] = buf[K.ranges(s, e - s)]
    return out[:-1].tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.text_bytes(batch.column(1))
        words, kept = kept_words(buf, offs, batch.column(2))
        n = np.diff(words.first)
        left = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.first])
        digest = [hashlib.sha256(joined(buf, words, kept, i)).hexdigest() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - left), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def cut_bytes(buf: np.ndarray, offs: np.ndarray, words: K.Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the words that are not kept and
    the white space after each of them; everything else stays as it is."""
    gone = np.flatnonzero(~kept)
    row = np.searchsorted(words.first, gone, "right") - 1
    last = gone + 1 == words.first[row + 1]
    follows = words.start[np.minimum(gone + 1, len(words.start) - 1)]
    end = np.where(last, offs[row + 1], follows)
    cut = np.zeros(len(buf), bool)
    cut[K.ranges(words.start[gone], end - words.start[gone])] = True
    left = np.concatenate([[0], np.cumsum(~cut)])
    return buf[~cut], left[offs]


def _cutter(text: int, chars: int | None):
    """Batches of documents with a last column of spans -> the documents with
    those words cut out; texts without spans stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            spans = batch.column(batch.num_columns - 1)
            if len(spans.values):
                buf, offs = K.text_bytes(columns[text])
                left, ends = cut_bytes(buf, offs, *kept_words(buf, offs, spans))
                # 64-bit offsets, whatever the batch holds; null texts have no spans and stay null.
                whole = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(left)).cast(columns[text].type)
                touched = pa.array(np.diff(spans.offsets.to_numpy()) > 0)
                columns[text] = pc.if_else(touched, whole, columns[text])
                if chars is not None:
                    columns[chars] = pc.if_else(touched, pc.utf8_length(columns[text]).cast(columns[chars].type), columns[chars])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def repeated_spans(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc, start, length) in words; spans may overlap."""
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    spare, rivals = anchors.candidates(keyed, UNIT, ws, same_document=False)
    compared = anchors.grouped(rivals, ws).mapInArrow(_stream, "doc long, start long, length long")
    return spare.unionByName(compared)


def spans_of(docs: DataFrame, label: str = "substring") -> DataFrame:
    bounded_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, label)
    spans = ws.keep(repeated_spans(docs, ws), "spans")
    ws.drop("shared", "found", "classes", "crowd", "told", "pulled", "firsts")
    return spans


def cut_texts(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, their repeated passages cut out of
    ``text`` with the white space after each word, so that lines and spacing of
    the rest stay; ``n_chars`` follows, if there."""
    names = docs.columns
    lists = spans_of(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    rows = docs.join(lists, docs["doc_id"] == lists["doc"], "left").select(*[docs[c] for c in names], F.coalesce("__spans", none).alias("__spans"))
    return rows.mapInArrow(_cutter(names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)


def op7(docs: DataFrame) -> DataFrame:
    return with_spans(docs, spans_of(docs)).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
