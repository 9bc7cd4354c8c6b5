"""Near-duplicate documents by fast similarity sketching.

A document is the set of its distinct 5-word shingles (A-Z lower-cased).  Its
sketch has ``BANDS * ROWS`` coordinates.  In round i every shingle is hashed to
one coordinate with a value that starts with i; a coordinate keeps its least
value.  After as many rounds as coordinates, round t + j puts every shingle
into coordinate j, so that every coordinate is filled for any non-empty set;
rounds stop as soon as a sketch is full, which takes about t ln t / n of them.
Equal coordinates have the probability of the Jaccard similarity, and estimates
concentrate as with independent hashes.

Stages (every one a Spark shuffle on a high-cardinality key):

1.  sketch: one pass over the texts; identical sets become one node.
2.  bands: nodes that share a band form a bucket.  Each bucket links its
    members to one of them (another in each band), so a bucket of n nodes
    gives n - 1 pairs.  The pairs are checked on full sets.
3.  completion: buckets that still hold several components are finished
    exactly, inside tasks: an inverted index of the bucket's shingles counts
    the intersections of all nodes of the smaller components, and only edges
    that join two components leave the task.  A large bucket is dealt out in
    pairs of blocks, so that no task holds more than two blocks; blocks of the
    largest component are never paired with one another, so a large group of
    copies that stage 2 has joined costs a task for each of its blocks.
4.  connected components of the confirmed links.

With 40 bands of 5 rows a pair at similarity 0.75 shares no band with
probability 2e-5, one at 0.8 with 1e-7.

Defined results: null or blank texts have size 0 and stand alone; repeated rows
are in one class (an id that repeats with several texts is linked if any of
them is); ties go to the smallest id; a null id has a null component and is
never kept; texts of any length are sketched and compared whole; empty tables
give empty results; other columns are ignored.

Sets are compared by 64-bit codes of their shingles, identical ones by their
size and two 64-bit sums, so a pair of sets of m shingles is misjudged with
probability m * m / 2**64 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.llm.components import components
from terrane.workspace import Workspace, bounded_batches

SHINGLE = 5
BANDS, ROWS = 40, 5
#: Largest number of nodes and of shingles of a block in stage 3.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_500_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct shingles, ordered by row and code."""
    buf = K.LOWER[buf]
    words = K.find_words(buf, offs)
    codes = K.word_codes(buf, words)
    count = np.diff(words.first)
    full = np.maximum(count - k + 1, 0)
    code = K.grams(codes, k)[K.ranges(words.first[:-1], full)] if full.any() else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(count)), full)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([_sequence(codes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        code, row = np.concatenate([code, extra]), np.concatenate([row, short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return row[new], code[new]


def _sequence(codes: np.ndarray) -> np.uint64:
    """Code of a whole text of fewer than k words, apart from any shingle's."""
    return K.mix(K.grams(codes, len(codes)) + np.uint64(0x51ED270B * len(codes)))[0]


def sketches(row: np.ndarray, code: np.ndarray, rows: int, bins: int = BANDS * ROWS) -> np.ndarray:
    """rows x bins coordinates; rows without shingles keep the largest value."""
    empty = np.uint64(2**64 - 1)
    sig = np.full((rows, bins), empty)
    flat = sig.reshape(-1)
    low = np.uint64(2**55 - 1)
    for i in range(2 * bins):
        if not len(row):
            break
        h = K.mix(code ^ np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, row * bins + at, np.uint64(i << 55) | (h & low))
        full = (sig != empty).all(axis=1)
        if full.any():
            left = ~full[row]
            row, code = row[left], code[left]
    return sig


def band_codes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        h = K.mix(h * K.WORD_BASE + parts[:, :, j])
    return h.view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.text_bytes(batch.column(1))
        for a, b in K.slices(offs):
            row, code = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            n = np.bincount(row, minlength=b - a)
            first, second = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            np.add.at(first, row, K.mix(code))
            np.bitwise_xor.at(second, row, K.mix(code + K.BASE))
            bands = band_codes(sketches(row, code, b - a))
            has = n > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(bands[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], names=["doc_id", "n_shingles", "sa", "sb", "bands"])


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) whose full sets are similar enough."""
    for batch in batches:
        sides = [K.text_bytes(batch.column(i)) for i in (2, 3)]
        keep = np.zeros(batch.num_rows, bool)
        for a, b in K.slices(sides[0][1] + sides[1][1]):
            rows, codes, sizes = [], [], []
            for buf, offs in sides:
                row, code = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                rows.append(row), codes.append(code), sizes.append(np.bincount(row, minlength=b - a))
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            twice = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
            both = np.bincount(row[1:][twice], minlength=b - a)
            keep[a:b] = (both > 0) & (100 * both >= 75 * (sizes[0] + sizes[1] - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def link_group(nodes: np.ndarray, comps: np.ndarray, row: np.ndarray, code: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join components of one group, found exactly.

    row, code: the nodes' sets.  Counting goes through the group's inverted
    index, node by node, over all components but the largest.
    """
    n = len(nodes)
    _, comp = np.unique(comps, return_inverse=True)
    if comp.max(initial=0) == 0:
        return []
    size = np.bincount(row, minlength=n)
    _, term = np.unique(code, return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted = row[order]
    df = np.bincount(term)
    at = np.cumsum(df) - df
    begin = np.cumsum(size) - size  # rows are contiguous
    largest = np.bincount(comp).argmax()
    edges = []
    for x in np.flatnonzero(comp != largest):
        mine = term[begin[x] : begin[x] + size[x]]
        both = np.bincount(posted[K.ranges(at[mine], df[mine])], minlength=n)
        near = np.flatnonzero((both > 0) & (100 * both >= 75 * (size + size[x] - both)) & (comp != comp[x]))
        for y in near:
            if comp[y] != comp[x]:
                edges.append((int(nodes[x]), int(nodes[y])))
                comp[comp == comp[y]] = comp[x]
    return edges


def _link_groups(table: pa.Table) -> pa.Table:
    buf, offs = K.text_bytes(table.column("text"))
    row, code = shingle_sets(buf, offs)
    edges = link_group(table.column("node").to_numpy(), table.column("comp").to_numpy(), row, code)
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = ws.keep(texts.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, sa long, sb long, bands array<long>"), "sketch")

    # Identical sets are one node, named by the smallest id.
    same = ["sa", "sb", "n_shingles"]
    nodes = sk.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = ws.keep(nodes, "nodes")
    members = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    turn = F.xxhash64("node", "key")
    # Written: a join with an aggregate on its own key could not be split where a band is hot.
    hubs = members.groupBy("key").agg(F.count("*").alias("in_bucket"), F.min_by("node", turn).alias("hub"), F.min_by("n", turn).alias("hub_n"))
    buckets = ws.keep(hubs.filter("in_bucket > 1"), "buckets")
    shared = ws.keep(members.join(buckets, "key"), "shared")
    fits = "node <> hub and 100 * least(n, hub_n) >= 75 * greatest(n, hub_n)"
    pairs = shared.filter(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    text_of = texts.filter("doc_id is not null")
    with_texts = pairs.join(text_of.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").join(text_of.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")
    links = ws.keep(with_texts.select("a", "b", "ta", "tb").mapInArrow(_check_batches, "a long, b long"), "links")
    first = ws.keep(components(ws, links, "first"), "first")

    # Buckets of three or more nodes in several components: finish them exactly, one of each set of members.
    known = shared.filter("in_bucket > 2").join(first, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    known = ws.keep(known, "known")
    ws.drop("buckets", "shared")
    marks = known.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    open_keys = ws.keep(marks.filter("lo <> hi").groupBy("m", "total", "x", "y").agg(F.min("key").alias("key")), "open")
    # Only nodes outside a bucket's largest component are compared with all: they and the others lie in blocks of
    # their own, and a task is a pair of small blocks, or a small and a large one.
    unfinished = ws.keep(known.join(open_keys, "key"), "unfinished")
    ws.drop("known", "open")
    sizes = unfinished.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    largest = F.max_by(F.struct("comp", "m", "total"), F.struct("m", "comp"))
    per_key = sizes.groupBy("key").agg(largest.alias("big"), F.sum("m").alias("m"), F.sum("total").alias("total"))
    blocks = lambda m, total: F.greatest(F.lit(1), F.ceil(F.greatest(m / BLOCK_NODES, total / BLOCK_SHINGLES))).cast("int")
    plan = per_key.select("key", F.col("big.comp").alias("big_comp"), blocks(F.col("big.m"), F.col("big.total")).alias("bigs"), blocks(F.col("m") - F.col("big.m"), F.col("total") - F.col("big.total")).alias("smalls"))
    dealt = unfinished.join(ws.keep(plan, "plan"), "key").withColumn("small", F.col("comp") != F.col("big_comp"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("small"), F.col("smalls")).otherwise(F.col("bigs"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    i = F.col("i")
    with_big = F.transform(upto(F.col("bigs")), lambda b: pair("big", i, b))
    with_small = F.transform(F.array_remove(upto(F.col("smalls")), i), lambda k: pair("small", F.least(i, k), F.greatest(i, k)))
    of_big = F.transform(upto(F.col("smalls")), lambda k: pair("big", k, i))
    tasks = F.when(F.col("small"), F.concat(with_big, with_small)).otherwise(of_big)
    dealt = dealt.select("key", F.col("node").alias("id"), "comp", F.explode(tasks).alias("t")).select("id", "comp", F.xxhash64("key", "t").alias("task"))
    grouped = dealt.join(text_of, F.col("id") == F.col("doc_id")).select(F.col("id").alias("node"), "comp", "text", "task").groupBy("task")
    more = ws.keep(grouped.applyInArrow(_link_groups, "a long, b long"), "more")

    final = ws.keep(components(ws, first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "final"), "final")
    ws.drop("unfinished", "plan")
    classes = nodes.select(*same, "node").join(final, "node", "left").select(*same, F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component"))
    out = sk.select("doc_id", *same).join(classes, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
