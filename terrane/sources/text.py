"""Delimited, multi-line and whole-file text sources, and text sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_text_features(spark: SparkSession, path: str, delimiter: str | None = None, comment: str = "#", encoding: str = "UTF-8") -> DataFrame:
    """Lines as fields ``$0`` (the whole line), ``$1`` ...  Without a delimiter
    fields are separated by runs of white space; with one, empty fields count.
    Lines that start with the comment are left out; short lines are padded with
    empty fields to the widest line."""
    lines = spark.read.option("encoding", encoding).text(path) if encoding == "UTF-8" else spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").csv(path, schema="value string")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    parts = F.split("value", re.escape(delimiter)) if delimiter else F.filter(F.split("value", r"\s+"), lambda s: s != "")
    rows = lines.select("value", parts.alias("p"))
    width = rows.agg(F.max(F.size("p"))).first()[0] or 0
    return rows.select(F.col("value").alias("$0"), *[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(f"${i + 1}") for i in range(width)])


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, line): lines in their file's order by (block, at).

    A file is read in splits; ``block`` is the byte where the line's split
    begins, and ``at`` grows along a task's lines.  Both depend on the files
    and the session's split size alone, so a lost task's lines come back with
    the same places.
    """
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _earlier(splits: DataFrame, total: str) -> DataFrame:
    """splits with ``before``, the sum of ``total`` over their file's earlier splits.  One row a split: as
    many as the driver plans, so that it is sent to all tasks and no line is shuffled."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(splits.withColumn("before", F.coalesce(F.sum(total).over(earlier), F.lit(0))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) with each line's place in its file, from 0.  Lines end
    with a newline, a carriage return or both; files are read in splits, in each
    of which ``at`` grows by one a line."""
    lines = _placed_lines(spark, path)
    splits = _earlier(lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")), "n")
    return lines.join(splits, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "line")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, n, header, lines) of a task's lines (path, block, head, line),
    which come in the order of its splits: what each split has of a stanza, with
    the number of the split's headers up to it.  Lines before a split's first
    header are number 0, without a header.  One stanza is held at a time."""
    split, n, top, held = None, 0, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block, line = batch.column("path"), batch.column("block").to_numpy(), batch.column("line")
        head = batch.column("head").to_numpy() == 1
        code = path.dictionary_encode().indices.to_numpy()
        turn = np.append((path[0].as_py(), block[0]) != split, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))
        at = np.flatnonzero(head | turn)
        body = line.filter(pa.array(~head))
        if not len(at):
            held.append(body)
            continue
        # Where each stanza's lines begin among those that are no headers.
        begins = (np.cumsum(~head) - ~head)[at]
        heads = np.cumsum(head)
        turned = np.maximum.accumulate(np.where(turn, np.arange(len(turn)), -1))[at]
        number = heads[at] - np.where(turned < 0, -n, heads[turned] - head[turned])
        made = pa.record_batch([
            path.take(pa.array(at)), pa.array(block[at]), pa.array(number.astype(np.int64)), pc.if_else(pa.array(head[at]), line.take(pa.array(at)), pa.scalar(None, line.type)),
            pa.ListArray.from_arrays(pa.array(np.append(begins, len(body)).astype(np.int32)), body),
        ], names=["path", "block", "n", "header", "lines"])
        if top is not None:
            yield _closed(top, [*held, body.slice(0, int(begins[0]))])
        yield made.slice(0, len(at) - 1)
        # The last one may go on in the next batch.
        top, held = made.slice(len(at) - 1, 1), [body.slice(int(begins[-1]))]
        split, n = (path[len(path) - 1].as_py(), block[-1]), int(number[-1])
    if top is not None:
        yield _closed(top, held)


def _closed(top: pa.RecordBatch, lines: list[pa.Array]) -> pa.RecordBatch:
    body = pa.concat_arrays(lines)
    return top.set_column(4, "lines", pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), body))


def read_stanzas(spark: SparkSession, path: str, is_header: Column) -> DataFrame:
    """(path, stanza, header, lines): each header line with the lines after it.

    is_header: a condition on the column ``line``.  Blank lines are left out,
    as are lines before a file's first header; a header without lines has an
    empty array.  Files are read in splits, whose tasks put their stanzas
    together as the lines come.  A stanza's number is the number of headers up to
    it; only what crosses a split's border is shuffled, and put together by its
    number.
    """
    lines = _placed_lines(spark, path).filter(F.trim("line") != "").withColumn("head", F.coalesce(is_header.cast("int"), F.lit(0)))
    splits = _earlier(lines.groupBy("path", "block").agg(F.sum("head").alias("heads")), "heads")
    parts = lines.select("path", "block", "head", "line").mapInArrow(_gathered, "path string, block long, n long, header string, lines array<string>")
    placed = parts.join(splits, ["path", "block"]).withColumn("stanza", F.col("n") + F.col("before")).filter("stanza > 0")
    whole = placed.filter("n > 0 and n < heads").select("path", "stanza", "header", "lines")
    pieces = F.array_sort(F.collect_list(F.struct("block", "lines")))
    border = placed.filter("n = 0 or n = heads").groupBy("path", "stanza").agg(F.max("header").alias("header"), F.flatten(F.transform(pieces, lambda s: s["lines"])).alias("lines"))
    return whole.unionByName(border)


def stanza_vertices(lines: Column, scale: float = 1.0) -> Column:
    """Array of (x, y) of lines that start with two numbers."""
    part = lambda s, i: F.get(F.filter(F.split(s, r"[\s,]+"), lambda t: t != ""), i).try_cast("double") * scale
    return F.transform(lines, lambda s: F.struct(part(s, 0).alias("x"), part(s, 1).alias("y")))


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of whole files; compressed ones by their suffix."""
    if encoding == "UTF-8":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("text"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the first entry of each zip file: one task a file, since
    a zip file cannot be split."""
    import io
    import zipfile

    def run(batches):
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = z.namelist()
                    texts.append(z.read(names[0]).decode("utf-8", "replace") if names else "")
            yield type(pdf)({"path": pdf["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def write_lines(df: DataFrame, path: str, *columns: str) -> None:
    """One line a row: the columns with a space between them."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, geom: str, properties: list[str], identifier: str | None = None) -> None:
    """One feature a line."""
    from terrane.functions.geometry import to_geojson

    feature = to_geojson(geom, F.struct(*properties) if properties else None, F.col(identifier) if identifier else None)
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def read_jdbc(spark: SparkSession, url: str, sql: str, key: str | None = None, bounds: tuple[float, float] | None = None, parts: int = 1, **properties: str) -> DataFrame:
    """Rows of a query that the database runs itself.  With a whole-number, date
    or time column as ``key`` it is run in ``parts`` ranges of it, one a task;
    ``bounds`` place the ranges only, rows outside them (and nulls) come too."""
    read = spark.read.format("jdbc").option("url", url).options(**properties)
    if key is None:
        return read.option("query", sql).load()
    if bounds is None:
        raise ValueError("ranges of a key need bounds")
    ranges = {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts}
    return read.options(**ranges).option("dbtable", f"({sql}) ranged").load()
