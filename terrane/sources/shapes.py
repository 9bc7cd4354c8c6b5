"""Shapefiles and well-known binary.

Shapefile directories are read in two stages: the 100-byte headers give each
file's box, so that files outside the window are never decoded; the records of
the rest are decoded in Arrow batches, one file a task (the format has no
splits).  Attributes come from the .dbf beside each .shp; only asked columns are
decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.geometry import COLLECTION, LINESTRING, MULTILINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, SCHEMA
from terrane.functions.pieces import nested, ring_area

#: Record type codes of the format, by kind (plain, with Z, with M).
POINTS, LINES, POLYGONS, MULTIPOINTS = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)

_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.struct([("gtype", pa.int32()), ("parts", pa.list_(pa.list_(_VERTEX))), *[(k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax")]])
#: Arrow schema of shapefile rows.
ARROW_ROWS = pa.schema([("path", pa.string()), ("record", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("GEOMETRY", _SHAPE)])


def bounded(gtype: int, parts: list[list[tuple[float, float]]]) -> dict:
    flat = [v for p in parts for v in p]
    box = (min(v[0] for v in flat), min(v[1] for v in flat), max(v[0] for v in flat), max(v[1] for v in flat)) if flat else (None,) * 4
    return {"gtype": gtype, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts], "xmin": box[0], "ymin": box[1], "xmax": box[2], "ymax": box[3]}


def decode_shape(record: bytes) -> dict | None:
    """Geometry of one record; None for a null shape.  Z and M are dropped, as
    are vertices that repeat the one before."""
    kind = struct.unpack_from("<i", record)[0]
    if kind in POINTS:
        return bounded(POINT, [[struct.unpack_from("<2d", record, 4)]])
    if kind in MULTIPOINTS:
        n = struct.unpack_from("<i", record, 36)[0]
        return bounded(MULTIPOINT, [[struct.unpack_from("<2d", record, 40 + 16 * i)] for i in range(n)])
    if kind in LINES or kind in POLYGONS:
        n_parts, n = struct.unpack_from("<2i", record, 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
        flat = struct.unpack_from(f"<{2 * n}d", record, 44 + 4 * n_parts)
        parts = []
        for a, b in zip(starts, starts[1:], strict=False):
            part: list[tuple[float, float]] = []
            for i in range(a, b):
                v = (flat[2 * i], flat[2 * i + 1])
                if not part or part[-1] != v:
                    part.append(v)
            parts.append(part)
        if kind in POLYGONS:
            # The format's outer rings run clockwise, and rings come in any order.
            polygons = nested([np.array(p) for p in parts if len(p) > 3])
            return bounded(MULTIPOLYGON if len(polygons) > 1 else POLYGON, [[(x, y) for x, y in r.tolist()] for p in polygons for r in p])
        return bounded(LINESTRING if len(parts) == 1 else MULTILINESTRING, parts)
    return None


def decode_dbf(content: bytes, columns: list[str] | None, encoding: str) -> list[dict[str, str] | None]:
    """Field texts of every row; None for deleted rows."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at, place = [], 32, 1
    while at + 32 <= head and content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode(encoding)
        kind, width = chr(content[at + 11]), content[at + 16]
        if columns is None or name in columns:
            fields.append((name, kind, place, width))
        place += width
        at += 32
    rows: list[dict[str, str] | None] = []
    for i in range(n):
        row = content[head + i * size : head + (i + 1) * size]
        if row[:1] == b"*":
            rows.append(None)
            continue
        values = {}
        for name, kind, a, width in fields:
            text = row[a : a + width].decode(encoding, "replace").strip()
            if kind in "NF":
                try:
                    float(text)
                except ValueError:
                    text = "0"
            elif kind == "L":
                text = "1" if text[:1] in ("y", "Y", "t", "T") and text else "0"
            values[name] = text
        rows.append(values)
    return rows


def _records(content: bytes) -> Iterator[bytes]:
    at = 100
    while at + 8 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        yield content[at + 8 : at + 8 + size]
        at += 8 + size


def shapefile_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape_type, xmin, ymin, xmax, ymax) of each .shp."""

    def run(batches):
        for pdf in batches:
            heads = [struct.unpack_from("<i4d", bytes(c), 32) for c in pdf["head"]]
            yield type(pdf)({"path": pdf["path"], "shape_type": [h[0] for h in heads], **{k: [h[i + 1] for h in heads] for i, k in enumerate(("xmin", "ymin", "xmax", "ymax"))}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path)
    return files.select("path", F.substring("content", 1, 100).alias("head")).mapInPandas(run, "path string, shape_type int, xmin double, ymin double, xmax double, ymax double")


def read_shapefiles(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, record, attributes map, GEOMETRY).  With a bbox, files and shapes
    whose boxes miss it are skipped (null shapes stay)."""
    base = F.regexp_replace("path", r"\.[^.]*$", "")
    files = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(base.alias("base"), "content")
    shp = files("*.shp").withColumnRenamed("content", "shp")
    if bbox:
        head = shapefile_headers(spark, path)
        inside = head.filter((F.col("xmin") <= bbox[2]) & (F.col("xmax") >= bbox[0]) & (F.col("ymin") <= bbox[3]) & (F.col("ymax") >= bbox[1]))
        shp = shp.join(inside.select(base.alias("base")), "base", "left_semi")
    both = shp.join(files("*.dbf").withColumnRenamed("content", "dbf"), "base", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, table in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                rows = [r for r in decode_dbf(table, columns, encoding) if r is not None] if table else None
                out = []
                for i, record in enumerate(_records(content)):
                    g = decode_shape(record)
                    if g is not None and bbox and (g["xmin"] is None or g["xmin"] > bbox[2] or g["xmax"] < bbox[0] or g["ymin"] > bbox[3] or g["ymax"] < bbox[1]):
                        continue
                    out.append({"path": name, "record": i, "attributes": list((rows[i] if rows and i < len(rows) else {}).items()), "GEOMETRY": g})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROWS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROWS)

    return both.select("base", "shp", "dbf").mapInArrow(run, f"path string, record long, attributes map<string,string>, GEOMETRY {SCHEMA}")


def _read_wkb(data: bytes, at: int) -> tuple[int, list[list[tuple[float, float]]], int]:
    end = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(f"{end}I", data, at + 1)[0]
    at += 5
    if kind == 1:
        return kind, [[struct.unpack_from(f"{end}2d", data, at)]], at + 16
    n = struct.unpack_from(f"{end}I", data, at)[0]
    at += 4
    parts: list[list[tuple[float, float]]] = []
    if kind == 2:
        flat = struct.unpack_from(f"{end}{2 * n}d", data, at)
        return kind, [list(zip(flat[::2], flat[1::2], strict=True))], at + 16 * n
    if kind == 3:
        for _ in range(n):
            m = struct.unpack_from(f"{end}I", data, at)[0]
            flat = struct.unpack_from(f"{end}{2 * m}d", data, at + 4)
            ring = list(zip(flat[::2], flat[1::2], strict=True))
            # The first ring is the outer one; it runs counter-clockwise here, its holes clockwise.
            turned = (ring_area(np.array(ring)) < 0) == (not parts) if len(ring) > 3 else False
            parts.append(ring[::-1] if turned else ring)
            at += 4 + 16 * m
        return kind, parts, at
    if kind in (4, 5, 6, 7):
        for _ in range(n):
            _, more, at = _read_wkb(data, at)
            parts += more
        return kind, parts, at
    raise ValueError(f"unknown geometry type {kind}")


def decode_wkb(data: bytes) -> dict:
    """Geometry of well-known binary of either byte order, types 1 to 6 (a
    collection's members' parts are put together)."""
    if len(data) < 21:
        raise ValueError("well-known binary is too short")
    kind, parts, _ = _read_wkb(data, 0)
    return bounded(kind, parts)


def decode_members(data: bytes) -> list[dict]:
    """Members of well-known binary of any type, those of inner collections in
    their place."""

    def read(at: int) -> tuple[list[dict], int]:
        end = "<" if data[at] == 1 else ">"
        if struct.unpack_from(f"{end}I", data, at + 1)[0] != COLLECTION:
            kind, parts, at = _read_wkb(data, at)
            hollow = kind == POINT and parts[0][0][0] != parts[0][0][0]
            return [bounded(kind, [] if hollow else parts)], at
        n, members = struct.unpack_from(f"{end}I", data, at + 5)[0], []
        at += 9
        for _ in range(n):
            more, at = read(at)
            members += more
        return members, at

    return read(0)[0]


def from_wkb_members(df: DataFrame, column: str, to: str) -> DataFrame:
    """The frame with an array of the members of well-known binary; null stays null."""

    @F.pandas_udf(f"array<{SCHEMA}>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: decode_members(bytes(v)) if v is not None else None)

    return df.withColumn(to, decode(column))


def from_wkb(df: DataFrame, column: str, to: str) -> DataFrame:
    """The frame with a geometry column decoded in Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def decode(s: pd.Series) -> pd.DataFrame:
        empty = {"gtype": None, "parts": None, "xmin": None, "ymin": None, "xmax": None, "ymax": None}
        return pd.DataFrame([decode_wkb(bytes(v)) if v is not None else empty for v in s], columns=list(empty))

    return df.withColumn(to, decode(column))


def encode_wkb(gtype: int, parts: list[list[dict]]) -> bytes:
    """Well-known binary (little-endian) of points, lines, polygons and their
    collections of one kind; an empty point has coordinates that are no numbers.
    Mixed collections have no members in the geometry column and are refused."""
    if gtype not in (POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON):
        raise ValueError(f"no well-known binary of geometry type {gtype}")
    if gtype == POINT and not parts:
        parts = [[{"x": float("nan"), "y": float("nan")}]]
    if gtype == LINESTRING and not parts:
        parts = [[]]
    pairs = lambda p: b"".join(struct.pack("<2d", v["x"], v["y"]) for v in p)
    head = lambda kind, n=None: struct.pack("<BI", 1, kind) + (b"" if n is None else struct.pack("<I", n))
    rings = lambda ps: b"".join(struct.pack("<I", len(p)) + pairs(p) for p in ps)
    if gtype == POINT:
        return head(1) + pairs(parts[0])
    if gtype == LINESTRING:
        return head(2, len(parts[0])) + pairs(parts[0])
    if gtype == POLYGON:
        return head(3, len(parts)) + rings(parts)
    if gtype == MULTIPOINT:
        return head(4, len(parts)) + b"".join(head(1) + pairs(p) for p in parts)
    if gtype == MULTILINESTRING:
        return head(5, len(parts)) + b"".join(head(2, len(p)) + pairs(p) for p in parts)
    polygons: list[list[list[dict]]] = []
    for p in parts:
        if not polygons or ring_area(np.array([(v["x"], v["y"]) for v in p])) > 0:
            polygons.append([])
        polygons[-1].append(p)
    return head(6, len(polygons)) + b"".join(head(3, len(ps)) + rings(ps) for ps in polygons)


def _encode(g: dict | list[dict]) -> bytes:
    if isinstance(g, dict):
        return encode_wkb(g["gtype"], g["parts"])
    return struct.pack("<BII", 1, COLLECTION, len(g)) + b"".join(encode_wkb(m["gtype"], m["parts"]) for m in g)


def to_wkb(df: DataFrame, column: str, to: str) -> DataFrame:
    """The frame with a geometry column, or an array of the members of a
    collection, written as well-known binary; null stays null."""
    kept = [c for c in df.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_encode(g) if g is not None else None for g in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(data, pa.binary())], names=[*kept, to])

    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(to, T.BinaryType())])
    return df.mapInArrow(run, schema)
