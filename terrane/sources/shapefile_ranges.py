"""Shapefiles as a Spark data source: ranges of one file in many tasks.

``spark.read.format("shapefile").load(folder)`` plans ranges of records from the
size of each .shx (8 bytes a record); a task reads its part of the .shx, the
bytes of the .shp that it names and the rows of the .dbf that go with them, in
blocks.  Files whose box misses the asked one are never planned, and records
whose box misses it are not decoded.  ``df.write.format("shapefile")`` writes
sets of .shp, .shx and .dbf, each bounded in size.

Both sides open files through Arrow's file systems, so the folder is a path or
URI that those know.  ``shapes.read_shapefiles`` reads whole files from whatever
Spark reads.

A shape's attributes are those of the row of the .dbf with its number among the
rows that are not deleted.  Where a range of shapes begins in the .dbf is thus
known only after the deleted rows before it are counted: ``read_shapefile_ranges``
counts them in a job of its own and hands on the numbers of the ranges that have
any, so that each task is given the place of its first row and reads no other
range's rows.  Without them a task counts by itself, which reads the .dbf up to
its range.

Defined results: null shapes have a null geometry and are never skipped; a
missing .dbf, or one with fewer rows, gives no attributes; a file without .shx is
one task; empty files and folders give no rows; numbers that do not parse are 0.
Written numbers are decimal text; null is blank, and is read as 0 or "".
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from terrane.functions.geometry import LINESTRING, MULTILINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, SCHEMA
from terrane.sources.shapes import ARROW_ROWS, LINES, POINTS, decode_dbf, decode_shape

#: Bytes of a .shp (or .dbf) that a task reads, bytes it holds at a time, and bytes of a written .shp.
RANGE_BYTES, BLOCK_BYTES, FILE_BYTES = 32 << 20, 4 << 20, 64 << 20
BATCH_ROWS = 1000
HEAD = 100
#: The format's type of each geometry type.
SHAPE_TYPE = {POINT: 1, LINESTRING: 3, MULTILINESTRING: 3, POLYGON: 5, MULTIPOLYGON: 5, MULTIPOINT: 8}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; ``file:/x``, as Hadoop writes it, is ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    system, where = opened(path)
    found = system.get_file_info(fs.FileSelector(where)) if system.get_file_info(where).type == fs.FileType.Directory else [system.get_file_info(where)]
    if len(found) == 1 and found[0].path == where:
        base = where.rsplit(".", 1)[0]
        found = system.get_file_info([f"{base}.{e}" for e in ("shp", "shx", "dbf")])
    return {f.path: f.size for f in found if f.type == fs.FileType.File}


def _box(text: str | None) -> tuple[float, ...] | None:
    return tuple(json.loads(text)) if text else None


def _misses(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return a[0] > b[2] or a[2] < b[0] or a[1] > b[3] or a[3] < b[1]


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` of a file (None: to its end, read in order),
    whose attributes begin at the live row ``skip`` after ``place`` of the .dbf."""

    base: str
    first: int
    last: int | None
    dbf: bool
    place: int = 0
    skip: int = 0


class _Places:
    """Where live rows lie in a .dbf, by the stretches (first row, rows, deleted) that have deleted rows."""

    def __init__(self, marks: list[tuple[int, int, int]]):
        self.marks, self.gone = marks, [0, *accumulate(m[2] for m in marks)]
        self.live = [m[0] - gone for m, gone in zip(marks, self.gone, strict=False)]

    def of(self, number: int) -> tuple[int, int]:
        """A place from which the live row with that number is so many live rows away."""
        i = bisect_right(self.live, number) - 1
        if i >= 0 and number < self.live[i] + self.marks[i][1] - self.marks[i][2]:
            return self.marks[i][0], number - self.live[i]
        return number + self.gone[i + 1], 0


def _cuts(n: int, size: int, most: int) -> list[tuple[int, int]]:
    parts = max(1, min(n, -(-size // most)))
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)] if n else []


class _Table:
    """Rows of a .dbf by their place in the file."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        n, head, self.size = struct.unpack("<IHH", self.file.read_at(8, 4))
        self.head = bytearray(self.file.read_at(head, 0))
        self.rows = min(n, (self.file.size() - head) // self.size) if self.size else 0

    def blocks(self, first: int, last: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows as bytes, which of them are not deleted) of rows first .. last, at most ``most`` at a time."""
        step = max(1, min(BLOCK_BYTES // self.size, most or BLOCK_BYTES)) if self.size else 1
        for a in range(first, last, step):
            n = min(step, last - a)
            rows = np.frombuffer(self.file.read_at(n * self.size, len(self.head) + a * self.size), np.uint8).reshape(n, self.size)
            yield rows, rows[:, 0] != ord("*")

    def live(self, part: Range, columns: list[str] | None, encoding: str) -> Iterator[dict[str, str]]:
        """A range's rows that are not deleted, as many as it has records."""
        skip, left = part.skip, self.rows if part.last is None else part.last - part.first
        for rows, kept in self.blocks(part.place, self.rows, max(skip + left, 256)):
            mine = rows[kept][skip : skip + left]
            if len(mine):
                struct.pack_into("<I", self.head, 4, len(mine))
                yield from decode_dbf(bytes(self.head) + mine.tobytes(), columns, encoding)
            skip, left = max(0, skip - int(kept.sum())), left - len(mine)
            if not left:
                return


def _records(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(number, content) of a range's records, a block of bytes at a time."""
    if part.last is None:
        with system.open_input_stream(f"{part.base}.shp", buffer_size=BLOCK_BYTES) as stream:
            stream.read(HEAD)
            n = 0
            while len(head := stream.read(8)) == 8:
                yield n, stream.read(struct.unpack(">i", head[4:])[0] * 2)
                n += 1
        return
    with system.open_input_file(f"{part.base}.shx") as index, system.open_input_file(f"{part.base}.shp") as file:
        for a in range(part.first, part.last, BLOCK_BYTES // 8):
            b = min(part.last, a + BLOCK_BYTES // 8)
            # 16-bit words in the index; a record has a head of 8 bytes.
            at, size = np.frombuffer(index.read_at(8 * (b - a), HEAD + 8 * a), ">i4").reshape(-1, 2).astype(np.int64).T * 2
            begin = 0
            while begin < b - a:
                end = begin + 1
                while end < b - a and at[end] == at[end - 1] + 8 + size[end - 1] and at[end] + 8 + size[end] - at[begin] <= BLOCK_BYTES:
                    end += 1
                block = file.read_at(int(at[end - 1] + 8 + size[end - 1] - at[begin]), int(at[begin]))
                for i in range(begin, end):
                    o = int(at[i] - at[begin]) + 8
                    yield a + i, block[o : o + int(size[i])]
                begin = end


def _record_box(record: bytes) -> tuple[float, ...] | None:
    kind = struct.unpack_from("<i", record)[0] if len(record) >= 4 else 0
    if kind in POINTS:
        return struct.unpack_from("<2d", record, 4) * 2
    return struct.unpack_from("<4d", record, 4) if kind else None


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], rows_only: bool):
        self.path, self.rows_only = options["path"], rows_only
        self.bbox, self.encoding = _box(options.get("bbox")), options.get("encoding", "ISO-8859-1")
        self.columns = json.loads(options["columns"]) if options.get("columns") else None
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.marks = json.loads(options["marks"]) if options.get("marks") else None

    def __getstate__(self) -> dict:
        # Tasks are given their places; the numbers of all files stay where ranges are planned.
        return {**self.__dict__, "marks": None}

    def partitions(self) -> list[Range]:
        system, _ = opened(self.path)
        sizes, found = _sizes(self.path), []
        for name in sorted(n for n in sizes if n.endswith(".shp")):
            base = name[:-4]
            has = f"{base}.dbf" in sizes
            with system.open_input_file(name) as file:
                head = file.read_at(HEAD, 0)
            if len(head) < HEAD or (self.bbox and _misses(struct.unpack_from("<4d", head, 36), self.bbox)):
                continue
            if self.rows_only:
                if has:
                    # A task counts many ranges: that takes far less time than to decode one.
                    found += [Range(base, a, b, True) for a, b in _cuts(_Table(system, f"{base}.dbf").rows, sizes[f"{base}.dbf"], max(self.bytes, RANGE_BYTES))]
                continue
            places = None if self.marks is None else _Places(self.marks.get(base, []))
            if f"{base}.shx" in sizes:
                n = (sizes[f"{base}.shx"] - HEAD) // 8
                found += [Range(base, a, b, has, *(places.of(a) if places else (0, a))) for a, b in _cuts(n, sizes[name], self.bytes)]
            else:
                found.append(Range(base, 0, None, has))
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        system, _ = opened(self.path)
        if self.rows_only:
            table, first, counts = _Table(system, f"{part.base}.dbf"), part.first, []
            for _, kept in table.blocks(part.first, part.last, max(1, self.bytes // max(1, table.size))):
                counts.append({"base": part.base, "first": first, "rows": len(kept), "deleted": len(kept) - int(kept.sum())})
                first += len(kept)
            yield pa.RecordBatch.from_pylist(counts, schema=pa.schema([("base", pa.string()), ("first", pa.int64()), ("rows", pa.int64()), ("deleted", pa.int64())]))
            return
        rows = _Table(system, f"{part.base}.dbf").live(part, self.columns, self.encoding) if part.dbf else iter(())
        out, held = [], 0
        for n, record in _records(system, part):
            row = next(rows, None)
            box = _record_box(record)
            if self.bbox and box and _misses(box, self.bbox):
                continue
            out.append({"path": part.base, "record": n, "attributes": list((row or {}).items()), "GEOMETRY": decode_shape(record)})
            held += len(record)
            if len(out) == BATCH_ROWS or held > BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROWS)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROWS)


def encode_shape(g) -> tuple[bytes, tuple[float, ...] | None]:
    """A record's content and box.  The format's outer rings run clockwise."""
    flat = [(v.x, v.y) for p in g.parts for v in p] if g is not None and g.parts else []
    if not flat:
        return struct.pack("<i", 0), None
    kind = SHAPE_TYPE[g.gtype]
    if kind == 1:
        return struct.pack("<i2d", 1, *flat[0]), flat[0] * 2
    box = (min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat))
    if kind == 8:
        return struct.pack("<i4di", 8, *box, len(flat)) + np.array(flat, "<f8").tobytes(), box
    parts = [np.array([(v.x, v.y) for v in p], "<f8")[:: -1 if kind == 5 else 1] for p in g.parts]
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
    return struct.pack("<i4d2i", kind, *box, len(parts), len(flat)) + starts.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts), box


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Set:
    """One .shp with its .shx and .dbf, held until it is full."""

    def __init__(self):
        self.shp, self.shx, self.dbf, self.n, self.box = bytearray(), bytearray(), bytearray(), 0, None

    def add(self, record: bytes, box: tuple[float, ...] | None, row: bytes) -> None:
        self.shx += struct.pack(">2i", (HEAD + len(self.shp)) // 2, len(record) // 2)
        self.shp += struct.pack(">2i", self.n + 1, len(record) // 2) + record
        self.dbf += row
        self.n += 1
        if box:
            b = self.box or box
            self.box = (min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3]))


class RangeWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.key = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.encoding, self.bytes = options.get("encoding", "ISO-8859-1"), int(options.get("filebytes", FILE_BYTES))
        self.geometry = options.get("geometry", "GEOMETRY")
        self.fields = [(f.name, *self._field(f.dataType, int(options.get("width", 100)))) for f in schema.fields if f.name != self.geometry]
        if any(len(n.encode(self.encoding)) > 10 for n, _, _ in self.fields):
            raise ValueError("names of .dbf fields have at most 10 bytes")

    @staticmethod
    def _field(kind: T.DataType, width: int) -> tuple[str, int]:
        if isinstance(kind, T.BooleanType):
            return "L", 1
        return ("N", 40 if isinstance(kind, T.DecimalType) else 25) if isinstance(kind, T.NumericType) else ("C", min(width, 254))

    def _row(self, row) -> bytes:
        out = b" "
        for name, kind, width in self.fields:
            v = row[name]
            text = "" if v is None else ("T" if v else "F") if kind == "L" else str(v)
            data = text.encode(self.encoding)
            if len(data) > width:
                raise ValueError(f"{name} has {len(data)} bytes, its field {width}: set the option width (at most 254)")
            out += data.rjust(width) if kind == "N" else data.ljust(width)
        return out

    def _save(self, system: fs.FileSystem, name: str, kind: int, made: _Set) -> None:
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *(made.box or (0,) * 4), 0, 0, 0, 0)
        fields = b"".join(n.encode(self.encoding).ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w]) + bytes(15) for n, k, w in self.fields)
        table = struct.pack("<4BIHH20x", 3, 126, 1, 1, made.n, 33 + len(fields), 1 + sum(w for _, _, w in self.fields)) + fields + b"\r"
        for end, data in (("shp", head(HEAD + len(made.shp)) + made.shp), ("shx", head(HEAD + len(made.shx)) + made.shx), ("dbf", table + made.dbf + b"\x1a")):
            with system.open_output_stream(f"{name}.{end}") as out:
                out.write(bytes(data))

    def write(self, rows: Iterator[T.Row]) -> Written:
        """Sets of files, one kind of shape each, under a name that commit takes away."""
        system, where = opened(self.path)
        task, open_sets, names = uuid.uuid4().hex[:12], {}, []
        system.create_dir(f"{where}/_writing-{self.key}", recursive=True)

        def save(kind: int) -> None:
            names.append(f"part-{task}-{len(names)}")
            self._save(system, f"{where}/_writing-{self.key}/{names[-1]}", kind, open_sets.pop(kind))

        for row in rows:
            g = row[self.geometry]
            record, box = encode_shape(g)
            kind = SHAPE_TYPE[g.gtype] if box else next(iter(open_sets), 5)
            made = open_sets.setdefault(kind, _Set())
            made.add(record, box, self._row(row))
            if len(made.shp) + len(made.dbf) >= self.bytes:
                save(kind)
        for kind in list(open_sets):
            save(kind)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = opened(self.path)
        system.create_dir(where, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(where)):
                if f.path.endswith((".shp", ".shx", ".dbf")):
                    system.delete_file(f.path)
        # The .shp last: a set is seen when it is whole.
        for name in [n for m in messages if m for n in m.names]:
            for end in ("dbf", "shx", "shp"):
                system.move(f"{where}/_writing-{self.key}/{name}.{end}", f"{where}/{name}.{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, where = opened(self.path)
        if system.get_file_info(f"{where}/_writing-{self.key}").type == fs.FileType.Directory:
            system.delete_dir(f"{where}/_writing-{self.key}")


class ShapefileSource(DataSource):
    """Options: bbox (JSON list), columns (JSON list), encoding, rangeBytes, marks;
    for writing geometry, width, fileBytes, encoding."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return f"path string, record long, attributes map<string,string>, GEOMETRY {SCHEMA}"

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(dict(self.options), False)

    def writer(self, schema: T.StructType, overwrite: bool) -> RangeWriter:
        return RangeWriter(schema, dict(self.options), overwrite)


class ShapefileRows(DataSource):
    """(base, first, rows, deleted): how many rows of each range of a .dbf are deleted."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_rows"

    def schema(self) -> str:
        return "base string, first long, rows long, deleted long"

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(dict(self.options), True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(ShapefileRows)


def read_shapefile_ranges(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, encoding: str = "ISO-8859-1", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path without ending, record, attributes, GEOMETRY), as ``read_shapefiles``
    gives them, in tasks of about ``range_bytes`` of a file.  What reaches the
    driver is the numbers of each such range of a .dbf that has deleted rows."""
    register(spark)
    options = {"rangeBytes": str(range_bytes), "encoding": encoding} | ({"bbox": json.dumps(bbox)} if bbox else {})
    marks: dict[str, list[tuple[int, int, int]]] = {}
    # Sorted here: to order them on Spark would count twice, once for a sample.
    for r in sorted(spark.read.format("shapefile_rows").options(**options).load(path).filter("deleted > 0").collect()):
        marks.setdefault(r.base, []).append((r.first, r.rows, r.deleted))
    options |= {"marks": json.dumps(marks)} | ({"columns": json.dumps(columns)} if columns is not None else {})
    return spark.read.format("shapefile").options(**options).load(path)


def write_shapefiles(df: DataFrame, path: str, geometry: str = "GEOMETRY", mode: str = "append", **options) -> None:
    """Sets of .shp, .shx and .dbf with a field for every other column."""
    register(df.sparkSession)
    df.write.format("shapefile").options(geometry=geometry, **{k: str(v) for k, v in options.items()}).mode(mode).save(path)
