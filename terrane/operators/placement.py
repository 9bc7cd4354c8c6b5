"""Choosing label positions that do not conflict, in parallel.

Sequential greedy placement gives each row, in order of priority, its first
candidate box that no accepted box meets.  The same result comes from tiles.  A
task streams a tile's rows in order beside the boxes already taken there.  A row
that lies in the tile alone is settled as soon as its first candidate that is not
lost meets no box that an earlier, still open row may yet take; rows over a
tile's border, and those that wait for them, stay open.  Each round doubles the
tiles and shifts them by half a tile, so that the borders of one round lie inside
the tiles of the next, and a chain of conflicts costs a round only where it
leaves a tile, not for each of its rows.  One tile over everything ends it.

Pairs of boxes in conflict are never listed: boxes are looked up in cells of
their own size, accepted ones share no area, and open ones beyond a number in a
cell close the whole cell for the round.
"""

from __future__ import annotations

import math
from typing import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.workspace import Workspace

#: Boxes that a tile of the first round holds on average.
TILE_BOXES = 50_000
#: Tiles do not grow while one would hold more open boxes than this.
MOST_OPEN = 2_000_000
#: Open boxes of a cell that are told apart; beyond them the cell is closed for the round.
CELL_BOXES = 64
_OPEN, _TAKEN, _MORE = 1, 2, 3
_BOX, _ROW = ["x0", "y0", "x1", "y1"], ["bx0", "by0", "bx1", "by1"]


class _Boxes:
    """Boxes by cells of about their own size (a level of cells for each power
    of two).  With ``coarse``, a crowded cell answers for all its area."""

    def __init__(self, cell: float, coarse: bool):
        self.cell, self.coarse, self.levels = cell, coarse, {}

    def _range(self, box, level: int):
        w = self.cell * 2.0**level
        return math.floor(box[0] / w), math.floor(box[1] / w), math.floor(box[2] / w), math.floor(box[3] / w)

    def add(self, box) -> None:
        size = max(box[2] - box[0], box[3] - box[1])
        level = max(0, math.ceil(math.log2(size / self.cell))) if size > 0 else 0
        cells = self.levels.setdefault(level, {})
        i0, j0, i1, j1 = self._range(box, level)
        for key in ((i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)):
            found = cells.setdefault(key, [])
            if found is not None and box not in found[:CELL_BOXES]:
                if self.coarse and len(found) == CELL_BOXES:
                    cells[key] = None
                else:
                    found.append(box)

    def meets(self, box) -> bool:
        """Whether a box shares area with one of these; touching is no conflict."""
        for level, cells in self.levels.items():
            i0, j0, i1, j1 = self._range(box, level)
            if (i1 - i0 + 1) * (j1 - j0 + 1) <= len(cells):
                keys: Iterable = ((i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1))
            else:
                keys = [k for k in cells if i0 <= k[0] <= i1 and j0 <= k[1] <= j1]
            for key in keys:
                found = cells.get(key, ())
                if found is None or any(box[0] < b[2] and box[2] > b[0] and box[1] < b[3] and box[3] > b[1] for b in found):
                    return True
        return False


def _candidates(records):
    """Runs of records with one (r, c), which sorting has put together."""
    run: list = []
    for record in records:
        if run and record["c"] != run[0]["c"]:
            yield run
            run = []
        run.append(record)
    yield run


def _settle_row(records, taken: _Boxes, waiting: _Boxes):
    """What is left of a row: (record, state) of its place or its open candidates."""
    box = lambda record: tuple(record[k] for k in _BOX)
    left: list = []
    for run in _candidates(records):
        boxes = [box(record) for record in run]
        if any(taken.meets(b) for b in boxes):
            continue
        if run[0]["inner"] and not left and not any(waiting.meets(b) for b in boxes):
            for b in boxes:
                taken.add(b)
            return [(record, _MORE if n else _TAKEN) for n, record in enumerate(run)]
        left += run
    for record in left:
        waiting.add(box(record))
    return [(record, _OPEN) for record in left if record["home"]]


def _settle(cell: float, schema: pa.Schema):
    """One pass over records sorted by tile, state, row and choice."""

    def records(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def packed(rows):
        return pa.RecordBatch.from_pylist([{**{k: record[k] for k in schema.names}, "state": state} for record, state in rows], schema=schema)

    def run(batches):
        tile, row, out = None, [], []
        taken = waiting = None
        for record in records(batches):
            if row and (record["r"] != row[0]["r"] or (record["tx"], record["ty"]) != tile or not record["state"]):
                out += _settle_row(row, taken, waiting)
                row = []
            if (record["tx"], record["ty"]) != tile:
                tile, taken, waiting = (record["tx"], record["ty"]), _Boxes(cell, False), _Boxes(cell, True)
            if record["state"]:
                row.append(record)
            else:
                taken.add(tuple(record[k] for k in _BOX))
            if len(out) >= 8192:
                yield packed(out)
                out = []
        if row:
            out += _settle_row(row, taken, waiting)
        yield packed(out)

    return run


def _tiled(df: DataFrame, size: float, ox: float, oy: float) -> DataFrame:
    """A record for each tile that the whole row's box meets."""
    at = lambda c, o: F.floor((F.col(c) - o) / size)
    first = df.withColumn("i0", at("bx0", ox)).withColumn("j0", at("by0", oy)).withColumn("i1", at("bx1", ox)).withColumn("j1", at("by1", oy))
    each = first.withColumn("tx", F.explode(F.sequence("i0", "i1"))).withColumn("ty", F.explode(F.sequence("j0", "j1")))
    inner = (F.col("i0") == F.col("i1")) & (F.col("j0") == F.col("j1"))
    return each.withColumn("inner", inner).withColumn("home", (F.col("tx") == F.col("i0")) & (F.col("ty") == F.col("j0"))).drop("i0", "j0", "i1", "j1")


def place_labels(candidates: DataFrame, row: str, choice: str, bounds: tuple[str, str, str, str]) -> DataFrame:
    """candidates: one row for each (row, choice) with a box; lower ``row``
    values come first, lower ``choice`` values are preferred.  Returns the
    accepted (row, choice); rows without a free candidate are left out, as are
    candidates with a null row or choice or a bound that is null or not finite.
    A (row, choice) that comes with several boxes needs all of them free."""
    spark = candidates.sparkSession
    ws = Workspace(spark, "labels")
    xa, ya, xb, yb = (F.col(b).cast("double") for b in bounds)
    boxes = candidates.select(F.col(row).alias("r"), F.col(choice).alias("c"), F.least(xa, xb).alias("x0"), F.least(ya, yb).alias("y0"), F.greatest(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y1"), *[(F.abs(b) < math.inf).alias(f"ok{n}") for n, b in enumerate((xa, ya, xb, yb))])
    boxes = boxes.filter("ok0 and ok1 and ok2 and ok3").dropna(subset=["r", "c"]).select("r", "c", *_BOX)
    own = Window.partitionBy("r")
    whole = [(F.min if n < 2 else F.max)(b).over(own).alias(w) for n, (b, w) in enumerate(zip(_BOX, _ROW))]
    left = ws.keep(boxes.select("*", *whole, F.lit(_OPEN).alias("state")), "open")
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    found = left.agg(F.count("*").alias("n"), *[(F.min if n < 2 else F.max)(b).alias(b) for n, b in enumerate(_BOX)], F.avg(side).alias("side")).first()
    if not found.n:
        return left.select(F.col("r").alias(row), F.col("c").alias(choice))
    width, height = found.x1 - found.x0, found.y1 - found.y0
    extent, share = max(width, height), min(1.0, TILE_BOXES / found.n)
    cell = found.side or extent or 1.0
    size = max(math.sqrt(width * height * share), extent * share, 2 * cell)
    columns = left.columns
    taken: list[DataFrame] = []
    while True:
        n = len(taken)
        # Half a tile aside in every other round, on both axes and then on one; a tile over everything stays in place.
        dx, dy = ((0, 0), (1, 1), (1, 0), (0, 1))[n % 4] if size < extent else (0, 0)
        ox, oy = found.x0 - dx * size / 2, found.y0 - dy * size / 2
        # A little wider than the extent, so that the far border is inside too.
        tile = size * (1 + 1e-9) + 1e-9 * cell
        now = _tiled(left, tile, ox, oy)
        if taken:
            old = taken[0]
            for more in taken[1:]:
                old = old.unionByName(more)
            old = old.select("r", "c", *_BOX, *[F.col(b).alias(w) for b, w in zip(_BOX, _ROW)], F.lit(0).alias("state"))
            now = now.unionByName(_tiled(old, tile, ox, oy).join(now.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi").select(*now.columns))
        ordered = now.repartition("tx", "ty").sortWithinPartitions("tx", "ty", "state", "r", "c")
        schema = left.select(*columns).schema
        settled = ws.keep(ordered.mapInArrow(_settle(cell, _arrow(schema)), schema), f"settled-{n}")
        taken.append(settled.filter(F.col("state") != _OPEN))
        left = settled.filter(F.col("state") == _OPEN)
        open_now = left.agg(F.count("*").alias("n"), F.max(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))).alias("widest")).first()
        if not open_now.n:
            break
        wider = 2 * size
        if open_now.n > MOST_OPEN and open_now.widest < size / 2:
            crowd = _tiled(left, wider, found.x0, found.y0).groupBy("tx", "ty").count().agg(F.max("count")).first()[0]
            wider = size if crowd > MOST_OPEN else wider
        size = wider
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("state") == _TAKEN).select(F.col("r").alias(row), F.col("c").alias(choice))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def occupancy(boxes: DataFrame, order: str, state: str, bounds: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Cells that end up set when boxes set (state true) and clear cells one
    after the other: cx, cy."""
    x0, y0, x1, y1 = bounds
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    cells = boxes.withColumn("cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cy", F.explode(F.sequence(at(y0), at(y1))))
    return cells.groupBy("cx", "cy").agg(F.max_by(state, order).alias("set")).filter("set").select("cx", "cy")
