"""Spatial joins as equi-joins on grid cells.

Every feature is given the cells that its bounding box covers, on a level whose
cells are about as large as the box, so that a feature has a handful of cells
whatever its size.  Points take one cell of each level in use.  The join on
(level, cell) is a plain hash or sort-merge join, which adaptive execution
splits where cells are crowded; exact predicates run on its pairs.  A pair that
meets in several cells is kept in the one that holds the lower left corner of
the boxes' intersection, so no pair is repeated and nothing is de-duplicated
afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.workspace import Workspace

#: Levels are powers of two times the base size, within these exponents.
LEVELS = (-10, 14)


def _level(width: Column, base: float) -> Column:
    """Level whose cells are at least as wide as the box."""
    size = F.greatest(width, F.lit(base * 2.0 ** LEVELS[0]))
    return F.least(F.greatest(F.ceil(F.log2(size / base)), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def _cell(value: Column, level: Column, base: float) -> Column:
    return F.floor(value / (F.lit(base) * F.pow(F.lit(2.0), level))).cast("long")


def with_cells(df: DataFrame, bounds: tuple[Column, Column, Column, Column], base: float) -> DataFrame:
    """One row for each cell of a box: columns __level, __cx, __cy."""
    x0, y0, x1, y1 = bounds
    out = df.withColumn("__level", _level(F.greatest(x1 - x0, y1 - y0), base))
    level = F.col("__level")
    out = out.withColumn("__cx", F.explode(F.sequence(_cell(x0, level, base), _cell(x1, level, base))))
    return out.withColumn("__cy", F.explode(F.sequence(_cell(y0, level, base), _cell(y1, level, base))))


def base_size(df: DataFrame, bounds: tuple[Column, Column, Column, Column]) -> float:
    """Median width of the boxes, as a power of two (one pass)."""
    x0, y0, x1, y1 = bounds
    return _power(df.agg(F.percentile_approx(F.greatest(x1 - x0, y1 - y0), 0.5, 100)).first()[0])


def _power(width: float | None) -> float:
    return 2.0 ** math.ceil(math.log2(width)) if width and width > 0 and math.isfinite(width) else 1.0


def _bounds(g: Column) -> tuple[Column, Column, Column, Column]:
    return g["xmin"], g["ymin"], g["xmax"], g["ymax"]


#: The lowest level of a polygon's own cells (see ``LEVELS``).
LOWEST_CELL = -20
#: Polygons of no more vertices are compared whole.
FEW = 64


def _strictly_inside(x: pa.Array, y: pa.Array, x0: pa.Array, y0: pa.Array, corner: pa.Array, edges: pa.Array) -> pa.Array:
    """Points inside, by the edges that a straight way from their cell's corner
    crosses, and on none of the edges.  What touches the way counts on one side
    of it, and edges are taken upwards (level ones to the left), so that a corner
    on an edge lies on the side that ``cells_inside`` takes it to be on."""
    count = edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ax, ay, bx, by = (f.to_numpy(zero_copy_only=False) for f in edges.flatten().flatten())
    down = (by < ay) | ((by == ay) & (bx > ax))
    ax, bx = np.where(down, bx, ax), np.where(down, ax, bx)
    ay, by = np.where(down, by, ay), np.where(down, ay, by)
    row = np.repeat(np.arange(len(count)), count)
    px, py, rx, ry = (v.to_numpy(zero_copy_only=False)[row] for v in (x, y, x0, y0))
    beside = lambda ux, uy, vx, vy, qx, qy: (vx - ux) * (qy - uy) - (vy - uy) * (qx - ux)
    parted = (beside(rx, ry, px, py, ax, ay) > 0) != (beside(rx, ry, px, py, bx, by) > 0)
    at = beside(ax, ay, bx, by, px, py)
    crossed = parted & ((beside(ax, ay, bx, by, rx, ry) > 0) != (at > 0))
    on = (at == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
    n = len(count)
    odd = (np.bincount(row[crossed], minlength=n) % 2 == 1) ^ corner.to_numpy(zero_copy_only=False)
    return pa.array(odd & (np.bincount(row[on], minlength=n) == 0))


def _whole_cells(polys: DataFrame, geom: str, key: str, base: float) -> DataFrame:
    """Small polygons as ``cells_inside``: the cells of their boxes, with all
    their edges, a point outside in place of the corner, and their boxes."""
    g = F.col(geom)
    boxed = polys.filter(F.size(g["parts"]) > 0).select(key, *[g[c].alias(f"__{c}") for c in ("xmin", "ymin", "xmax", "ymax")], G.segments(geom).alias("__edges"))
    bounds = tuple(F.col(f"__{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    outside = {"__rx": 2 * bounds[0] - bounds[2] - 1, "__ry": bounds[1] - (bounds[3] - bounds[1]) * 0.37 - 1}
    return with_cells(boxed, bounds, base).select(key, "__level", "__cx", "__cy", F.lit(False).alias("__corner"), "__edges", *[v.alias(k) for k, v in outside.items()], *[v.alias(k) for k, v in zip(("__x0", "__y0", "__x1", "__y1"), bounds, strict=True)])


def cells_inside(polys: DataFrame, geom: str, key: str, base: float) -> DataFrame:
    """Polygons as square cells: key, __level, __cx, __cy, whether the cell's
    lower left corner (__rx, __ry) is inside, and the edges that enter the cell
    (null: none, so the whole cell is inside).  Cells outside have no row.

    A polygon of n edges has about n cells, which are at least as wide as edges
    are on average: a long border touches few of them, so most points of a large
    polygon meet no edges at all.  Corners are told by counting the edges right
    of them, row by row of cells.
    """
    g, half = F.col(geom), 2.0
    whole = polys.filter(F.size(g["parts"]) > 0).select(key, g["xmin"].alias("__x0"), g["ymin"].alias("__y0"), g["xmax"].alias("__x1"), g["ymax"].alias("__y1"), G.segments(geom).alias("__s"))
    edges = whole.select("*", F.explode("__s").alias("__e")).drop("__s").select("*", "__e.*")
    long = F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))
    sizes = edges.groupBy(key).agg(F.count("*").alias("__n"), F.sum(long).alias("__long"), F.first("__x0").alias("__x0"), F.first("__y0").alias("__y0"), F.first("__x1").alias("__x1"), F.first("__y1").alias("__y1"))
    width = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    fit = F.greatest(half * width / F.sqrt("__n"), F.col("__long") / F.col("__n"), F.lit(base * 2.0**LOWEST_CELL))
    level = F.least(F.greatest(F.ceil(F.log2(F.least(fit, F.greatest(width, F.lit(base * 2.0**LOWEST_CELL))) / base)), F.lit(LOWEST_CELL)), F.lit(LEVELS[1])).cast("int")
    sizes = sizes.select(key, level.alias("__level"), "__x0", "__y0", "__x1", "__y1").withColumn("__s", F.lit(base) * F.pow(F.lit(2.0), F.col("__level")))
    edges = edges.select(key, "ax", "ay", "bx", "by").join(sizes, key)
    at = lambda c: F.floor(c / F.col("__s")).cast("long")
    low, high, slope = F.least("ay", "by"), F.greatest("ay", "by"), (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    rows = edges.withColumn("__cy", F.explode(F.sequence(at(low), at(high))))
    # Where the edge enters and leaves the row of cells, with room for rounding.
    bottom, room = F.col("__cy") * F.col("__s"), F.col("__s") * 1e-9
    over = lambda y: F.col("ax") + (F.least(F.greatest(y, low), high) - F.col("ay")) * slope
    p, q = F.coalesce(over(bottom), F.col("ax")), F.coalesce(over(bottom + F.col("__s")), F.col("bx"))
    touched = rows.withColumn("__cx", F.explode(F.sequence(at(F.least(p, q) - room), at(F.greatest(p, q) + room))))
    cell = [key, "__level", "__cx", "__cy"]
    lists = touched.groupBy(*cell).agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("__edges"))
    # An edge that crosses the row's lower line is right of all corners before it.
    cross = F.col("ax") + (bottom - F.col("ay")) * slope
    steps = rows.filter((F.col("ay") > bottom) != (F.col("by") > bottom)).select(key, "__level", (F.ceil(cross / F.col("__s")) - 1).cast("long").alias("__cx"), "__cy", F.lit(1).alias("step"))
    every = sizes.withColumn("__cy", F.explode(F.sequence(at(F.col("__y0")), at(F.col("__y1"))))).withColumn("__cx", F.explode(F.sequence(at(F.col("__x0")) - 1, at(F.col("__x1")) + 1)))
    summed = steps.unionByName(every.select(key, "__level", "__cx", "__cy", F.lit(0).alias("step"))).groupBy(*cell).agg(F.sum("step").alias("step"))
    beyond = Window.partitionBy(key, "__level", "__cy").orderBy(F.desc("__cx"))
    corners = summed.select(*cell, (F.sum("step").over(beyond) % 2 == 1).alias("__corner"))
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("__level"))
    return corners.join(lists, cell, "left").filter("__corner or __edges is not null").select(*cell, "__corner", "__edges", (F.col("__cx") * size).alias("__rx"), (F.col("__cy") * size).alias("__ry"))


def pip_join(points: DataFrame, x: str, y: str, polys: DataFrame, geom: str, how: str = "inner", point_id: str | None = None, first_by: str | None = None, base: float | None = None) -> DataFrame:
    """Points with the polygons that strictly contain them.

    first_by: of several polygons of a point, the one with the least value of
    this column (and, of equal ones, of the other columns in order).  how: inner,
    left, semi or anti (the last three need point_id).

    Polygons are numbered and written; points meet their cells (``cells_inside``)
    in an equi-join and are tested in Arrow batches.  But for inner joins points at
    one place are tested once, and only what was found there is joined to them.
    """
    spark = points.sparkSession
    ws = Workspace(spark, "points-in-polygons")
    numbered = ws.keep(polys.withColumn("__poly", F.monotonically_increasing_id()), "polygons")
    g = F.col(geom)
    vertices = F.aggregate(F.transform(g["parts"], F.size), F.lit(0), lambda a, n: a + n)
    width, most = numbered.agg(F.percentile_approx(F.greatest(g["xmax"] - g["xmin"], g["ymax"] - g["ymin"]), 0.5, 100), F.max(vertices)).first()
    base = base or _power(width)
    cells = _whole_cells(numbered.filter(vertices <= FEW), geom, "__poly", base)
    if most and most > FEW:
        cells = cells.unionByName(cells_inside(numbered.filter(vertices > FEW), geom, "__poly", base), allowMissingColumns=True)
    cells = ws.keep(cells, "cells")
    # The levels in use are a fixed few numbers.
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect()) or [0]
    each = how == "inner" and not first_by
    dealt = (points if each else points.select(x, y).distinct()).withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels])))
    dealt = dealt.withColumns({"__cx": _cell(F.col(x), F.col("__level"), base), "__cy": _cell(F.col(y), F.col("__level"), base)})
    # Small polygons' boxes leave few of the points in their cells to be tested.
    boxed = F.col("__x0").isNull() | (F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")))
    met = dealt.join(cells, ["__level", "__cx", "__cy"]).filter(boxed)
    test = F.arrow_udf("boolean")(_strictly_inside).asNondeterministic()
    found = test(F.col(x).cast("double"), F.col(y).cast("double"), "__rx", "__ry", "__corner", "__edges")
    pairs = met.filter(found)
    if each:
        return pairs.select(*points.columns, "__poly").join(numbered, "__poly").drop("__poly")
    pairs = pairs.select(x, y, "__poly")
    if how in ("semi", "anti"):
        return points.join(pairs.select(x, y).distinct(), [x, y], f"left_{how}").select(*points.columns)
    if first_by:
        pairs = _least(ws, pairs, numbered, x, y, first_by)
    pairs = pairs.join(numbered, "__poly")
    if first_by:
        attributes = F.struct(*polys.columns)
        rank = F.struct(first_by, *[c for c, kind in polys.dtypes if c != first_by and "map<" not in kind])
        best = pairs.groupBy(x, y).agg(F.min_by(attributes, rank).alias("__first"))
        pairs = best.select(x, y, *[F.col(f"__first.{c}").alias(c) for c in polys.columns])
    return points.join(pairs.drop("__poly"), [x, y], how).select(*points.columns, *polys.columns)


def _least(ws: Workspace, pairs: DataFrame, numbered: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """The pairs of each place whose polygon has its least value: one, unless
    values are tied, so that few whole polygons are moved."""
    valued = ws.keep(pairs.join(numbered.select("__poly", F.struct(by).alias("__by")), "__poly"), "pairs")
    least = valued.groupBy(x, y).agg(F.min("__by").alias("__least"))
    return valued.join(least, [x, y]).filter("__by <=> __least").select(x, y, "__poly")


def bbox_join(left: DataFrame, left_geom: str, right: DataFrame, right_geom: str, base: float | None = None) -> DataFrame:
    """Pairs whose closed bounding boxes meet; column names must differ.

    A box meets the boxes of its own level and of lower ones in cells of its
    level: own cells on one side, cells of every level in use that is as high or
    higher on the other, where either box covers at most four.  Only the bounds
    are compared; the geometries are carried only if they are read later.
    """
    g, h = F.col(left_geom), F.col(right_geom)
    base = base or base_size(left, _bounds(g))
    a, b = _boxed(left, g, "__a", base), _boxed(right, h, "__b", base)
    # The levels in use are a fixed few numbers.
    (la, many_a), (lb, many_b) = (_levels(df, f"{c}l") for df, c in ((a, "__a"), (b, "__b")))
    a = _dealt(a, "__a", lb, False, base)
    b = _dealt(b, "__b", la, True, base)
    # Rows that explode are far larger than their table's file tells the planner.
    if many_a > FEW_ROWS and many_b > FEW_ROWS:
        a = a.hint("merge")
    elif many_a > FEW_ROWS:
        b = b.hint("broadcast")
    elif many_b > FEW_ROWS:
        a = a.hint("broadcast")
    meet = (F.col("__ax0") <= F.col("__bx1")) & (F.col("__bx0") <= F.col("__ax1")) & (F.col("__ay0") <= F.col("__by1")) & (F.col("__by0") <= F.col("__ay1"))
    level = F.col("__level")
    owner = (F.col("__cx") == _cell(F.greatest("__ax0", "__bx0"), level, base)) & (F.col("__cy") == _cell(F.greatest("__ay0", "__by0"), level, base))
    return a.join(b, ["__level", "__higher", "__cx", "__cy"]).filter(meet & owner).select(*left.columns, *right.columns)


#: Keys of one list, at most.
KEYS = 64


def listed(df: DataFrame, key: str, geom: str, to: str) -> DataFrame:
    """Different values of ``geom``, each with the keys of its rows as a sorted
    list ``to``; of more than ``KEYS`` rows there are several lists.  Rows are
    numbered as they come in order, so no list grows with its table."""
    alike = Window.partitionBy("__hash", geom).orderBy(key)
    numbered = df.select(key, geom, F.xxhash64(geom).alias("__hash")).withColumn("__list", F.floor((F.row_number().over(alike) - 1) / KEYS))
    return numbered.groupBy("__hash", geom, "__list").agg(F.array_sort(F.collect_list(key)).alias(to)).select(geom, to)


def ascending(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of lists of keys (``listed``, so none is empty) that hold a pair
    whose left key is less; ``pairs_of`` then gives these pairs."""
    return pairs.filter(F.get(left, F.lit(0)) < F.element_at(right, -1))


def pairs_of(pairs: DataFrame, left: str, a: str, right: str, b: str, *others: str) -> DataFrame:
    """Every pair of keys (columns a < b, others) of pairs of lists."""
    each = pairs.select(right, *others, F.explode(left).alias(a)).select(a, *others, F.explode(right).alias(b))
    return each.filter(F.col(a) < F.col(b)).select(a, b, *others)


#: Tables of more rows are not broadcast once they are dealt out to cells.
FEW_ROWS = 10_000


def _boxed(df: DataFrame, g: Column, name: str, base: float) -> DataFrame:
    """df with its bounds and level in columns that begin with name."""
    x0, y0, x1, y1 = _bounds(g)
    return df.withColumns({f"{name}x0": x0, f"{name}y0": y0, f"{name}x1": x1, f"{name}y1": y1, f"{name}l": _level(F.greatest(x1 - x0, y1 - y0), base)})


def _levels(df: DataFrame, level: str) -> tuple[list[int], int]:
    """Levels in use and how many rows have one."""
    found = [(r[0], r[1]) for r in df.groupBy(level).count().collect() if r[0] is not None]
    return sorted(k for k, _ in found), sum(n for _, n in found)


def _dealt(df: DataFrame, name: str, others: list[int], right: bool, base: float) -> DataFrame:
    """One row for each cell of a box on its own level, for the other side's
    lower boxes, and on the higher levels of the other side's (__higher: the right
    side has the higher box; of equal levels it is the left side's)."""
    own, as_int = F.col(f"{name}l"), F.array(*[F.lit(v) for v in others]).cast("array<int>")
    up = F.filter(as_int, lambda v: v >= own if right else v > own)
    place = lambda v, higher: F.struct(v.alias("level"), F.lit(higher).alias("higher"))
    spots = F.concat(F.array(place(own, right)), F.transform(up, lambda v: place(v, not right)))
    out = df.filter(own.isNotNull()).withColumn("__at", F.explode(spots)).withColumns({"__level": F.col("__at.level"), "__higher": F.col("__at.higher")}).drop("__at")
    cells = lambda c: F.explode(F.sequence(_cell(F.col(f"{name}{c}0"), F.col("__level"), base), _cell(F.col(f"{name}{c}1"), F.col("__level"), base)))
    return out.withColumn("__cx", cells("x")).withColumn("__cy", cells("y"))


def predicate_join(left: DataFrame, left_geom: str, right: DataFrame, right_geom: str, predicate: str, base: float | None = None) -> DataFrame:
    """Pairs for which ``contains``, ``overlaps`` or ``crosses`` holds.  Where
    most geometries repeat, pairs of different ones are tested, and then joined
    to the rows that have them."""
    test = {"contains": G.contains, "overlaps": G.overlaps, "crosses": G.crosses}[predicate]
    ws = Workspace(left.sparkSession, "predicates")
    (a, of_a), (b, of_b) = _different(ws, left, left_geom, "__a_id"), _different(ws, right, right_geom, "__b_id")
    met = bbox_join(a, left_geom, b, right_geom, base).filter(test(left_geom, right_geom))
    if of_a is None and of_b is None:
        return met
    keep = [*(["__a_id"] if of_a is not None else left.columns), *(["__b_id"] if of_b is not None else right.columns)]
    met = ws.keep(met.select(*keep), "met")
    if of_a is not None:
        met = met.join(of_a, "__a_id")
    if of_b is not None:
        met = met.join(of_b, "__b_id")
    return met.select(*left.columns, *right.columns)


def _different(ws: Workspace, df: DataFrame, geom: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """A table's different geometries with numbers, and its rows with those
    numbers; the table itself and nothing where less than half of them repeat."""
    rows, different = df.agg(F.count(geom), F.approx_count_distinct(F.xxhash64(geom))).first()
    if rows < 2 * different or rows <= FEW_ROWS:
        return df, None
    whole = df.filter(F.col(geom).isNotNull())
    found = ws.keep(whole.select(geom).distinct().withColumn(name, F.monotonically_increasing_id()), f"shapes{name}")
    return found, ws.keep(whole.join(found, geom).select(*df.columns, name), f"rows{name}")


def within_distance(left: DataFrame, lx: str, ly: str, right: DataFrame, rx: str, ry: str, distance: float) -> DataFrame:
    """Pairs of points at most ``distance`` apart: cells of that size, each left
    point in its own, each right point in its own and the eight around.  At
    distance 0: pairs of equal points."""
    if distance < 0:
        raise ValueError("the distance is negative")
    if distance == 0:
        return left.join(right, (F.col(lx) == F.col(rx)) & (F.col(ly) == F.col(ry)))
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = left.withColumns({"__cx": cell(lx), "__cy": cell(ly)})
    b = right.withColumn("__cx", around(rx)).withColumn("__cy", around(ry))
    near = (F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2 <= distance * distance
    return a.join(b, ["__cx", "__cy"]).filter(near).drop("__cx", "__cy")


def near_geometry(points: DataFrame, x: str, y: str, features: DataFrame, geom: str, distance: float, border_only: bool = False) -> DataFrame:
    """Pairs of points and features at most ``distance`` apart: the points in a
    buffer with round caps.  A point inside a polygon is at distance 0, unless
    only the distance from its border is asked for."""
    g = F.col(geom)
    bounds = (g["xmin"] - distance, g["ymin"] - distance, g["xmax"] + distance, g["ymax"] + distance)
    base = base_size(features, bounds)
    cells = with_cells(features, bounds, base)
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect()) or [0]
    dealt = points.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels])))
    dealt = dealt.withColumns({"__cx": _cell(F.col(x), F.col("__level"), base), "__cy": _cell(F.col(y), F.col("__level"), base)})
    near = G.distance_to_point(g, x, y) <= distance
    if not border_only:
        near = near | (G.is_polygon(g) & G.contains_point(g, x, y))
    return dealt.join(cells, ["__level", "__cx", "__cy"]).filter(near).drop("__level", "__cx", "__cy")


def key_lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str, default) -> DataFrame:
    """Value of a key, where the last by ``order`` wins; the default without."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def resolve_references(lists: DataFrame, list_id: str, refs: str, nodes: DataFrame, node_id: str, x: str, y: str) -> DataFrame:
    """(list_id, vertices): an id's references replaced by their coordinates in
    order; repeated ones stay, unknown ones are left out and counted."""
    pos = lists.select(list_id, F.posexplode(refs).alias("__pos", node_id))
    found = pos.join(nodes.select(node_id, x, y), node_id, "left")
    vertex = F.struct("__pos", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = F.when(F.col(x).isNotNull(), vertex)
    out = found.groupBy(list_id).agg(F.array_sort(F.collect_list(known)).alias("v"), F.sum(F.col(x).isNull().cast("int")).alias("unknown"))
    return out.select(list_id, F.transform("v", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("vertices"), "unknown")
