"""The geometry column: a struct of type, parts and bounding box.

``parts`` holds rings or lines as arrays of (x, y); a polygon's rings are
closed.  Outer rings run counter-clockwise and their holes, which follow them,
clockwise; so each ring of a MULTIPOLYGON that runs like the first one begins
another polygon.  What reads or builds polygons keeps to that, and ``oriented``
brings others into it.

The bounding box is stored, so that filters and joins on it are plain
comparisons (and are pushed down to Parquet).  Most of this module is Column
expressions over the nested arrays; what compares all edges of two geometries
(predicates, overlay areas) is one numpy function over Arrow batches of pairs
(``pieces``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import pieces

#: Geometry type codes.
POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "POINT", LINESTRING: "LINESTRING", POLYGON: "POLYGON", MULTIPOINT: "MULTIPOINT", MULTILINESTRING: "MULTILINESTRING", MULTIPOLYGON: "MULTIPOLYGON", COLLECTION: "GEOMETRYCOLLECTION"}
VERTEX = "struct<x:double,y:double>"
SCHEMA = f"struct<gtype:int,parts:array<array<{VERTEX}>>,xmin:double,ymin:double,xmax:double,ymax:double>"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def vertex(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def geometry(gtype, parts: Column) -> Column:
    """Geometry of parts, with its bounding box; empty parts give NULL bounds."""
    flat = F.flatten(parts)
    bound = lambda f, k: f(F.transform(flat, lambda v: v[k]))
    return F.struct(
        (F.lit(gtype) if isinstance(gtype, int) else gtype).cast("int").alias("gtype"), parts.alias("parts"),
        bound(F.array_min, "x").alias("xmin"), bound(F.array_min, "y").alias("ymin"), bound(F.array_max, "x").alias("xmax"), bound(F.array_max, "y").alias("ymax"),
    )


def make_point(x, y) -> Column:
    return geometry(POINT, F.array(F.array(vertex(x, y))))


def make_line(vertices: Column) -> Column:
    return geometry(LINESTRING, F.array(vertices))


def make_polygon(ring: Column) -> Column:
    """Polygon of one ring, closed if it is not."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return geometry(POLYGON, F.array(closed))


def make_box(x0, y0, x1, y1) -> Column:
    """Rectangle with two opposite corners, counter-clockwise."""
    x0, y0, x1, y1 = (_col(c) for c in (x0, y0, x1, y1))
    l, b, r, t = F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)
    return geometry(POLYGON, F.array(F.array(vertex(l, b), vertex(r, b), vertex(r, t), vertex(l, t), vertex(l, b))))


def make_regular_polygon(x, y, radius, n: int, rotation: float = 0.0) -> Column:
    """n corners at a radius, the first at ``rotation`` degrees; a circle for large n."""
    x, y, radius = _col(x), _col(y), _col(radius)
    corner = lambda i: vertex(x + radius * F.cos(F.radians(i % n * (360.0 / n) + rotation)), y + radius * F.sin(F.radians(i % n * (360.0 / n) + rotation)))
    return geometry(POLYGON, F.array(F.transform(F.sequence(F.lit(0), F.lit(n)), corner)))


def make_circle(x, y, radius, n: int = 64) -> Column:
    return make_regular_polygon(x, y, radius, n)


def is_empty(g) -> Column:
    return F.size(_col(g)["parts"]) == 0


def shift(g, dx, dy) -> Column:
    g = _col(g)
    dx, dy = (_col(c) if not isinstance(c, (int, float)) else F.lit(float(c)) for c in (dx, dy))
    return geometry(g["gtype"], F.transform(g["parts"], lambda p: F.transform(p, lambda v: vertex(v["x"] + dx, v["y"] + dy))))


def is_polygon(g) -> Column:
    return _col(g)["gtype"].isin(POLYGON, MULTIPOLYGON)


def reverse(g) -> Column:
    """Parts and their vertices in reverse order; closed parts stay closed, and
    a polygon's rings keep their places, since holes follow their outer ring."""
    g = _col(g)
    turned = F.transform(g["parts"], lambda p: F.reverse(p))
    return geometry(g["gtype"], F.when(is_polygon(g), turned).otherwise(F.reverse(turned)))


def ring_area(ring: Column) -> Column:
    """Signed area of one closed ring, reckoned from its first vertex."""
    a = F.element_at(ring, 1)
    cross = lambda p, q: (p["x"] - a["x"]) * (q["y"] - a["y"]) - (q["x"] - a["x"]) * (p["y"] - a["y"])
    return F.aggregate(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), cross), F.lit(0.0), lambda t, v: t + v) / 2


def _turned(ring: Column, left: Column | bool) -> Column:
    wrong = ring_area(ring) < 0 if left is True else ring_area(ring) > 0 if left is False else F.when(left, ring_area(ring) < 0).otherwise(ring_area(ring) > 0)
    return F.when((F.size(ring) > 3) & wrong, F.reverse(ring)).otherwise(ring)


def begins_polygon(parts: Column, ring: Column, i: Column) -> Column:
    """Ring i of a polygon or multipolygon is an outer ring."""
    return (i == 0) | (F.signum(ring_area(ring)) == F.signum(ring_area(F.get(parts, 0))))


def oriented(g) -> Column:
    """The geometry with outer rings counter-clockwise and holes clockwise.  In a
    POLYGON the first ring is the outer one, in a MULTIPOLYGON those that run
    like the first; other types stay as they are."""
    g = _col(g)
    outer = lambda r, i: F.when(g["gtype"] == POLYGON, i == 0).otherwise(begins_polygon(g["parts"], r, i))
    parts = F.transform(g["parts"], lambda r, i: _turned(r, outer(r, i)))
    return F.when(is_polygon(g), geometry(g["gtype"], parts)).otherwise(g)


def path_type(parts: Column) -> Column:
    """Type of the geometry that a path of parts forms: points, closed parts,
    open parts, or a mixture."""
    single = F.size(parts) == 1
    closed = lambda p: (F.size(p) > 3) & (F.element_at(p, 1) == F.element_at(p, -1))
    return (
        F.when(F.forall(parts, lambda p: F.size(p) == 1), F.when(single, POINT).otherwise(MULTIPOINT))
        .when(F.forall(parts, closed), F.when(single, POLYGON).otherwise(MULTIPOLYGON))
        .when(F.forall(parts, lambda p: ~closed(p)), F.when(single, LINESTRING).otherwise(MULTILINESTRING))
        .otherwise(COLLECTION)
    )


def segments(g) -> Column:
    """All edges as (ax, ay, bx, by)."""
    pair = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    per_part = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), pair)
    long = F.filter(_col(g)["parts"], lambda p: F.size(p) > 1)
    return F.flatten(F.transform(long, per_part))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, s: a + f(s))


def length(g) -> Column:
    return _sum(segments(g), lambda s: F.sqrt((s["bx"] - s["ax"]) ** 2 + (s["by"] - s["ay"]) ** 2))


def signed_area(g) -> Column:
    return _sum(segments(g), lambda s: s["ax"] * s["by"] - s["bx"] * s["ay"]) / 2


def area(g) -> Column:
    return F.abs(signed_area(g))


def is_clockwise(g) -> Column:
    return signed_area(g) < 0


def centroid(g) -> Column:
    """Area-weighted centre of a polygon; NULL for zero area."""
    cross = lambda s: s["ax"] * s["by"] - s["bx"] * s["ay"]
    a = F.nullif(signed_area(g), F.lit(0.0))
    return F.struct((_sum(segments(g), lambda s: (s["ax"] + s["bx"]) * cross(s)) / (6 * a)).alias("x"), (_sum(segments(g), lambda s: (s["ay"] + s["by"]) * cross(s)) / (6 * a)).alias("y"))


def boxes_meet(a, b) -> Column:
    """Closed bounding boxes have a point in common."""
    a, b = _col(a), _col(b)
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def on_boundary(g, x: Column, y: Column) -> Column:
    def touches(s: Column) -> Column:
        cross = (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
        return (cross == 0) & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))

    return F.exists(segments(g), touches)


def _crossings_odd(g, x: Column, y: Column) -> Column:
    def crosses(s: Column) -> Column:
        spans = (s["ay"] > y) != (s["by"] > y)
        at = s["ax"] + (y - s["ay"]) * (s["bx"] - s["ax"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0))
        return spans & (x < at)

    return F.size(F.filter(segments(g), crosses)) % 2 == 1


def contains_point(g, x, y) -> Column:
    """The point lies strictly inside the polygon (even-odd rule)."""
    g, x, y = _col(g), _col(x), _col(y)
    box = (x > g["xmin"]) & (x < g["xmax"]) & (y > g["ymin"]) & (y < g["ymax"])
    return box & _crossings_odd(g, x, y) & ~on_boundary(g, x, y)


def covers_point(g, x, y) -> Column:
    """Inside or on the boundary."""
    g, x, y = _col(g), _col(x), _col(y)
    box = x.between(g["xmin"], g["xmax"]) & y.between(g["ymin"], g["ymax"])
    return box & (_crossings_odd(g, x, y) | on_boundary(g, x, y))


def _side(s: Column, x: Column, y: Column) -> Column:
    return F.signum((s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]))


def _of_pairs(kind: str, f):
    """A Column function of pairs of geometries.  It is called nondeterministic
    so that a filter on its result does not evaluate it a second time."""
    return F.arrow_udf(kind)(f).asNondeterministic()


def _relation(name: str, a, b) -> Column:
    def test(x: pa.Array, y: pa.Array) -> pa.Array:
        found = pieces.relations(x, y)[name]
        return pa.array(found.data, mask=found.mask)

    return boxes_meet(a, b) & _of_pairs("boolean", test)(_col(a), _col(b))


def contains(a, b) -> Column:
    """a (a polygon or line) holds b: nothing of b is outside, and interiors
    meet; points hold points as sets do.  Null geometries and collections give
    null, empty ones null or false."""
    return _relation("contains", a, b)


def overlaps(a, b) -> Column:
    """Two polygons, or two lines, share some interior (a stretch), or two sets
    of points a point, and each has some of its own."""
    return _relation("overlaps", a, b)


def crosses(a, b) -> Column:
    """Line and line: they meet at a point that is an end of neither, and share
    no stretch.  Line or points and polygon, points and line: partly inside and
    partly outside."""
    return _relation("crosses", a, b)


def distance_to_point(g, x, y) -> Column:
    """Distance of a point from the vertices and edges of a geometry."""
    x, y = _col(x), _col(y)

    def to_edge(s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        t = F.coalesce(((x - s["ax"]) * dx + (y - s["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt((s["ax"] + t * dx - x) ** 2 + (s["ay"] + t * dy - y) ** 2)

    to_vertex = F.transform(F.flatten(_col(g)["parts"]), lambda v: F.sqrt((v["x"] - x) ** 2 + (v["y"] - y) ** 2))
    return F.array_min(F.concat(to_vertex, F.transform(segments(g), to_edge)))


def vertices_off(points, g, distance: float, tolerance: float) -> Column:
    """How many vertices of a geometry are not at a distance from another's
    vertices and edges.  Null geometries give null.  Of equal pairs in
    neighbouring rows only one is worked out."""
    def count(p: pa.Array, q: pa.Array) -> pa.Array:
        new = ~(pieces.repeats(p) & pieces.repeats(q))
        lead = pa.array(np.flatnonzero(new))
        p, q = p.take(lead), q.take(lead)
        far, first = pieces.vertex_distances(p, q)
        off = np.concatenate([[0], np.cumsum(~(np.abs(far - distance) <= tolerance))])[first]
        return pa.array(np.diff(off), mask=pc.or_(p.is_null(), q.is_null()).to_numpy(zero_copy_only=False)).take(pa.array(np.cumsum(new) - 1))

    return _of_pairs("long", count)(_col(points), _col(g))


# --- clipping and overlay measures -------------------------------------------


def clip_line(ax, ay, bx, by, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Part of a segment in a rectangle (Liang-Barsky), NULL if there is none."""
    ax, ay, bx, by = (_col(c) for c in (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t0, t1, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, ax - xmin), (dx, F.lit(xmax) - ax), (-dy, ay - ymin), (dy, F.lit(ymax) - ay)):
        r = q / F.nullif(p, F.lit(0.0))
        t0 = F.when(p < 0, F.greatest(t0, r)).otherwise(t0)
        t1 = F.when(p > 0, F.least(t1, r)).otherwise(t1)
        out = out | ((p == 0) & (q < 0))
    cut = F.struct((ax + t0 * dx).alias("ax"), (ay + t0 * dy).alias("ay"), (ax + t1 * dx).alias("bx"), (ay + t1 * dy).alias("by"))
    return F.when(~out & (t0 <= t1), cut)


def clip_polygon(g, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Polygon in a rectangle, edge by edge; rings without a rest go."""
    g = _col(g)

    def against(ring: Column, axis: str, bound: float, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda v: v[axis] >= bound if keep_above else v[axis] <= bound

        def cross(a: Column, b: Column) -> Column:
            t = (F.lit(bound) - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
            o = a[other] + t * (b[other] - a[other])
            return vertex(F.lit(bound), o) if axis == "x" else vertex(o, F.lit(bound))

        def step(a: Column, b: Column) -> Column:
            none = F.array().cast(f"array<{VERTEX}>")
            return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cross(a, b))).when(inside(b), F.array(cross(a, b), b)).otherwise(none)

        out = F.flatten(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), step))
        return F.when(F.size(ring) < 4, F.array().cast(f"array<{VERTEX}>")).when(F.size(out) == 0, out).otherwise(F.when(F.element_at(out, 1) == F.element_at(out, -1), out).otherwise(F.concat(out, F.slice(out, 1, 1))))

    parts = g["parts"]
    for axis, bound, above in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False)):
        parts = _each(parts, axis, float(bound), above, against)
    return geometry(g["gtype"], F.filter(parts, lambda p: F.size(p) > 3))


def _each(parts: Column, axis: str, bound: float, above: bool, against) -> Column:
    return F.transform(parts, lambda p: against(p, axis, bound, above))


def overlay_area(a, b, how: str = "intersection") -> Column:
    """Area of the ``intersection``, ``difference`` (a less b) or ``union`` of
    two polygons, whichever way their rings run."""
    if how not in pieces.KEPT:
        raise ValueError(f"unknown overlay: {how}")

    def measure(x: pa.Array, y: pa.Array) -> pa.Array:
        ea, eb = pieces.edges(x), pieces.edges(y)
        if how == "intersection":
            return pa.array(pieces.shared(ea, eb) + 0.0, pa.float64())
        out = [pieces.enclosed(pieces.bounding(m, how)) for _, _, m in pieces.in_runs(ea, eb)]
        return pa.array([v + 0.0 for o in out for v in o], pa.float64())

    return _of_pairs("double", measure)(_col(a), _col(b))


def intersection_area(a, b) -> Column:
    """Area that two polygons share."""
    return overlay_area(a, b, "intersection")


# --- text forms --------------------------------------------------------------


def from_wkt(text) -> Column:
    """Geometry of a well-known text without nested collections; NULL for
    anything else.  Rings are oriented: each polygon's first one is outer."""
    text = F.trim(_col(text))
    name = F.regexp_extract(text, r"^([A-Z]+)", 1)
    body = F.regexp_replace(text, r"^[A-Z]+\s*", "")
    pair = lambda s: F.filter(F.split(F.trim(F.regexp_replace(s, r"[()]", " ")), r"\s+"), lambda t: t != "")
    number = lambda s: vertex(F.get(pair(s), 0).try_cast("double"), F.get(pair(s), 1).try_cast("double"))
    rings_of = lambda s: F.split(s, r"\)\s*,\s*\(")
    # A part ends where a bracket closes; points without brackets of their own stay one part each.
    lines = F.when(name.isin("POINT", "LINESTRING"), F.array(body)).when(name == "MULTIPOINT", F.split(F.regexp_replace(body, r"[()]", ""), ",")).otherwise(rings_of(body))
    read = lambda groups: F.transform(groups, lambda g: F.transform(F.split(g, ","), number))
    # A polygon ends where two brackets close.
    polygons = F.when(name == "POLYGON", F.array(body)).otherwise(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("))
    turned = F.flatten(F.transform(polygons, lambda p: F.transform(read(rings_of(p)), lambda r, i: _turned(r, i == 0))))
    parts = F.when(name.isin("POLYGON", "MULTIPOLYGON"), turned).otherwise(read(lines))
    code = None
    for value, known in NAMES.items():
        if value != COLLECTION:
            code = F.when(name == known, F.lit(value)) if code is None else code.when(name == known, F.lit(value))
    parts = F.when(body == "EMPTY", F.array().cast(f"array<array<{VERTEX}>>")).otherwise(parts)
    wrong = F.exists(F.flatten(parts), lambda v: v["x"].isNull() | v["y"].isNull()) | F.exists(lines, lambda g: F.exists(F.split(g, ","), lambda s: F.size(pair(s)) != 2))
    return F.when(code.isNotNull() & ((body == "EMPTY") | ~wrong), geometry(code, parts))


def _polygons_joined(parts: Column, ring, within: str, between: str) -> Column:
    """Texts of a multipolygon's rings, with one separator before a hole and
    another one before the next polygon's outer ring."""
    first = lambda r, i: F.when(i == 0, F.lit("")).when(begins_polygon(parts, r, i), F.lit(between)).otherwise(F.lit(within))
    return F.array_join(F.transform(parts, lambda r, i: F.concat(first(r, i), ring(r))), "")


def to_wkt(g) -> Column:
    g = _col(g)
    pair = lambda v: F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, pair), ", "), F.lit(")"))
    name = F.element_at(F.create_map(*[F.lit(x) for item in NAMES.items() for x in item]), g["gtype"])
    joined = F.array_join(F.transform(g["parts"], part), ", ")
    many = F.concat(F.lit("(("), _polygons_joined(g["parts"], part, ", ", "), ("), F.lit("))"))
    body = F.when(g["gtype"].isin(POINT, LINESTRING), joined).when(g["gtype"] == MULTIPOLYGON, many).otherwise(F.concat(F.lit("("), joined, F.lit(")")))
    return F.when(is_empty(g), F.concat(name, F.lit(" EMPTY"))).otherwise(F.concat(name, F.lit(" "), body))


def to_geojson(g, properties: Column | None = None, identifier: Column | None = None) -> Column:
    """A feature as one line of JSON; properties is a struct or map column."""
    g = _col(g)
    names = {POINT: "Point", LINESTRING: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINESTRING: "MultiLineString", MULTIPOLYGON: "MultiPolygon"}
    xy = lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"]))
    lines = F.transform(g["parts"], xy)
    name = F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), g["gtype"])
    many = F.concat(F.lit("[["), _polygons_joined(g["parts"], lambda r: F.to_json(xy(r)), ",", "],["), F.lit("]]"))
    one = F.when(g["gtype"] == POINT, F.to_json(F.get(F.get(lines, 0), 0))).when(g["gtype"] == LINESTRING, F.to_json(F.get(lines, 0)))
    coords = F.when(is_empty(g), F.lit("[]")).otherwise(one.when(g["gtype"] == MULTIPOINT, F.to_json(F.flatten(lines))).when(g["gtype"] == MULTIPOLYGON, many).otherwise(F.to_json(lines)))
    shape = F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coords, F.lit("}"))
    attributes = F.coalesce(F.to_json(properties), F.lit("null")) if properties is not None else F.lit("null")
    quoted = F.to_json(F.array(identifier.cast("string"))) if identifier is not None else None
    tail = F.concat(F.lit(',"id":'), quoted.substr(F.lit(2), F.length(quoted) - 2)) if quoted is not None else F.lit("")
    return F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), attributes, tail, F.lit("}"))
