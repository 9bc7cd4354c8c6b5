"""Geometry columns: text forms, predicates, clipping, overlay, hull, labels."""

import math
import random

import pytest
from pyspark.sql import functions as F
from stages import rows_since, shuffled_rows

from terrane.functions import geometry as G
from terrane.operators import aggregate as A
from terrane.operators import linear as L
from terrane.operators import placement as Q
from terrane.operators import spatial_join as J

WKT = ["POINT (1.0 2.0)", "LINESTRING (0.0 0.0, 3.0 4.0)", "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 4.0, 0.0 0.0), (1.0 1.0, 1.0 2.0, 2.0 2.0, 2.0 1.0, 1.0 1.0))", "MULTIPOINT ((1.0 2.0), (3.0 4.0))", "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0))"]


def test_wkt_round_trip(spark):
    df = spark.createDataFrame([(w,) for w in WKT], "w string").select("w", G.from_wkt("w").alias("g"))
    for r in df.select("w", G.to_wkt("g").alias("t")).collect():
        assert r.t == r.w
    bad = spark.createDataFrame([("POINT (1 2 3)",), ("point (1 2)",), ("POINT (a b)",), (None,)], "w string")
    assert all(r.g is None for r in bad.select(G.from_wkt("w").alias("g")).collect())
    assert spark.createDataFrame([("POINT EMPTY",)], "w string").select(G.is_empty(G.from_wkt("w"))).first()[0]


def _g(spark, **shapes):
    return spark.createDataFrame([tuple(shapes.values())], ", ".join(f"{k} string" for k in shapes)).select(*[G.from_wkt(k).alias(k) for k in shapes])


def test_measures(spark):
    df = _g(spark, p=WKT[2], l=WKT[1])
    r = df.select(G.area("p"), G.length("l"), G.centroid("p"), G.is_clockwise("p"), G.length(G.reverse("l")), G.area(G.shift("p", 5, 5))).first()
    assert r[0] == 15.0 and r[1] == 5.0 and not r[3] and r[4] == 5.0 and r[5] == 15.0
    assert r[2].x == pytest.approx((16 * 2 - 1 * 1.5) / 15)


def test_predicates(spark):
    df = _g(spark, a="POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", b="POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", c="POLYGON ((8 8, 12 8, 12 12, 8 12, 8 8))", d="POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))", l="LINESTRING (5 5, 15 5)", m="LINESTRING (1 1, 2 2)")
    r = df.select(G.contains("a", "b"), G.contains("b", "a"), G.overlaps("a", "c"), G.overlaps("a", "b"), G.overlaps("a", "d"), G.crosses("l", "a"), G.crosses("m", "a"), G.contains_point("a", F.lit(0.0), F.lit(5.0)), G.covers_point("a", F.lit(0.0), F.lit(5.0)), G.contains_point("a", F.lit(5.0), F.lit(5.0)), G.contains("a", "a")).first()
    assert list(r) == [True, False, True, False, False, True, False, False, True, True, True]


def test_overlay_invariants(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        def tri():
            p = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(3)]
            if (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[2][0] - p[0][0]) * (p[1][1] - p[0][1]) < 0:
                p.reverse()
            return "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*p, p[0]]) + "))"
        rows.append((tri(), tri()))
    df = spark.createDataFrame(rows, "a string, b string").select(G.from_wkt("a").alias("a"), G.from_wkt("b").alias("b")).filter((G.area("a") > 0) & (G.area("b") > 0))
    for r in df.select(G.intersection_area("a", "b").alias("s"), G.intersection_area("b", "a").alias("t"), G.area("a").alias("x"), G.area("b").alias("y"), G.intersection_area("a", "a").alias("own")).collect():
        assert r.s == pytest.approx(r.t, abs=1e-6) and -1e-9 <= r.s <= min(r.x, r.y) + 1e-6 and r.own == pytest.approx(r.x, abs=1e-6)


def test_clip_agrees_with_overlay(spark):
    df = _g(spark, a="POLYGON ((0 0, 9 1, 7 8, 1 6, 0 0))").withColumn("w", G.make_box(F.lit(2.0), F.lit(-1.0), F.lit(6.0), F.lit(5.0)))
    r = df.select(G.area(G.clip_polygon("a", 2.0, -1.0, 6.0, 5.0)), G.intersection_area("a", "w")).first()
    assert r[0] == pytest.approx(r[1])


def test_geojson(spark):
    import json

    text = _g(spark, p=WKT[2]).select(G.to_geojson("p", F.struct(F.lit('a"b').alias("k")), F.lit(7))).first()[0]
    got = json.loads(text)
    assert got["geometry"]["type"] == "Polygon" and got["properties"] == {"k": 'a"b'} and got["id"] == "7"


def test_constructors(spark):
    r = spark.range(1).select(G.area(G.make_circle(F.lit(0.0), F.lit(0.0), F.lit(2.0), 256)), G.area(G.make_box(F.lit(3), F.lit(4), F.lit(1), F.lit(1))), G.path_type(G.from_wkt(F.lit(WKT[3]))["parts"])).first()
    assert r[0] == pytest.approx(12.566, abs=0.01) and r[1] == 6.0 and r[2] == G.MULTIPOINT


def test_grid_join_is_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.3, 2.0, 40.0])) for i in range(120)]
    box = lambda df, k: df.select(F.col("i").alias(k), G.make_box(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")).alias(f"g{k}"))
    df = spark.createDataFrame(a, "i long, x double, y double, s double")
    got = [(r.a, r.b) for r in J.bbox_join(box(df, "a"), "ga", box(df, "b"), "gb").select("a", "b").collect()]
    want = {(p[0], q[0]) for p in a for q in a if p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[3] and q[2] <= p[2] + p[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_labels_equal_sequential_greedy(spark):
    rng = random.Random(2)
    boxes = []
    for i in range(80):
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)
        boxes += [(i, 0, x, y, x + 3, y + 1.5), (i, 1, x - 3, y, x, y + 1.5)]
    meets = lambda p, q: p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1]
    taken, want = [], set()
    for i in range(80):
        for b in (b for b in boxes if b[0] == i):
            if not any(meets(b[2:], t) for t in taken):
                taken.append(b[2:])
                want.add(b[:2])
                break
    df = spark.createDataFrame(boxes, "i long, c int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.i, r.c) for r in Q.place_labels(df, "i", "c", ("x0", "y0", "x1", "y1")).collect()} == want


def test_hull(spark):
    rng = random.Random(3)
    pts = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in (1, 2) for _ in range(50)]
    rows = A.hull_agg(spark.createDataFrame(pts, "k long, x double, y double").repartition(3), "k", "x", "y").orderBy("k", "pos").collect()
    for k in (1, 2):
        hull = [(r.x, r.y) for r in rows if r.k == k]
        for p, q in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -1e-9 for g, x, y in pts if g == k)


def test_lines(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0), (2, 0, 5.0, 5.0)], "id long, pos int, x double, y double")
    pts = {(r.k, r.px, r.py) for r in L.sample_line(v, ["id"], ["pos"], 5.0).collect()}
    assert pts == {(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 10.0, 0.0), (3, 10.0, 5.0), (4, 10.0, 10.0)}
    back = {(r.k, r.px, r.py) for r in L.sample_line(v, ["id"], ["pos"], -5.0).collect()}
    assert (0, 10.0, 10.0) in back and (4, 0.0, 0.0) in back and len(back) == 5
    off = [(r.x, r.y) for r in L.offset_line(v, ["id"], ["pos"], 1.0).orderBy("pos").collect()]
    assert off == [pytest.approx((0.0, -1.0)), pytest.approx((11.0, -1.0)), pytest.approx((11.0, 10.0))]
    items = spark.createDataFrame([(1, i, 4.0) for i in range(4)], "id long, n int, w double")
    placed = L.place_along(v, ["id"], ["pos"], items, "n", "w").orderBy("n").collect()
    assert [(r.px, r.py, r.angle) for r in placed] == [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (8.0, 0.0, 0.0), (10.0, 2.0, 90.0)]
    assert L.merge_ranges([(-2, 5), (2, 3), (9, 1)]) == [(0.0, 5), (9, 10)]


def test_axis():
    assert A.nice_axis(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    with pytest.raises(ValueError):
        A.nice_axis(1, 1, 5)


def test_overlay_rings(spark):
    from terrane.operators.overlay import clip_to_mask, overlay

    df = _g(spark, a="POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", b="POLYGON ((4 -2, 6 -2, 6 12, 4 12, 4 -2))", c="POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))")
    for how, other, area, parts in (("intersection", "b", 20.0, 1), ("difference", "b", 80.0, 2), ("union", "b", 108.0, 1), ("union", "c", 200.0, 1), ("intersection", "c", 0.0, 0), ("difference", "c", 100.0, 1)):
        r = overlay(df, "a", other, how).select(G.area("overlay").alias("area"), F.size("overlay.parts").alias("n")).first()
        assert (r.area, r.n) == (pytest.approx(area), parts), (how, other)
    cut = clip_to_mask(df.select("a"), "a", df.select("b"), "b").select(G.area("a")).first()[0]
    assert cut == pytest.approx(20.0)


def test_every_mask_clips(spark):
    from terrane.operators.overlay import clip_to_mask

    box = lambda a, b, c, d: f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"
    layer = lambda name, *shapes: spark.createDataFrame([(w,) for w in shapes], f"{name} string").select(G.from_wkt(name).alias(name))
    df, masks = layer("a", box(0, 0, 10, 10)), [box(4, -2, 6, 12), box(-1, 3, 11, 5), box(5, -1, 12, 11)]
    for order in (masks, masks[::-1]):
        assert [r[0] for r in clip_to_mask(df, "a", layer("b", *order), "b").select(G.area("a")).collect()] == [pytest.approx(2.0)]
        # What is left is 0..4 x (0..3 and 5..10).
        assert [r[0] for r in clip_to_mask(df, "a", layer("b", *order), "b", inside=False).select(G.area("a")).collect()] == [pytest.approx(32.0)]
    assert clip_to_mask(df, "a", layer("b", masks[0], box(20, 20, 30, 30)), "b").select(F.size("a.parts")).first()[0] == 0


def test_multipolygons_keep_their_holes(spark):
    many = "MULTIPOLYGON (((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 4.0, 0.0 0.0), (1.0 1.0, 1.0 2.0, 2.0 2.0, 2.0 1.0, 1.0 1.0)), ((9.0 9.0, 10.0 9.0, 10.0 10.0, 9.0 10.0, 9.0 9.0)))"
    # The same with every ring the other way round.
    turned = "MULTIPOLYGON (((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((9 9, 9 10, 10 10, 10 9, 9 9)))"
    for r in _g(spark, a=many, b=turned).select(G.to_wkt("a"), G.to_wkt("b"), G.area("a"), G.to_wkt(G.oriented(G.reverse("a")))).collect():
        assert list(r) == [many, many, 16.0, many]
    import json

    got = json.loads(_g(spark, a=many).select(G.to_geojson("a")).first()[0])
    assert [len(p) for p in got["geometry"]["coordinates"]] == [2, 1]


def test_orientation_does_not_matter(spark):
    # Column structs that no reader has oriented.
    ring = lambda *xy: F.array(*[G.vertex(F.lit(x), F.lit(y)) for x, y in xy])
    left, right = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((2, 2), (2, 6), (6, 6), (6, 2), (2, 2))
    df = spark.range(1).select(left.alias("l"), right.alias("r")).select(G.make_polygon(F.col("l")).alias("a"), G.make_polygon(F.reverse("l")).alias("b"), G.make_polygon(F.col("r")).alias("c"), G.make_polygon(F.reverse("r")).alias("d"))
    r = df.select(*[G.overlay_area(a, b, how).alias(f"{how}{a}{b}") for how in ("intersection", "difference", "union") for a in "ab" for b in "cd"]).first()
    assert list(r) == [pytest.approx(v) for v in [4.0] * 4 + [12.0] * 4 + [28.0] * 4]


def test_predicates_at_corners(spark):
    df = _g(
        spark, n="POLYGON ((0 0, 10 0, 10 10, 6 10, 5 5, 4 10, 0 10, 0 0))", l="LINESTRING (3 9, 7 9)", k="LINESTRING (1 1, 1 9)", v="LINESTRING (0 0, 1 1, 2 2)", w="LINESTRING (0 2, 1 1, 2 0)", t="LINESTRING (1 1, 5 0)", o="LINESTRING (1 1, 2 2, 9 9)",
        d="POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 3 6, 6 6, 6 3, 3 3))", h="POLYGON ((3 3, 6 3, 6 6, 3 6, 3 3))", p="MULTIPOINT (1 1, 20 20)", q="POINT (1 1)", c="LINESTRING (0 0, 10 0)",
    )
    r = df.select(
        G.contains("n", "l"), G.crosses("l", "n"), G.contains("n", "k"), G.crosses("v", "w"), G.crosses("v", "t"), G.crosses("v", "o"), G.overlaps("v", "o"),
        G.contains("d", "h"), G.overlaps("d", "h"), G.crosses("p", "d"), G.crosses("d", "p"), G.contains("d", "q"), G.contains("d", "c"), G.crosses("c", "d"),
    ).first()
    assert list(r) == [False, True, True, True, False, False, True, False, False, True, True, True, False, False]


def test_overlay_against_sampling(spark):
    """Random polygons with holes: areas of all three overlays, and of their rings."""
    from terrane.operators.overlay import overlay

    rng = random.Random(6)
    star = lambda cx, cy, lo, hi: [(cx + d * math.cos(a), cy + d * math.sin(a)) for a, d in ((k * math.tau / 7, rng.uniform(lo, hi)) for k in range(7))]
    text = lambda rings: "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"
    rows = [tuple(text([star(cx, 0, 4, 6), star(cx, 0, 1, 2)]) for cx in (0, rng.uniform(0, 8))) for _ in range(25)]
    df = spark.createDataFrame(rows, "a string, b string").select(G.from_wkt("a").alias("a"), G.from_wkt("b").alias("b"))
    for how in ("intersection", "difference", "union"):
        for r in overlay(df, "a", "b", how).select(G.area("a").alias("x"), G.area("b").alias("y"), G.intersection_area("a", "b").alias("s"), G.overlay_area("a", "b", how).alias("m"), G.area("overlay").alias("g"), G.to_wkt("overlay").alias("t")).collect():
            want = {"intersection": r.s, "difference": r.x - r.s, "union": r.x + r.y - r.s}[how]
            assert (r.m, r.g) == (pytest.approx(want, abs=1e-6),) * 2
    near = df.select(G.intersection_area("a", "a").alias("s"), G.area("a").alias("x")).collect()
    assert all(r.s == pytest.approx(r.x) for r in near)


def test_rings_close_across_rounding():
    import numpy as np

    from terrane.functions import pieces

    e = 4e-10
    ax, ay, bx, by = (np.array(v) for v in zip((0, 0, 1, 0), (1 + e, e, 1, 1), (1 - e, 1, -e, 1 + e), (0, 1, 0, 0), strict=True))
    rings = pieces.chained(ax, ay, bx, by)
    assert len(rings) == 1 and pieces.ring_area(rings[0]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        pieces.chained(ax[:2], ay[:2], bx[:2], by[:2])


def test_inside_a_buffer(spark):
    df = _g(spark, p="POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.5, 5.0), (3, 12.0, 5.0), (4, 9.5, 5.0)], "i int, x double, y double")
    near = lambda **k: {r.i for r in J.near_geometry(pts, "x", "y", df, "p", 1.0, **k).collect()}
    assert near() == {1, 2, 4} and near(border_only=True) == {2, 4}


def test_label_point_is_inside(spark):
    shapes = {"l": "POLYGON ((0 0, 100 0, 100 8, 8 8, 8 100, 0 100, 0 0))", "thin": "POLYGON ((0 0, 100 100, 100 100.01, 0 0.01, 0 0))", "sq": "POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0))", "ring": "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 6, 6 6, 6 1, 1 1))"}
    df = spark.createDataFrame([*shapes.items(), ("none", None)], "k string, w string").select("k", G.from_wkt("w").alias("g"))
    got = {r.k: (r.x, r.y) for r in L.label_point(df, ["k"], "g").collect()}
    assert got["none"] == (None, None) and got["sq"] == (4.0, 4.0)
    inside = df.filter("g is not null").join(spark.createDataFrame([(k, *v) for k, v in got.items() if v[0] is not None], "k string, x double, y double"), "k").select("k", G.contains_point("g", "x", "y").alias("ok"), G.distance_to_point("g", "x", "y").alias("d")).collect()
    assert all(r.ok for r in inside)
    assert {r.k: r.d for r in inside}["ring"] == pytest.approx(1.757, abs=0.15)


def test_dissolve_and_axis_edge_cases(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.randint(0, 30), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(60)] + [("a", 0, 0, 60, 1), ("b", 5, 5, 0, 3), ("c", None, 1, 2, 2)]
    cells = {}
    for k, x, y, w, h in rows:
        if x is not None:
            cells.setdefault(k, set()).update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    df = spark.createDataFrame(rows, "k string, x int, y int, w int, h int").selectExpr("k", "x x0", "y y0", "x + w x1", "y + h y1")
    assert {r.k: r.area for r in A.dissolved_area(df, ["k"], ("x0", "y0", "x1", "y1")).collect()} == {k: float(len(v)) for k, v in cells.items()}
    assert A.dissolved_area(df.limit(0), ["k"], ("x0", "y0", "x1", "y1")).count() == 0
    values = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in A.axis_histogram(values, "v", 5).collect()] == [(0, 3.0, 3.0, 2)]
    assert A.axis_histogram(values.limit(0), "v", 5).count() == 0


def test_labels_without_a_row_number(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (None, 0, 0.5), (2, None, 9.0), (3, 0, 0.5), (3, 1, 5.0), (4, 0, 5.5)], "i long, c int, x double").selectExpr("*", "0.0 y0", "x + 1 x1", "1.0 y1")
    assert {(r.i, r.c) for r in Q.place_labels(df, "i", "c", ("x", "y0", "x1", "y1")).collect()} == {(1, 0), (3, 1)}
    assert Q.place_labels(df.limit(0), "i", "c", ("x", "y0", "x1", "y1")).count() == 0


def greedy(boxes):
    """(row, choice) of sequential placement by brute force."""
    meets = lambda p, q: p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1]
    taken, want = [], set()
    for i in sorted({b[0] for b in boxes}):
        for c in sorted({b[1] for b in boxes if b[0] == i}):
            own = [b[2:] for b in boxes if b[:2] == (i, c)]
            if not any(meets(b, t) for b in own for t in taken):
                taken += own
                want.add((i, c))
                break
    return want


@pytest.mark.parametrize("seed,tile,cell", [(1, 10, 64), (2, 25, 1), (3, 4, 2)])
def test_labels_over_many_tiles(spark, monkeypatch, seed, tile, cell):
    """Small tiles and crowded cells: wide boxes, a heap of equal ones, choices with two boxes."""
    from terrane.operators import placement as P

    monkeypatch.setattr(P, "TILE_BOXES", tile)
    monkeypatch.setattr(P, "CELL_BOXES", cell)
    monkeypatch.setattr(P, "MOST_OPEN", 40)
    rng = random.Random(seed)
    boxes = []
    for i in range(150):
        x, y, w = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([1.0, 2.0, 3.0, 15.0])
        if i % 3 == 0:
            x, y, w = 5.0, 5.0, 2.0
        boxes += [(i, c, x - c * w, y, x - c * w + w, y + 1.5) for c in range(rng.randint(1, 3))]
    boxes += [(7, 0, -19.0, -19.0, -18.0, -18.0), boxes[4]]
    df = spark.createDataFrame(boxes, "i long, c int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = [(r.i, r.c) for r in P.place_labels(df, "i", "c", ("x0", "y0", "x1", "y1")).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(boxes)


def test_labels_in_a_long_chain(spark):
    """100,000 labels, each in conflict with its neighbours in order: every other one stays, in three rounds at most."""
    from terrane.operators import placement as P

    rounds = []
    settle, P._settle = P._settle, lambda *a: rounds.append(1) or settle(*a)
    try:
        df = spark.range(100000).selectExpr("id i", "0 c", "id * 1.0D x0", "0.0D y0", "id + 1.5D x1", "1.0D y1")
        out = P.place_labels(df, "i", "c", ("x0", "y0", "x1", "y1"))
        assert out.count() == 50000 and out.filter("i % 2 = 1").count() == 0 and len(rounds) <= 3
    finally:
        P._settle = settle


def test_labels_named_by_text_and_bounds_that_are_no_numbers(spark):
    from terrane.operators import placement as P

    rows = [("b", 1, 0.0, 1.0), ("a", 1, 0.5, 1.5), ("c", 1, float("nan"), 1.0), ("d", 1, 0.0, float("inf")), ("e", 1, 9.0, 8.0)]
    df = spark.createDataFrame(rows, "r string, c int, x0 double, x1 double").selectExpr("*", "0 y0", "1 y1")
    assert {tuple(r) for r in P.place_labels(df, "r", "c", ("x0", "y0", "x1", "y1")).collect()} == {("a", 1), ("e", 1)}


def test_dissolved_area_of_boxes_on_one_another(spark):
    """Dense and crowded tiles against unit cells; what is shuffled follows the boxes, not their pairs."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 12), rng.randint(1, 12)) for _ in range(1500)]
    rows += [("stairs", 0, 0, i, 300 - i) for i in range(1, 300)] + [("corner", 0, 0, 7, 7)] * 40 + [("far", 500, 500, 3, 3)]
    cells = {}
    for k, x, y, w, h in rows:
        cells.setdefault(k, set()).update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    df = spark.createDataFrame(rows, "k string, x int, y int, w int, h int").selectExpr("k", "x x0", "y y0", "x + w x1", "y + h y1")
    for most in (20, A.TILE_BOXES):
        assert {r.k: r.area for r in A.dissolved_area(df, ["k"], ("x0", "y0", "x1", "y1"), most).collect()} == {k: float(len(v)) for k, v in cells.items()}
    stairs = spark.range(1, 3000).selectExpr("'s' k", "0D x0", "0D y0", "id * 1D x1", "3000D - id y1")
    before = shuffled_rows(spark)
    assert A.dissolved_area(stairs, ["k"], ("x0", "y0", "x1", "y1")).first().area == 2999.0 * 3000 / 2
    assert 0 < rows_since(spark, before) < 20 * 3000
