"""Edge index, arrangement and region operators against brute force and sampling."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane import workspace
from terrane.functions import arrangement, edge_index, pieces
from terrane.functions import geometry as G
from terrane.operators import aggregate as A
from terrane.operators import linear as L
from terrane.operators import region as R
from terrane.operators import spatial_join as J
from terrane.plans import queries
from terrane.sources import shapes as S

VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPE = pa.struct([("gtype", pa.int32()), ("parts", pa.list_(pa.list_(VERTEX)))])


def shape(kind, *parts):
    return {"gtype": kind, "parts": [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]}


def star(rng, n, x=0.0, y=0.0, low=0.5, high=3.0):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n)) * 0.1 + np.arange(n) * (2 * np.pi / n) * 0.9
    radius = rng.uniform(low, high, n)
    p = np.stack([x + radius * np.cos(angle), y + radius * np.sin(angle)], axis=1)
    return np.vstack([p, p[:1]])


def inside(polygons, x, y):
    odd = np.zeros(len(x), bool)
    for rings in polygons:
        for r in rings:
            for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
                if ay != by:
                    odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


def distance(parts, x, y):
    best = np.full(len(x), np.inf)
    for p in parts:
        for (ax, ay), (bx, by) in zip(p[:-1], p[1:], strict=True) if len(p) > 1 else [(p[0], p[0])]:
            dx, dy = bx - ax, by - ay
            q = dx * dx + dy * dy
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / q, 0, 1) if q else 0
            best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.mark.parametrize("whole", [0, 24])
def test_near_pairs(monkeypatch, whole):
    monkeypatch.setattr(edge_index, "WHOLE", whole)
    monkeypatch.setattr(edge_index, "PRODUCT", 500)
    rng = np.random.default_rng(4)
    first = np.array([0, 30, 30, 75, 200])
    sides = []
    for _ in range(2):
        a, d = rng.uniform(-5, 5, (200, 2)), rng.normal(0, 1, (200, 2)) * rng.choice([0.0, 0.1, 4], (200, 2))
        sides.append(edge_index.Edges(a[:, 0], a[:, 1], a[:, 0] + d[:, 0], a[:, 1] + d[:, 1], first))
    got = set(zip(*(v.tolist() for v in edge_index.near_pairs(*sides, np.full(4, 1e-9))), strict=True))
    for row in range(4):
        lo, hi = first[row], first[row + 1]
        for i in range(lo, hi):
            for j in range(lo, hi):
                a, b = ([v[k] for v in (e.ax, e.ay, e.bx, e.by)] for e, k in ((sides[0], i), (sides[1], j)))
                s = [(p[0] - q[0]) * (q[3] - q[1]) - (p[1] - q[1]) * (q[2] - q[0]) for p, q in ((a, b), (a[2:] + a[:2], b), (b, a), (b[2:] + b[:2], a))]
                if s[0] * s[1] < 0 and s[2] * s[3] < 0:
                    assert (i, j) in got


def test_large_rings():
    """Two rings of 50,000 corners, in memory that grows with the corners."""
    import tracemalloc

    rng = np.random.default_rng(1)
    sides = []
    for x in (0.0, 3.0):
        angle, radius = np.linspace(0, 2 * np.pi, 50_001)[:-1], 10 + rng.uniform(-0.001, 0.001, 50_000)
        px, py = x + radius * np.cos(angle), radius * np.sin(angle)
        sides.append(edge_index.Edges(px, py, np.roll(px, -1), np.roll(py, -1), np.array([0, 50_000])))
    tracemalloc.start()
    area = pieces.enclosed(pieces.bounding(pieces.meet(*sides), "intersection"))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lens = 2 * 100 * np.arccos(3 / 20) - 1.5 * np.sqrt(4 * 100 - 9)
    assert area == pytest.approx(lens, rel=1e-3) and peak < 300e6


@pytest.mark.parametrize("seed", range(8))
def test_buffers_by_sampling(seed):
    rng = np.random.default_rng(seed)
    made, amounts, parts = [], [], []
    for k in range(12):
        kind = [3, 2, 5, 4][k % 4]
        p = [star(rng, rng.integers(3, 20))] if kind == 3 else [rng.uniform(-3, 3, (rng.integers(2, 9) if kind != 4 else 1, 2)) for _ in range(1 if kind == 2 else 3)]
        parts.append(p)
        made.append(shape(kind, *p))
        amounts.append(rng.choice([0.1, 0.5, 1.5, *([-0.2, -0.6] if kind == 3 else [])]))
    found = arrangement.buffers(pa.array(made, SHAPE), np.array(amounts), quarter=32)
    for p, s, d, polygons in zip(parts, made, amounts, found, strict=True):
        x, y = rng.uniform(-5, 5, (2, 500))
        far = distance(p, x, y)
        if s["gtype"] == 3:
            far = np.where(inside([p], x, y), -far, far)
        sure = np.abs(far - d) > 0.005
        assert (inside(polygons, x, y) == (far < d))[sure].all()


def test_buffer_forms(spark):
    square = [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    rows = [(1, shape(3, square), 1.0), (2, shape(3, square, hole), 0.6), (3, shape(3, square), -2.0), (4, None, 1.0), (5, shape(3, square), None), (6, shape(2, square[:2]), -1.0), (7, shape(3), 1.0), (8, shape(1, [(3, 4)]), 2.0), (9, shape(7, [(0, 0)], square[:2]), 1.0), (10, shape(3, square[::-1]), 0.0)]
    df = spark.createDataFrame(rows, "id int, g struct<gtype:int,parts:array<array<struct<x:double,y:double>>>>, d double").withColumn("g", F.when(F.col("g").isNotNull(), G.geometry(F.col("g.gtype"), F.col("g.parts"))))
    got = {r.id: r for r in R.buffer_polygons(df, "g", "d").select("id", F.col("buffer").isNull().alias("none"), F.size("buffer.parts").alias("n"), F.coalesce(G.area("buffer"), F.lit(0.0)).alias("a")).collect()}
    circle = 16 * np.sin(np.pi / 16)
    assert got[1].a == pytest.approx(12 + 14 + circle) and got[2].a == pytest.approx(12 + 14 * 0.6 + circle * 0.36) and got[2].n == 1
    assert [got[k].n for k in (3, 6, 7)] == [0, 0, 0] and [got[k].none for k in (4, 5, 9)] == [True] * 3
    assert got[8].a == pytest.approx(circle * 4) and got[10].a == pytest.approx(12)
    with pytest.raises(ValueError):
        R.buffer_polygons(df, "g", 1.0, caps="flat")


def _regions(spark, polygons, groups):
    rows = [(g, shape(3, p)) for g, p in zip(groups, polygons, strict=True)]
    return spark.createDataFrame(rows, "k string, g struct<gtype:int,parts:array<array<struct<x:double,y:double>>>>").withColumn("g", G.geometry(F.col("g.gtype"), F.col("g.parts")))


def _rings(region):
    return [[np.array([(v.x, v.y) for v in p]) for p in region.parts]]


def test_dissolve_by_sampling(spark):
    """10,000 polygons of one group and one crowded place, and a small group."""
    rng = np.random.default_rng(3)
    polygons = [star(rng, 5, *(rng.uniform(0, 60, 2) if k % 4 else rng.uniform(20, 22, 2)), 0.3, 0.9) for k in range(10_000)]
    small = [star(rng, 6, x, 0, 0.3, 0.9) for x in range(5)]
    df = _regions(spark, polygons + small + small[:1], ["a"] * 10_000 + [None] * 6)
    got = {r.k: r.region for r in R.dissolve(df, ["k"], "g").collect()}
    assert set(got) == {"a", None}
    for key, own, span in (("a", polygons, 60), (None, small, 5)):
        x, y = rng.uniform(-1, span + 1, 1500), rng.uniform(-1, min(span, 60) + 1, 1500)
        want = np.zeros(len(x), bool)
        for p in own:
            near = np.flatnonzero((np.abs(x - p[:, 0].mean()) < 2) & (np.abs(y - p[:, 1].mean()) < 2))
            want[near] |= inside([[p]], x[near], y[near])
        assert (inside(_rings(got[key]), x, y) == want).all()
    assert R.dissolve(df.limit(0), ["k"], "g").count() == 0


@pytest.mark.parametrize("joints", ["round", "mitre"])
def test_offset_lines(joints):
    rng = np.random.default_rng(7)
    for _ in range(80):
        p = rng.uniform(-3, 3, (rng.integers(2, 9), 2))
        d = float(rng.choice([-1, -0.3, 0.3, 1]))
        e = arrangement.line_offsets(pa.array([shape(2, p)], SHAPE), np.array([d]), 32, joints == "mitre")
        lines = arrangement.strung(e.ax, e.ay, e.bx, e.by)
        for line in lines:
            far = distance([p], line[:, 0], line[:, 1])
            assert (far > abs(d) * 0.998).all() and (joints == "mitre" or (far < abs(d) * 1.002).all())
        every = np.concatenate([np.hstack([v[:-1], v[1:]]) for v in lines]) if lines else np.zeros((0, 4))
        side = lambda s, x, y: (s[:, None, 2] - s[:, None, 0]) * (y - s[:, None, 1]) - (s[:, None, 3] - s[:, None, 1]) * (x - s[:, None, 0])
        a, b = (side(every, every[None, :, k], every[None, :, k + 1]) for k in (0, 2))
        apart = (a * b < 0) & (np.minimum(np.abs(a), np.abs(b)) > 1e-6)
        assert not (apart & apart.T).any()  # nothing crosses itself


def test_offset_of_bends(spark):
    rows = [(1, k, *p) for k, p in enumerate([(0, 0), (10, 0), (10, 1), (0, 1)])] + [(2, 0, 5, 5)] + [(3, k, *p) for k, p in enumerate([(0, 0), (10, 0), (10, 10)])]
    v = spark.createDataFrame([(a, b, float(x), float(y)) for a, b, x, y in rows], "id int, pos0 int, x double, y double")
    assert L.offset_line(v, ["id"], ["pos0"], -2.0).filter("id <> 3").count() == 0  # all of it would be too near
    bend = [(r.x, r.y) for r in L.offset_line(v, ["id"], ["pos0"], -2.0).filter("id = 3").orderBy("part", "pos").collect()]
    assert bend == [pytest.approx((0, 2)), pytest.approx((8, 2)), pytest.approx((8, 10))]


def _lines(spark, copies):
    """Five zigzags and a line of one place, as vertices, each ``copies`` times."""
    rng = np.random.default_rng(11)
    shapes = [rng.uniform(-5, 5, (n, 2)).tolist() for n in (2, 3, 4, 6, 7)] + [[(1.0, 1.0), (1.0, 1.0)]]
    rows = [(6 * c + i, k, *p) for c in range(copies) for i, v in enumerate(shapes) for k, p in enumerate(v)]
    return spark.createDataFrame(rows, "id int, pos0 int, x double, y double")


def test_equal_lines_are_offset_once(spark):
    v, dealt = _lines(spark, 100), []
    spread = workspace.spread_alike

    def seen(df, *rest):
        dealt.append(spread(df, *rest))
        return dealt[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(L, "spread_alike", seen)
        whole = L.offset_line(v, ["id"], ["pos0"], 0.5)
    got = {}
    for r in whole.orderBy("id", "part", "pos").collect():
        got.setdefault(r.id, []).append((r.part, r.pos, r.x, r.y))
    assert len(got) == 500 and all(got[i] == got[i % 6] for i in got)
    for i in range(5):
        p = np.array([(r.x, r.y) for r in v.filter(F.col("id") == i).orderBy("pos0").collect()])
        e = arrangement.line_offsets(pa.array([shape(2, p)], SHAPE), np.array([0.5]), 8, True)
        lines = arrangement.strung(e.ax, e.ay, e.bx, e.by)
        assert [r[2:] for r in got[i]] == [tuple(q) for line in lines for q in line.tolist()]
    # Equal lines follow one another in their tasks, and are several tasks' work.
    rows = dealt[0].select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.col("__line.parts").cast("string").alias("g")).orderBy("at").collect()
    runs = [b for a, b in zip([None, *rows], rows, strict=False) if a is None or (a.task, a.g) != (b.task, b.g)]
    assert len(rows) == 600 and len({r.task for r in rows}) > 1 and len(runs) <= 6 * workspace.SHARES


def test_lines_are_strung_together_as_one_by_one():
    rng = np.random.default_rng(6)
    corner = lambda k: [(k * 10 + x, y) for x, y in ((0, 0), (1, 0), (2, 0), (2, 2), (0, 2))]
    rows = []
    for k in range(60):
        c = corner(0) + corner(1)
        closed = [*zip(c[:5], [*c[1:5], c[0]], strict=True)]
        open_ = [*zip(c[5:], c[6:], strict=False)]
        crossed = [(c[0], c[7]), (c[7], c[0]), (c[3], c[7])]  # two edges end at one corner
        some = [[], closed, open_, closed + open_, crossed + open_, open_ + crossed + closed][k % 6]
        rows.append(np.array([some[i] for i in rng.permutation(len(some))], float).reshape(-1, 4))
    flat = np.concatenate(rows)
    e = edge_index.Edges(*flat.T, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for got, r in zip(arrangement.strung_rows(e), rows, strict=True):
        want = arrangement.strung(*r.T)
        assert [g.tolist() for g in got] == [w.tolist() for w in want]
    assert arrangement.strung_rows(e.slice(0, 1)) == [[]]


def test_geometries_that_repeat_the_one_before():
    a, b, c = shape(2, [(0, 0), (1, 1), (2, 0)]), shape(2, [(0, 0), (1, 1), (2, 1)]), shape(5, [(0, 0), (1, 1)], [(2, 0)])
    d, e = shape(5, [(0, 0)], [(1, 1), (2, 0)]), shape(5)
    rows = [a, a, b, b, b, a, c, c, d, d, e, e, None, None, {**a, "gtype": 4}]
    assert pieces.repeats(pa.array(rows, SHAPE)).tolist() == [bool(i and rows[i] == rows[i - 1]) for i in range(len(rows))]
    assert pieces.repeats(pa.array(rows, SHAPE).slice(1, 4)).tolist() == [False, False, True, True]


def test_vertices_off_a_distance(spark):
    rng = np.random.default_rng(13)
    lines = [[rng.uniform(-3, 3, (n, 2)) for n in sizes] for sizes in ((2,), (5,), (1,), (3, 2), (4, 1))]
    points = [[rng.uniform(-4, 4, (n, 2))] for n in (7, 1, 4, 9, 5)]
    of = lambda parts: {**shape(5, *parts), **dict.fromkeys(("xmin", "ymin", "xmax", "ymax"), 0.0)}
    rows = [(i, of(points[i % 5]), of(lines[i % 5])) for i in (0, 0, 1, 2, 2, 2, 3, 4)] + [(9, None, of(lines[0])), (9, of(points[0]), None)]
    df = spark.createDataFrame(rows, f"i int, p {G.SCHEMA}, g {G.SCHEMA}").coalesce(1)
    got = [tuple(r) for r in df.select("i", G.vertices_off("p", "g", 1.0, 0.6).alias("n")).collect()]
    want = [(i, None if i == 9 else int((np.abs(distance(lines[i], *points[i][0].T) - 1) > 0.6).sum())) for i, _, _ in rows]
    assert got == want and sum(n for _, n in got if n)


def test_hatch_by_sampling(spark):
    rng = np.random.default_rng(8)
    polygons = [star(rng, 12) for _ in range(6)]
    df = _regions(spark, polygons, [str(k) for k in range(6)]).withColumnRenamed("k", "id")
    got = R.hatch(df, ["id"], "g", 0.3, 30.0).collect()
    for r in got:
        t = np.array([0.01, 0.5, 0.99])
        assert inside([[polygons[int(r[0])]]], r.ax + t * (r.bx - r.ax), r.ay + t * (r.by - r.ay)).all()
        assert np.degrees(np.arctan2(r.by - r.ay, r.bx - r.ax)) == pytest.approx(30)
    for k, p in enumerate(polygons):
        area = abs(pieces.ring_area(p))
        total = sum(np.hypot(r.bx - r.ax, r.by - r.ay) for r in got if r[0] == str(k))
        assert total * 0.3 == pytest.approx(area, rel=0.15)
    with pytest.raises(ValueError):
        R.hatch(df, ["id"], "g", 0.0)


def test_relations_of_parts():
    rel = lambda a, b: {k: (None if v.mask[0] else bool(v.data[0])) for k, v in pieces.relations(pa.array([a], SHAPE), pa.array([b], SHAPE)).items()}
    two = shape(5, [(0, 0), (1, 0)], [(5, 5), (6, 5)])
    assert not rel(two, shape(2, [(1, -1), (1, 1)]))["crosses"]  # an end of the first part
    assert rel(two, shape(2, [(0.5, -1), (0.5, 1)]))["crosses"]
    joined = shape(5, [(0, 0), (1, 0)], [(1, 0), (2, 0)])
    assert rel(joined, shape(2, [(1, -1), (1, 1)]))["crosses"]  # ends that meet are none
    assert rel(shape(1, [(1, 2)]), shape(1, [(1, 2)])) == {"contains": True, "overlaps": False, "crosses": False}
    assert rel(shape(4, [(1, 2)], [(3, 4)]), shape(4, [(3, 4)], [(5, 6)]))["overlaps"]
    assert set(rel(shape(7, [(1, 2)]), two).values()) == {None}


def test_axis_around_zero():
    assert A.nice_axis(-1, 1, 1) == [-1, 1] and A.nice_axis(-3, 1, 1) == [-5, 5] and A.nice_axis(2, 7, 1) == [0, 10]
    assert A.nice_axis(-1e-7, 2e-7, 3) == pytest.approx([-1e-7, 0, 1e-7, 2e-7])


def test_points_at_no_distance(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "i int, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 1.0), (8, 1.0, 2.0)], "j int, u double, v double")
    assert [(r.i, r.j) for r in J.within_distance(a, "x", "y", b, "u", "v", 0.0).collect()] == [(2, 7)]
    with pytest.raises(ValueError):
        J.within_distance(a, "x", "y", b, "u", "v", -1.0)


def test_first_of_ties(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    q = spark.createDataFrame([(3, 1), (2, 1), (4, 0)], "code int, rank int").withColumn("g", G.make_box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))).filter("code < 4")
    assert J.pip_join(p, "x", "y", q, "g", point_id="id", first_by="rank").first().code == 2


def test_binary_of_odd_values():
    with pytest.raises(ValueError):
        S.encode_wkb(7, [[{"x": 1.0, "y": 2.0}]])
    assert len(S.encode_wkb(1, [])) == 21


def test_banded_points(spark):
    """Points on a grid against a ring of many corners, holes and small polygons, borders included."""
    rng = np.random.default_rng(2)
    big, hole = star(rng, 2000, 4, 4, 3, 5), star(rng, 50, 4, 4, 1, 2)[::-1]
    rows = [(0, shape(3, big, hole)), (1, shape(3, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])), (2, shape(6, [(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)], [(7, 7), (8, 7), (7, 8), (7, 7)])), (3, None), (1, shape(3, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]))]
    polys = spark.createDataFrame(rows, "code int, g struct<gtype:int,parts:array<array<struct<x:double,y:double>>>>").withColumn("g", F.when(F.col("g").isNotNull(), G.geometry(F.col("g.gtype"), F.col("g.parts"))))
    x, y = (v.reshape(-1) for v in np.meshgrid(np.arange(0, 9, 0.25), np.arange(0, 9, 0.25)))
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0)], "id int, x double, y double")
    got = sorted((r.id, r.code) for r in J.pip_join(points, "x", "y", polys, "g").collect())
    want = []
    for code, s in rows:
        if s:
            rings = [np.array([(v["x"], v["y"]) for v in p]) for p in s["parts"]]
            ok = inside([rings], x, y) & (distance(rings, x, y) > 0)
            want += [(k, code) for k in np.flatnonzero(ok).tolist()]
    assert got == sorted(want)
    assert J.pip_join(points, "x", "y", polys.limit(0), "g").count() == 0
    circle = spark.range(1).select("id", G.make_circle(F.lit(3.0), F.lit(4.0), F.lit(10.0), 400).alias("g"))
    whole, most = J.cells_inside(circle, "g", "id", 1.0).select(F.count_if(F.col("__edges").isNull()), F.max(F.size("__edges"))).first()
    assert whole > 20 and most < 40


def test_sums_over_ranges(spark):
    """One group of all rows, an uneven one, a null one."""
    rng = np.random.default_rng(4)
    rows = [("a", k, float(v)) for k, v in enumerate(rng.integers(-3, 9, 3000))] + [("b", 1, 2.0), (None, 2, 3.0), (None, 1, 4.0), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(5)
    got = {(r.k, r.o): (r.counter, r.accumulated) for r in A.running(df, ["k"], ["o"], "v").collect()}
    want = {}
    for key in ("a", "b", None):
        total = 0.0
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            total += v or 0.0
            want[key, o] = (n + 1, total)
    assert got == want
    assert A.numbered(df, ["k"], ["o"], "v").select("k", F.spark_partition_id()).distinct().count() > 3
    assert A.thin(df.filter("k = 'a'"), ["k"], ["o"], 7).count() == -(-3000 // 7)
    shares = A.share_of_total(df, ["k"], ["o"], "v").filter("k = 'a'").agg(F.sum("share"), F.max(F.col("share") + F.col("start"))).first()
    assert shares[0] == pytest.approx(360) and shares[1] == pytest.approx(360)
    assert A.running(df.limit(0), ["k"], ["o"], "v").count() == 0


def test_points_at_one_place_are_tested_once(spark, monkeypatch):
    inside = J._strictly_inside

    def once(x, *rest):
        if len(x) > 1:
            raise ValueError("one place and one polygon, but more rows")
        return inside(x, *rest)

    monkeypatch.setattr(J, "_strictly_inside", once)
    polys = spark.range(1).select(F.lit(7).alias("code"), G.make_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("g"))
    points = spark.range(0, 50, 1, 1).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    for how, first_by, rows in (("left", None, 50), ("semi", None, 50), ("anti", None, 0), ("inner", "code", 50)):
        assert J.pip_join(points, "x", "y", polys, "g", how=how, point_id="id", first_by=first_by).count() == rows


def test_left_join_of_points_with_one_id_or_no_place(spark):
    polys = spark.range(1).select(F.lit(7).alias("code"), G.make_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("g"))
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 5.0), (2, None, 1.0)], "id long, x double, y double")
    got = J.pip_join(points, "x", "y", polys, "g", how="left", point_id="id").select("id", "x", "code").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1.0, 7), (1, 5.0, None), (2, None, None)], key=str)
    assert J.pip_join(points, "x", "y", polys, "g", how="anti", point_id="id").count() == 2


def _squares(spark, name, n, of):
    """n boxes of many widths, at ``of`` places."""
    k = F.col("id") % of
    x, y, w = (k * 37 % 101) / 10.0, (k * 53 % 89) / 10.0, F.pow(F.lit(2.0), k % 6 - 3)
    return spark.range(n).select(F.col("id").alias(name), G.make_box(x, y, x + w, y + w).alias(f"g{name}"))


def test_boxes_of_many_levels_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(J, "FEW_ROWS", 10, raising=False)
    a, b = _squares(spark, "a", 120, 120), _squares(spark, "b", 90, 77)
    pairs = J.bbox_join(a, "ga", b, "gb")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    box = {n: [(r[0], r[1]) for r in df.collect()] for n, df in (("a", a), ("b", b))}
    want = [(i, j) for i, g in box["a"] for j, h in box["b"] if g.xmin <= h.xmax and h.xmin <= g.xmax and g.ymin <= h.ymax and h.ymin <= g.ymax]
    assert sorted(map(tuple, pairs.select("a", "b").collect())) == sorted(want)


def test_equal_shapes_are_compared_once(spark, monkeypatch):
    a, b = _squares(spark, "a", 120, 12), _squares(spark, "b", 40, 40)
    want = sorted(map(tuple, J.predicate_join(a, "ga", b, "gb", "overlaps").select("a", "b").collect()))
    monkeypatch.setattr(J, "FEW_ROWS", 10, raising=False)
    joined, rows = J.bbox_join, []

    def counted(left, *rest):
        rows.append(left.count())
        return joined(left, *rest)

    monkeypatch.setattr(J, "bbox_join", counted)
    assert sorted(map(tuple, J.predicate_join(a, "ga", b, "gb", "overlaps").select("a", "b").collect())) == want and want
    assert rows == [12]


@pytest.fixture
def copies(spark, tmp_path):
    """A part table of 20 diamonds, each 70 times."""
    k, copy = F.col("id") % 20, F.floor(F.col("id") / 20)
    part = spark.range(1400).select((k + 36000 * copy).alias("p_partkey"), F.lit("b").alias("p_brand"), (k * 7 % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def _of_copies(spark, copies, monkeypatch, name):
    """A query's rows, those of its SQL, and how many boxes were joined."""
    joined, rows = J.bbox_join, []

    def counted(left, *rest):
        rows.append(left.count())
        return joined(left, *rest)

    monkeypatch.setattr(J, "bbox_join", counted)
    got = queries.QUERIES[name](spark, copies)
    db = duckdb.connect()
    db.sql(f"create view part as select * from '{copies}/part.parquet/*.parquet'")
    want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want), rows


def test_overlays_of_copies_are_measured_once(spark, copies, monkeypatch):
    got, want, rows = _of_copies(spark, copies, monkeypatch, "diamond_overlay")
    assert rows == [40]  # 70 keys are two lists
    assert len(got) == len(want) and np.abs(np.array(got) - np.array(want)).max() < 1.5e-4


def test_boxes_of_copies_are_joined_once(spark, copies, monkeypatch):
    got, want, rows = _of_copies(spark, copies, monkeypatch, "bbox_join")
    assert rows == [40] and got == want


def test_areas_of_convex_rings():
    rng = np.random.default_rng(12)

    def rings(n):
        angle, r = np.sort(rng.uniform(0, 2 * np.pi, (300, n)), axis=1), rng.uniform(1, 5, (300, 1))
        x, y = (rng.uniform(-4, 4, (300, 1)) + r * f(angle) for f in (np.cos, np.sin))
        return edge_index.Edges(x.ravel(), y.ravel(), np.roll(x, -1, 1).ravel(), np.roll(y, -1, 1).ravel(), np.arange(301) * n)

    for n, m in ((3, 4), (9, 5)):
        a, b = rings(n), rings(m)
        assert pieces.convex(a).all()
        want = pieces.enclosed(pieces.bounding(pieces.meet(a, b), "intersection"))
        assert np.abs(pieces.convex_shared(a, b) - want).max() < 1e-12 and ((pieces.convex_shared(a, b) > 0) == (want > 0)).all()
    # Turned squares: side by side, corner to corner, the same, one in the other, apart.
    c, s = np.cos(0.3), np.sin(0.3)
    square = lambda x, y, w=1.0: shape(3, [(c * p - s * q + 7, s * p + c * q + 9) for p, q in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))])
    a, b = pa.array([square(0, 0)] * 5, SHAPE), pa.array([square(1, 0), square(1, 1), square(0, 0), square(0.25, 0.25, 0.5), square(3, 0)], SHAPE)
    assert pieces.shared(pieces.edges(a), pieces.edges(b)).tolist() == pytest.approx([0, 0, 1, 0.25, 0], abs=1e-12)
    assert (pieces.shared(pieces.edges(a), pieces.edges(b)) > 0).tolist() == [False, False, True, True, False]
    # Two ways around (a star of five corners), a bent shape, and several rings are not convex.
    five = [(np.cos(4 * np.pi * k / 5), np.sin(4 * np.pi * k / 5)) for k in range(5)]
    bent = shape(3, [(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2), (0, 0)])
    hole = shape(3, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)])
    assert not pieces.convex(pieces.edges(pa.array([shape(3, [*five, five[0]]), bent, hole, shape(3)], SHAPE))).any()
    assert pieces.shared(*[pieces.edges(pa.array(v, SHAPE)) for v in ([hole, square(0, 0)], [shape(3, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), square(0.5, 0)])]).tolist() == pytest.approx([3, 0.5])


def test_heavy_rows_of_one_task_are_dealt_out(spark):

    few = spark.range(0, 200, 1, 1).select("id", G.make_box(F.col("id") * 1.0, F.lit(0.0), F.col("id") + 1.0, F.lit(1.0)).alias("g"))
    used = L.label_point(few, ["id"], "g").select("id", F.spark_partition_id().alias("p"))
    assert used.select("p").distinct().count() > 1 and used.count() == 200


def test_rings_walked_and_shapes_in_arrays():

    from terrane.operators import overlay

    rng = np.random.default_rng(3)
    rows = [shape(3, star(rng, 12, 0, 0, 1, 3)), shape(3, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]), shape(6, [(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)])]
    shapes = pa.array([{**r, **dict.fromkeys(("xmin", "ymin", "xmax", "ymax"), 0.0)} for r in rows], overlay.SHAPE)
    e = arrangement.offset_outlines(shapes, np.full(3, 0.4))
    b = arrangement.bounding(e)
    assert arrangement._followers(b)[1].all()
    want = [overlay.shape_of(pieces.nested(pieces.chained(b.ax[i:j], b.ay[i:j], b.bx[i:j], b.by[i:j]))) for i, j in zip(b.first[:-1], b.first[1:], strict=True)]
    got = arrangement.regions(e)
    assert [[len(r) for p in g for r in p] for g in got] == [[len(r) for r in w["parts"]] for w in want]
    assert overlay.polygon_array([*got, None, []]).equals(pa.array([*want, None, overlay.shape_of([])], overlay.SHAPE))
