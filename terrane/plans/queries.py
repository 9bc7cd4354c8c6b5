"""Registered queries over the derived layers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import projection as P
from terrane.functions import scalars as S
from terrane.operators import aggregate as A
from terrane.operators import linear as L
from terrane.operators import placement as Q
from terrane.operators import rows as R
from terrane.operators import spatial_join as J
from terrane.plans.layers import PATH_ORDER, customer_points, nation_cells, order_paths, part_diamonds, supplier_points, table, user_tracks, with_layers
from terrane.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(c) -> F.Column:
    return F.round(c, 4)


# --- joins -------------------------------------------------------------------


@query(with_layers("cust cells", "SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS total_acctbal FROM cust JOIN cells ON x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY n_name"))
def pip_count_by_nation(spark, d):
    pairs = J.pip_join(customer_points(spark, d), "x", "y", nation_cells(spark, d), "cell", base=64.0)
    return pairs.groupBy("n_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("total_acctbal"))


IN_DIAMOND = "abs(x-cx) + abs(y-cy) < r"


@query(with_layers("cust dia", f"SELECT c_custkey, p_partkey FROM cust LEFT JOIN dia ON {IN_DIAMOND}"))
def pip_left(spark, d):
    return J.pip_join(customer_points(spark, d), "x", "y", part_diamonds(spark, d), "diamond", how="left", point_id="c_custkey").select("c_custkey", "p_partkey")


@query(with_layers("cust dia", f"SELECT c_custkey, c_name FROM cust WHERE EXISTS (SELECT 1 FROM dia WHERE {IN_DIAMOND})"))
def pip_semi(spark, d):
    return J.pip_join(customer_points(spark, d), "x", "y", part_diamonds(spark, d), "diamond", how="semi", point_id="c_custkey").select("c_custkey", "c_name")


@query(with_layers("cust dia", f"SELECT c_custkey, c_name FROM cust WHERE NOT EXISTS (SELECT 1 FROM dia WHERE {IN_DIAMOND})"))
def pip_anti(spark, d):
    return J.pip_join(customer_points(spark, d), "x", "y", part_diamonds(spark, d), "diamond", how="anti", point_id="c_custkey").select("c_custkey", "c_name")


@query(with_layers("cust dia", f"SELECT c_custkey, min(p_partkey) AS p_partkey FROM cust JOIN dia ON {IN_DIAMOND} GROUP BY c_custkey"))
def pip_first_match(spark, d):
    return J.pip_join(customer_points(spark, d), "x", "y", part_diamonds(spark, d), "diamond", point_id="c_custkey", first_by="p_partkey").select("c_custkey", "p_partkey")


@query(with_layers("dia", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM dia a JOIN dia b ON a.p_partkey < b.p_partkey AND abs(a.cx-b.cx) <= a.r+b.r AND abs(a.cy-b.cy) <= a.r+b.r"))
def bbox_join(spark, d):
    box = F.struct(*[F.col("diamond")[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    boxes = Workspace(spark, "boxes").keep(J.listed(part_diamonds(spark, d).select("p_partkey", box.alias("box")), "p_partkey", "box", "keys"), "boxes")
    a, b = (boxes.select(F.col("keys").alias(f"{k}s"), F.col("box").alias(f"g{k}")) for k in "ab")
    return J.pairs_of(J.ascending(J.bbox_join(a, "ga", b, "gb"), "as", "bs"), "as", "a", "bs", "b")


@query(with_layers("cust supp", "SELECT s_suppkey, c_custkey FROM supp, cust WHERE (sx-x)*(sx-x)+(sy-y)*(sy-y) <= 5.003*5.003"))
def within_distance(spark, d):
    return J.within_distance(supplier_points(spark, d), "sx", "sy", customer_points(spark, d), "x", "y", 5.003).select("s_suppkey", "c_custkey")


@query(with_layers("cust cells", """SELECT c_custkey, n_nationkey FROM cust, cells WHERE
 CASE WHEN x > xmin AND x < xmax AND y > ymin AND y < ymax THEN least(x-xmin, xmax-x, y-ymin, ymax-y)
 ELSE sqrt(pow(greatest(xmin-x, 0, x-xmax), 2) + pow(greatest(ymin-y, 0, y-ymax), 2)) END <= 1.0033"""))
def near_border(spark, d):
    return J.near_geometry(customer_points(spark, d), "x", "y", nation_cells(spark, d), "cell", 1.0033, border_only=True).select("c_custkey", "n_nationkey")


@query(with_layers("cells dia", "SELECT n_nationkey, p_partkey FROM cells, dia WHERE cx-r >= xmin AND cx+r <= xmax AND cy-r >= ymin AND cy+r <= ymax"))
def contains_join(spark, d):
    return J.predicate_join(nation_cells(spark, d), "cell", part_diamonds(spark, d), "diamond", "contains", 16.0).select("n_nationkey", "p_partkey")


@query(with_layers("cells dia", """SELECT n_nationkey, p_partkey FROM cells, dia WHERE greatest(xmin-cx, 0, cx-xmax) + greatest(ymin-cy, 0, cy-ymax) < r
 AND NOT (cx-r >= xmin AND cx+r <= xmax AND cy-r >= ymin AND cy+r <= ymax)"""))
def overlaps_join(spark, d):
    return J.predicate_join(nation_cells(spark, d), "cell", part_diamonds(spark, d), "diamond", "overlaps", 16.0).select("n_nationkey", "p_partkey")


CROSS_SQL = """, e AS (SELECT *, sx AS ax, sy AS ay, 7.013 AS dx, 3.017 AS dy FROM supp), t AS (SELECT s_suppkey, n_nationkey,
 greatest(0, (xmin-ax)/dx, (ymin-ay)/dy) AS t0, least(1, (xmax-ax)/dx, (ymax-ay)/dy) AS t1 FROM e, cells)
 SELECT s_suppkey, n_nationkey FROM t WHERE t0 < t1 AND (t0 > 0 OR t1 < 1)"""


@query(with_layers("supp cells", "").rstrip() + CROSS_SQL)
def crosses_join(spark, d):
    line = G.make_line(F.array(G.vertex("sx", "sy"), G.vertex(F.col("sx") + 7.013, F.col("sy") + 3.017)))
    lines = supplier_points(spark, d).select("s_suppkey", line.alias("line"))
    return J.predicate_join(lines, "line", nation_cells(spark, d), "cell", "crosses").select("s_suppkey", "n_nationkey")


@query(with_layers("cells", """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round((least(a.xmax, b.xmax+10.3)-greatest(a.xmin, b.xmin+10.3))*(least(a.ymax, b.ymax+7.1)-greatest(a.ymin, b.ymin+7.1)), 4) AS area
 FROM cells a, cells b WHERE least(a.xmax, b.xmax+10.3) > greatest(a.xmin, b.xmin+10.3) AND least(a.ymax, b.ymax+7.1) > greatest(a.ymin, b.ymin+7.1)"""))
def rect_overlap_area(spark, d):
    a = nation_cells(spark, d).select(F.col("n_nationkey").alias("a"), F.col("cell").alias("ga"))
    b = nation_cells(spark, d, 10.3, 7.1).select(F.col("n_nationkey").alias("b"), F.col("cell").alias("gb"))
    return J.bbox_join(a, "ga", b, "gb", 64.0).select("a", "b", r4(G.intersection_area("ga", "gb")).alias("area")).filter("area > 0")


@query(with_layers("dia", """SELECT a, b, round(u*v/2, 4) AS shared, round(2*ra*ra - u*v/2, 4) AS only_a, round(2*ra*ra + 2*rb*rb - u*v/2, 4) AS either FROM
 (SELECT a.p_partkey AS a, b.p_partkey AS b, a.r AS ra, b.r AS rb,
 least(a.cx+a.cy+a.r, b.cx+b.cy+b.r)-greatest(a.cx+a.cy-a.r, b.cx+b.cy-b.r) AS u, least(a.cx-a.cy+a.r, b.cx-b.cy+b.r)-greatest(a.cx-a.cy-a.r, b.cx-b.cy-b.r) AS v
 FROM dia a JOIN dia b ON a.p_partkey < b.p_partkey) WHERE u > 0 AND v > 0"""))
def diamond_overlay(spark, d):
    shapes = J.listed(part_diamonds(spark, d), "p_partkey", "diamond", "keys").withColumn("area", G.area("diamond"))
    shapes = Workspace(spark, "diamonds").keep(shapes, "shapes")
    a, b = (shapes.select(F.col("keys").alias(f"{k}s"), F.col("diamond").alias(f"g{k}"), F.col("area").alias(f"area_{k}")) for k in "ab")
    met = J.ascending(J.bbox_join(a, "ga", b, "gb"), "as", "bs").withColumn("s", G.intersection_area("ga", "gb")).filter("s > 0")
    sizes = met.select("as", "bs", r4("s").alias("shared"), r4(F.col("area_a") - F.col("s")).alias("only_a"), r4(F.col("area_a") + F.col("area_b") - F.col("s")).alias("either"))
    return J.pairs_of(sizes, "as", "a", "bs", "b", "shared", "only_a", "either")


# --- lines and rings ---------------------------------------------------------


@query(with_layers("seg meas path", """SELECT p.l_orderkey, round(coalesce(length, 0), 4) AS length, xmin, ymin, xmax, ymax, start_x, start_y, end_x, end_y, round(start_angle, 4) AS start_angle, round(end_angle, 4) AS end_angle FROM
 (SELECT l_orderkey, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, arg_min(x, rn) AS start_x, arg_min(y, rn) AS start_y, arg_max(x, rn) AS end_x, arg_max(y, rn) AS end_y
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y) AS rn FROM path) GROUP BY l_orderkey) p
 LEFT JOIN (SELECT l_orderkey, sum(step) AS length, arg_min(degrees(atan2(ny-y, nx-x)), rn) FILTER (step > 0) AS start_angle, arg_max(degrees(atan2(ny-y, nx-x)), rn) FILTER (step > 0) AS end_angle FROM meas GROUP BY l_orderkey) s ON p.l_orderkey = s.l_orderkey"""))
def line_measures(spark, d):
    m = L.line_measures(order_paths(spark, d), ["l_orderkey"], PATH_ORDER)
    return m.select("l_orderkey", r4("length").alias("length"), "xmin", "ymin", "xmax", "ymax", "start_x", "start_y", "end_x", "end_y", r4("start_angle").alias("start_angle"), r4("end_angle").alias("end_angle"))


@query(with_layers("track", """, e AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM track WINDOW w AS (PARTITION BY user_id ORDER BY x)),
 s AS (SELECT user_id, sum(x*ny-nx*y) AS a, sum((x+nx)*(x*ny-nx*y)) AS cx, sum((y+ny)*(x*ny-nx*y)) AS cy FROM e GROUP BY user_id)
 SELECT user_id, round(abs(a/2), 3) AS area, a < 0 AS clockwise, round(cx/(3*a), 2) AS centroid_x, round(cy/(3*a), 2) AS centroid_y FROM s WHERE abs(a/2) > 50""").replace(") , e", "), e"))
def ring_measures(spark, d):
    m = L.polygon_measures(user_tracks(spark, d), ["user_id"], ["x"]).filter("area > 50")
    return m.select("user_id", F.round("area", 3).alias("area"), "clockwise", F.round("centroid_x", 2).alias("centroid_x"), F.round("centroid_y", 2).alias("centroid_y"))


# Every ring; of nearly degenerate ones the orientation and the centroid, which are quotients of noise, are null.
@query(ORACLES["ring_measures"].replace("a < 0 AS clockwise, round(cx/(3*a), 2) AS centroid_x, round(cy/(3*a), 2) AS centroid_y FROM s WHERE abs(a/2) > 50", """CASE WHEN abs(a/2) > 50 THEN a < 0 END AS clockwise,
 CASE WHEN abs(a/2) > 50 THEN round(cx/(3*a), 2) END AS centroid_x, CASE WHEN abs(a/2) > 50 THEN round(cy/(3*a), 2) END AS centroid_y FROM s"""))
def ring_measures_all(spark, d):
    m = L.polygon_measures(user_tracks(spark, d), ["user_id"], ["x"])
    sound = lambda c, to: F.when(F.col("area") > 50, c).alias(to)
    return m.select("user_id", F.round("area", 3).alias("area"), sound(F.col("clockwise"), "clockwise"), sound(F.round("centroid_x", 2), "centroid_x"), sound(F.round("centroid_y", 2), "centroid_y"))


@query(with_layers("seg meas", """SELECT l_orderkey, k, round(x+(nx-x)*(k*20000.0-m0)/step, 3) AS px, round(y+(ny-y)*(k*20000.0-m0)/step, 3) AS py, round(degrees(atan2(ny-y, nx-x)), 4) AS angle
 FROM (SELECT *, unnest(range(CAST(CASE WHEN rn = 1 THEN 0 ELSE floor(m0/20000.0)+1 END AS BIGINT), CAST(floor(m1/20000.0) AS BIGINT)+1)) AS k FROM meas WHERE step > 0)"""))
def sample_line(spark, d):
    s = L.sample_line(order_paths(spark, d), ["l_orderkey"], PATH_ORDER, 20000.0)
    return s.select("l_orderkey", "k", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), r4("angle").alias("angle"))


@query(with_layers("seg meas", """SELECT l_orderkey, part, round(lo, 3) AS from_m, round(hi, 3) AS to_m, round(x+(nx-x)*(lo-m0)/step, 3) AS ax, round(y+(ny-y)*(lo-m0)/step, 3) AS ay, round(x+(nx-x)*(hi-m0)/step, 3) AS bx, round(y+(ny-y)*(hi-m0)/step, 3) AS by
 FROM (SELECT *, greatest(m0, a) AS lo, least(m1, b) AS hi FROM meas, (VALUES (0, 1000.0, 6000.0), (1, 20000.0, 50000.0)) r(part, a, b) WHERE step > 0 AND m0 < b AND m1 > a)"""))
def select_line(spark, d):
    s = L.select_line(order_paths(spark, d), ["l_orderkey"], PATH_ORDER, [(1000.0, 5000.0), (25000.0, 25000.0), (20000.0, 10000.0)])
    return s.select("l_orderkey", "part", *[F.round(c, 3).alias(c) for c in ("from_m", "to_m", "ax", "ay", "bx", "by")])


@query(with_layers("seg meas", """SELECT l_orderkey, round(x+(nx-x)*(30000.0-m0)/step, 3) AS px, round(y+(ny-y)*(30000.0-m0)/step, 3) AS py FROM
 (SELECT *, max(m1) OVER (PARTITION BY l_orderkey) AS e FROM meas WHERE step > 0) WHERE m0 <= 30000 AND (m1 > 30000 OR m1 = e)"""))
def points_at(spark, d):
    p = L.points_at(order_paths(spark, d), ["l_orderkey"], PATH_ORDER, 30000.0)
    return p.select("l_orderkey", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


@query(with_layers("cust", "SELECT c_custkey, x, y FROM cust WHERE x BETWEEN -60 AND 75.5 AND y BETWEEN -20.25 AND 40"))
def clip_points_rect(spark, d):
    return customer_points(spark, d).filter(F.col("x").between(-60, 75.5) & F.col("y").between(-20.25, 40)).select("c_custkey", "x", "y")


@query(with_layers("seg", """, t AS (SELECT *, CASE WHEN nx=x THEN (CASE WHEN x BETWEEN 20000 AND 60000 THEN 0 ELSE 2 END) ELSE least((20000-x)/(nx-x), (60000-x)/(nx-x)) END AS lx, CASE WHEN nx=x THEN 1 ELSE greatest((20000-x)/(nx-x), (60000-x)/(nx-x)) END AS hx,
 CASE WHEN ny=y THEN (CASE WHEN y BETWEEN 10.5 AND 40.5 THEN 0 ELSE 2 END) ELSE least((10.5-y)/(ny-y), (40.5-y)/(ny-y)) END AS ly, CASE WHEN ny=y THEN 1 ELSE greatest((10.5-y)/(ny-y), (40.5-y)/(ny-y)) END AS hy FROM seg),
 u AS (SELECT *, greatest(0, lx, ly) AS t0, least(1, hx, hy) AS t1 FROM t)
 SELECT l_orderkey, rn, round(x+t0*(nx-x)+0.00003, 3) AS ax, round(y+t0*(ny-y)+0.00003, 3) AS ay, round(x+t1*(nx-x)+0.00003, 3) AS bx, round(y+t1*(ny-y)+0.00003, 3) AS by FROM u WHERE t0 <= t1""").replace(") , t", "), t"))
def clip_lines_rect(spark, d):
    from pyspark.sql import Window

    e = L.edges(order_paths(spark, d), ["l_orderkey"], PATH_ORDER).withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PATH_ORDER)).cast("long"))
    c = e.filter("nx is not null").select("l_orderkey", "rn", G.clip_line("x", "y", "nx", "ny", 20000.0, 10.5, 60000.0, 40.5).alias("c")).filter("c is not null")
    return c.select("l_orderkey", "rn", *[F.round(F.col(f"c.{n}") + 0.00003, 3).alias(n) for n in ("ax", "ay", "bx", "by")])


@query(with_layers("dia", """SELECT p_partkey, round(CASE WHEN cx+r <= 60.0 THEN 2*r*r WHEN cx >= 60.0 THEN pow(r-(cx-60.0), 2) ELSE 2*r*r - pow(cx+r-60.0, 2) END, 4) AS area
 FROM dia WHERE cx - r < 60.0 AND cx-r > -60 AND cy-r > -80 AND cy+r < 80""") )
def clip_polygons_rect(spark, d):
    p = part_diamonds(spark, d).filter("cx - r < 60.0 and cx - r > -60 and cy - r > -80 and cy + r < 80")
    return p.select("p_partkey", r4(G.area(G.clip_polygon("diamond", -60.0, -80.0, 60.0, 80.0))).alias("area"))


#: Of a diamond, what lies beyond an edge at distance p from its centre, and beyond two edges at p and q >= 0.
BEYOND = "CASE WHEN {0} >= r THEN 0 WHEN {0} >= 0 THEN pow(r-{0}, 2) WHEN {0} > -r THEN 2*r*r - pow(r+{0}, 2) ELSE 2*r*r END"


# The rectangle is symmetric and larger than any diamond, so each meets one edge of each direction at most.
@query(with_layers("dia", f""", m AS (SELECT p_partkey, r, 60.0-abs(cx) AS p, 80.0-abs(cy) AS q FROM dia WHERE abs(cx)-r < 60.0 AND abs(cy)-r < 80.0),
 b AS (SELECT *, {BEYOND.format("p")} AS bp, {BEYOND.format("q")} AS bq, {BEYOND.format("abs(p)")} AS ap, {BEYOND.format("abs(q)")} AS aq, pow(greatest(0, r-abs(p)-abs(q)), 2)/2 AS c FROM m)
 SELECT p_partkey, round(2*r*r - bp - bq + CASE WHEN p >= 0 AND q >= 0 THEN c WHEN q >= 0 THEN bq - c WHEN p >= 0 THEN bp - c ELSE 2*r*r - ap - aq + c END, 4) + 0.0 AS area FROM b""").replace(") , m", "), m"))
def clip_polygons_rect_all(spark, d):
    p = part_diamonds(spark, d).filter("abs(cx) - r < 60.0 and abs(cy) - r < 80.0")
    return p.select("p_partkey", r4(F.coalesce(G.area(G.clip_polygon("diamond", -60.0, -80.0, 60.0, 80.0)), F.lit(0.0))).alias("area"))


@query(with_layers("dia", "SELECT p_partkey, k, round(cx-r-0.75, 4) AS ax, k*1.5 AS y, round(cx+r+0.75, 4) AS bx FROM (SELECT *, unnest(range(CAST(floor((cy-r)/1.5) AS BIGINT), CAST(ceil((cy+r)/1.5) AS BIGINT)+1)) AS k FROM dia)"))
def stripes(spark, d):
    return L.stripes(part_diamonds(spark, d), ["p_partkey"], "diamond", 1.5).select("p_partkey", "k", r4("ax").alias("ax"), "y", r4("bx").alias("bx"))


@query(with_layers("dia", "SELECT p_partkey, round(cx, 4) AS x, round(cy, 4) AS y FROM dia"))
def label_point(spark, d):
    return L.label_point(part_diamonds(spark, d), ["p_partkey"], "diamond").select("p_partkey", r4("x").alias("x"), r4("y").alias("y"))


@query()
def offset_line(spark, d):
    return L.offset_line(order_paths(spark, d), ["l_orderkey"], PATH_ORDER, 1.5)


# --- projections -------------------------------------------------------------


@query(with_layers("cust", "SELECT c_custkey, round(x*(297.0/360) + 148.5, 4) AS page_x, round(y*(297.0/360) + 105, 4) AS page_y FROM cust"))
def to_page(spark, d):
    w = P.Window.fit((-180, -90, 180, 90), (0, 0, 297, 210))
    x, y = w.to_page("x", "y")
    return customer_points(spark, d).select("c_custkey", r4(x).alias("page_x"), r4(y).alias("page_y"))


@query(with_layers("cust", "SELECT c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM cust"))
def to_page_roundtrip(spark, d):
    w = P.Window.fit((-180, -90, 180, 90), (0, 0, 297, 210))
    page = customer_points(spark, d).withColumns(dict(zip(("px", "py"), w.to_page("x", "y"), strict=True)))
    x, y = w.to_world("px", "py")
    return page.select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _projected(name: str, **par):
    def run(spark, d):
        x, y = P.forward(name, "x", "y", **par)
        return customer_points(spark, d).select("c_custkey", F.round(x, 2).alias("px"), F.round(y, 2).alias("py"))

    return run


def _projection(name: str, px: str, py: str, **par) -> None:
    f = _projected(name, **par)
    f.__name__ = f"reproject_{name}"
    query(with_layers("cust", f"SELECT c_custkey, round({px}, 2) AS px, round({py}, 2) AS py FROM cust"))(f)


_projection("merc", "6378137.0*radians(x)", "6378137.0*ln(tan(pi()/4 + radians(y)/2))")
_projection("sinu", "6378137.0*radians(x)*cos(radians(y))", "6378137.0*radians(y)")
_projection("eqc", "6378137.0*radians(x)*cos(radians(30.0))", "6378137.0*radians(y)", lat_ts=30.0)
_projection("cea", "6378137.0*radians(x)*cos(radians(30.0))", "6378137.0*sin(radians(y))/cos(radians(30.0))", lat_ts=30.0)


# --- summaries ---------------------------------------------------------------


@query(with_layers("cust", "SELECT c_nationkey, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, round((min(x)+max(x))/2, 6) AS center_x, round((min(y)+max(y))/2, 6) AS center_y, round(max(x)-min(x), 6) AS width, round(max(y)-min(y), 6) AS height FROM cust GROUP BY c_nationkey"))
def extents(spark, d):
    e = A.extents(customer_points(spark, d), "x", "y", ["c_nationkey"])
    return e.select("c_nationkey", "xmin", "ymin", "xmax", "ymax", *[F.round(c, 6).alias(c) for c in ("center_x", "center_y", "width", "height")])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def keyed_total(spark, d):
    return A.keyed_total(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("total", F.round("total", 2))


LEGEND_SQL = """WITH e AS (SELECT event_id, 'block' || (user_id % 3) AS block, ['point', 'line', 'zigzag', 'box'][CAST(event_id % 4 AS INT) + 1] AS kind, event_type || ' (#)' AS description FROM events),
 g AS (SELECT block, description, count(*) AS n, arg_min(kind, event_id) AS kind FROM e GROUP BY block, description)
 SELECT block, kind, description, n, replace(description, '(#)', '(' || n || ')') AS label, CAST(row_number() OVER (ORDER BY list_position(['point', 'line', 'zigzag', 'box'], kind), description, block) AS INT) AS place FROM g"""


def _legend(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in A.LEGEND_KINDS]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("block"), (F.col("user_id") % 3).cast("string")).alias("block"), kinds.alias("kind"), F.concat("event_type", F.lit(" (#)")).alias("description"))
    return A.legend(e, "block", "kind", "description", "event_id")


@query(LEGEND_SQL)
def legend(spark, d):
    return _legend(spark, d)


@query(f"SELECT description, block, place, CAST(ceil(place / 4.0) AS INT) AS page FROM ({LEGEND_SQL})")
def legend_pages(spark, d):
    return A.legend_pages(_legend(spark, d), 4).select("description", "block", "place", "page")


@query("""SELECT c_custkey, round(c_acctbal / t * 360, 4) AS share, round(coalesce(b, 0) / t * 360, 4) AS start FROM (SELECT c_custkey, c_acctbal, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS t,
 sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM customer WHERE c_acctbal > 0)""")
def share_of_total(spark, d):
    s = A.share_of_total(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], "c_acctbal")
    return s.select("c_custkey", r4("share").alias("share"), r4("start").alias("start"))


@query("SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) * 100, 4) AS scaled FROM part")
def scale_to_max(spark, d):
    return A.scale_to_max(table(spark, d, "part"), ["p_brand"], "p_retailprice", 100.0).select("p_partkey", r4("scaled").alias("scaled"))


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), s AS (SELECT f*pow(10, p) AS step FROM (VALUES (1),(2),(5)) a(f), range(-3, 10) c(p)),
 st AS (SELECT min(step) AS step FROM s, b WHERE ceil(hi/step - 1e-9) - floor(lo/step + 1e-9) <= 12), x AS (SELECT floor(lo/step + 1e-9)*step AS first, ceil(hi/step - 1e-9) - floor(lo/step + 1e-9) AS cells, step FROM st, b)
 SELECT bin, bin*step + first AS from_tick, (bin+1)*step + first AS to_tick, count(*) AS n FROM (SELECT CAST(least(floor((l_extendedprice-first)/step), cells-1) AS BIGINT) AS bin, step, first FROM lineitem, x) GROUP BY ALL""")
def axis_histogram(spark, d):
    return A.axis_histogram(table(spark, d, "lineitem"), "l_extendedprice", 12)


@query("""SELECT array_to_string(p[1:level+1], ' ') AS path, CAST(level AS INT) AS level, p[level+1] AS label, count(*) AS n FROM (SELECT p, unnest(range(len(p))) AS level FROM (SELECT string_split(p_type, ' ') AS p FROM part)) GROUP BY ALL""")
def tree_levels(spark, d):
    return A.tree_levels(table(spark, d, "part"), "p_type")


@query("""SELECT CAST(n.k AS VARCHAR) AS key, customers, coalesce(suppliers, '') AS suppliers, coalesce(balance, '') AS balance FROM (SELECT c_nationkey AS k, CAST(count(*) AS VARCHAR) AS customers FROM customer GROUP BY 1) n
 LEFT JOIN (SELECT s_nationkey AS k, CAST(count(*) AS VARCHAR) AS suppliers FROM supplier GROUP BY 1) s ON n.k = s.k LEFT JOIN (SELECT c_nationkey AS k, CAST(CAST(sum(floor(c_acctbal)) AS BIGINT) AS VARCHAR) AS balance FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON n.k = b.k""")
def align_columns(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    columns = [
        (c.groupBy(F.col("c_nationkey").cast("string").alias("k")).agg(F.count("*").alias("customers")), "k", "customers"),
        (s.groupBy(F.col("s_nationkey").cast("string").alias("k")).agg(F.count("*").alias("suppliers")), "k", "suppliers"),
        (c.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").cast("string").alias("k")).agg(F.sum(F.floor("c_acctbal")).alias("balance")), "k", "balance"),
    ]
    return A.align_columns(columns, "key")


@query("SELECT c_custkey, coalesce(s, 'none') AS o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def key_lookup(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.key_lookup(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderstatus", "o_orderkey", "none")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE (n-1) % 3 = 0")
def thin(spark, d):
    return A.thin(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS counter, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS accumulated FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def running_counter(spark, d):
    r = A.running(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return r.select("o_orderkey", "counter", F.round("accumulated", 2).alias("accumulated"))


# An edge of the hull has no point on its right, nor one beyond its ends on its line; corners follow the angle of their edges.
@query(with_layers("cust", """, p AS (SELECT DISTINCT c_nationkey AS k, x, y FROM cust),
 e AS (SELECT a.k, a.x, a.y, b.x AS u, b.y AS v FROM p a JOIN p b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.k = a.k AND ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < -1e-9
   OR (abs((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) <= 1e-9 AND ((c.x-a.x)*(b.x-a.x)+(c.y-a.y)*(b.y-a.y) < -1e-9 OR (c.x-b.x)*(b.x-a.x)+(c.y-b.y)*(b.y-a.y) > 1e-9)))))
 SELECT k AS c_nationkey, row_number() OVER (PARTITION BY k ORDER BY (degrees(atan2(v-y, u-x)) + 450.0 - 1e-9) % 360.0) - 1 AS pos, x, y FROM e""").replace(") , p", "), p"))
def hull_agg(spark, d):
    return A.hull_agg(customer_points(spark, d), "c_nationkey", "x", "y")


@query(with_layers("dia", """, xs AS (SELECT p_brand, v, lead(v) OVER (PARTITION BY p_brand ORDER BY v) AS w FROM (SELECT DISTINCT p_brand, unnest([cx-r, cx+r]) AS v FROM dia)),
 ys AS (SELECT p_brand, v, lead(v) OVER (PARTITION BY p_brand ORDER BY v) AS w FROM (SELECT DISTINCT p_brand, unnest([cy-r, cy+r]) AS v FROM dia)),
 c AS (SELECT DISTINCT d.p_brand, xs.v AS x0, xs.w AS x1, ys.v AS y0, ys.w AS y1 FROM dia d JOIN xs ON d.p_brand = xs.p_brand AND xs.v >= cx-r AND xs.w <= cx+r JOIN ys ON d.p_brand = ys.p_brand AND ys.v >= cy-r AND ys.w <= cy+r)
 SELECT p_brand, round(sum((x1-x0)*(y1-y0)), 3) AS area FROM c GROUP BY p_brand""").replace(") , xs", "), xs"))
def dissolved_area(spark, d):
    boxes = part_diamonds(spark, d).select("p_brand", (F.col("cx") - F.col("r")).alias("x0"), (F.col("cy") - F.col("r")).alias("y0"), (F.col("cx") + F.col("r")).alias("x1"), (F.col("cy") + F.col("r")).alias("y1"))
    return A.dissolved_area(boxes, ["p_brand"], ("x0", "y0", "x1", "y1")).select("p_brand", F.round("area", 3).alias("area"))


@query(with_layers("cust supp", "SELECT layer, count(*) AS n, round(min(x), 4) AS xmin, round(max(y), 4) AS ymax FROM (SELECT 'customer' AS layer, x, y FROM cust UNION ALL SELECT 'supplier', sx, sy FROM supp) GROUP BY layer"))
def append_layers(spark, d):
    a = customer_points(spark, d).select(F.lit("customer").alias("layer"), "x", "y")
    b = supplier_points(spark, d).select(F.lit("supplier").alias("layer"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return R.append(a, b).groupBy("layer").agg(F.count("*").alias("n"), r4(F.min("x")).alias("xmin"), r4(F.max("y")).alias("ymax"))


# --- placement ---------------------------------------------------------------


# Row by row: the list holds each row's side so far (2: none), the numbers of the earlier boxes in conflict were joined before.
@query((with_layers("cust", """, b AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS i, x AS l0, x + length(c_name)*0.2 AS r0, x - length(c_name)*0.2 AS l1, y AS y0, y + 1.0 AS y1 FROM cust),
 c AS (SELECT i, k, 0 AS side, l0 AS a, r0 AS e, y0, y1 FROM b UNION ALL SELECT i, k, 1, l1, l1 + (r0 - l0), y0, y1 FROM b),
 p AS (SELECT c.i, c.side, list({'i': o.i, 's': o.side}) AS hits FROM c JOIN c o ON o.i < c.i AND c.a < o.e AND c.e > o.a AND c.y0 < o.y1 AND c.y1 > o.y0 GROUP BY c.i, c.side),
 h AS (SELECT b.i, b.k, coalesce(p0.hits, []) AS h0, coalesce(p1.hits, []) AS h1 FROM b LEFT JOIN p p0 ON p0.i = b.i AND p0.side = 0 LEFT JOIN p p1 ON p1.i = b.i AND p1.side = 1),
 g(i, acc) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL SELECT h.i, list_append(acc, CASE WHEN len(list_filter(h0, lambda t: acc[t.i] = t.s)) = 0 THEN 0 WHEN len(list_filter(h1, lambda t: acc[t.i] = t.s)) = 0 THEN 1 ELSE 2 END) FROM g JOIN h ON h.i = g.i + 1)
 SELECT k AS c_custkey, CAST(z.s AS INT) AS side FROM (SELECT unnest(acc) AS s, unnest(range(1, len(acc)+1)) AS i FROM (SELECT acc FROM g ORDER BY i DESC LIMIT 1)) z JOIN b ON b.i = z.i WHERE s < 2""").replace(") , b", "), b")).replace("WITH ", "WITH RECURSIVE ", 1))
def place_labels(spark, d):
    c = customer_points(spark, d).select("c_custkey", "x", "y", F.length("c_name").cast("double").alias("w"))
    c = c.select("c_custkey", "x", "y", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    left = F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("x") - F.col("w") * 0.2)
    boxes = c.select("c_custkey", "side", left.alias("x0"), F.col("y").alias("y0"), (left + F.col("w") * 0.2).alias("x1"), (F.col("y") + 1.0).alias("y1"))
    return Q.place_labels(boxes, "c_custkey", "side", ("x0", "y0", "x1", "y1"))


@query(with_layers("supp", """, b AS (SELECT s_suppkey AS o, s_acctbal > 0 AS st, CAST(floor(sx/4) AS BIGINT) AS a0, CAST(floor((sx+9.001)/4) AS BIGINT) AS a1, CAST(floor(sy/4) AS BIGINT) AS b0, CAST(floor((sy+6.001)/4) AS BIGINT) AS b1 FROM supp),
 c AS (SELECT o, st, unnest(range(a0, a1+1)) AS cx, b0, b1 FROM b), e AS (SELECT o, st, cx, unnest(range(b0, b1+1)) AS cy FROM c)
 SELECT cx, cy FROM (SELECT cx, cy, arg_max(st, o) AS st FROM e GROUP BY cx, cy) WHERE st""").replace(") , b", "), b"))
def occupancy(spark, d):
    b = supplier_points(spark, d).select("s_suppkey", (F.col("s_acctbal") > 0).alias("state"), F.col("sx").alias("x0"), F.col("sy").alias("y0"), (F.col("sx") + 9.001).alias("x1"), (F.col("sy") + 6.001).alias("y1"))
    return Q.occupancy(b, "s_suppkey", "state", ("x0", "y0", "x1", "y1"), 4.0)


# --- scalar helpers ----------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN right(p_name, 9) ELSE lpad(p_name, 9, '*') END AS padded_left, rpad(p_name, 9, '*') AS padded_right, substring(p_type, 1, 4) AS head, substring(p_type, 3, 5) AS middle,
 CASE WHEN strpos(p_type, 'A') > 0 THEN strpos(p_type, 'A') ELSE 0 END AS first_a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS replaced, array_to_string(string_split(p_type, ' '), '|') AS split, repeat(p_brand, 2) AS repeated, upper(p_name) AS upper_name, lower(p_type) AS lower_type FROM part""")
def text_helpers(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.pad_left("p_name", 9, "*").alias("padded_left"), S.pad_right("p_name", 9, "*").alias("padded_right"), S.substring_from("p_type", -5, 4).alias("head"), S.substring_from("p_type", 3, 5).alias("middle"),
        S.match_index("p_type", "A").cast("long").alias("first_a"), S.replace_all("p_type", "[AEIOU]", "_").alias("replaced"), F.array_join(S.split_text("p_type"), "|").alias("split"), S.repeat_text("p_brand", 2.9).alias("repeated"), F.upper("p_name").alias("upper_name"), F.lower("p_type").alias("lower_type"),
    )


@query("""SELECT p_partkey, CAST(floor(-p_retailprice + 0.5) AS BIGINT) AS rounded, round(((p_size - 25.5) % 7 + 7) % 7, 6) AS remainder, round(cos(radians(p_size)), 6) AS cosine, round(sin(radians(p_size)), 6) AS sine, round(sqrt(p_retailprice), 6) AS root,
 round(log10(p_retailprice), 6) AS lg, round(pow(p_size, 1.5), 4) AS power, greatest(p_size, 20) AS top, least(p_size, 20) AS low, abs(p_size * 0.1 + 0.2 - 0.3) <= greatest(abs(p_size * 0.1 + 0.2), 0.3) * 1e-12 AS same,
 round(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN (p_size - 10) * 1.0 WHEN p_size < 40 THEN 10 + (p_size - 20) * 4.5 ELSE 100 END, 6) AS interpolated FROM part""")
def number_helpers(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", S.round_half_up(-F.col("p_retailprice")).alias("rounded"), F.round(S.modulo(size - F.lit(25.5).cast("double"), F.lit(7.0)), 6).alias("remainder"), F.round(S.cos_degrees("p_size"), 6).alias("cosine"), F.round(S.sin_degrees("p_size"), 6).alias("sine"),
        F.round(S.square_root("p_retailprice"), 6).alias("root"), F.round(S.log_10("p_retailprice"), 6).alias("lg"), r4(S.power("p_size", 1.5)).alias("power"), S.largest("p_size", F.lit(20)).alias("top"), S.smallest("p_size", F.lit(20)).alias("low"),
        S.equal(size * 0.1 + 0.2, F.lit(0.3)).alias("same"), F.round(S.interpolate("p_size", [(10, 0), (20, 10), (40, 100)]), 6).alias("interpolated"),
    )


@query("""SELECT p_partkey, ['','X','XX','XXX','XL','L'][CAST(p_size // 10 AS INT) + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][CAST(p_size % 10 AS INT) + 1] AS numeral FROM part""")
def roman_numerals(spark, d):
    return table(spark, d, "part").select("p_partkey", S.roman("p_size").alias("numeral"))


@query("""SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, strftime(ts, '%S') AS second,
 CAST(isodow(ts) AS INT) AS day_of_week, CAST(week(ts) AS INT) AS week_of_year, CAST(dayofyear(ts) AS INT) AS day_of_year FROM events""")
def time_parts(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in S.time_parts("ts").items()])


@query("""SELECT p_partkey, list_reduce(list_prepend('', string_split(t, ' ')), lambda a, w: CASE WHEN a = '' THEN w WHEN length(regexp_extract(a, '[^|]*$')) + 1 + length(w) <= 14 THEN a || ' ' || w ELSE a || '|' || w END) AS lines FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part)""")
def word_wrap(spark, d):
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(S.word_wrap(text, 14), "|").alias("lines"))


@query("""SELECT page_id, least(a, c) AS xmin, least(b, e) AS ymin, greatest(a, c) AS xmax, greatest(b, e) AS ymax FROM (SELECT page_id, CAST(page_id % 360 - 180 AS DOUBLE) AS a, CAST(page_id % 180 - 90 AS DOUBLE) AS b, CAST(page_id * 7 % 360 - 180 AS DOUBLE) AS c, CAST(page_id * 11 % 180 - 90 AS DOUBLE) AS e FROM pages)""")
def wms_bbox(spark, d):
    from terrane.sources.rasters import wms_bbox as parse

    k = F.col("page_id")
    url = F.concat("url", F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("Request=GetMap&bbox="), F.concat_ws(",", k % 360 - 180, k % 180 - 90, k * 7 % 360 - 180, k * 11 % 180 - 90), F.lit("&format=png"))
    return table(spark, d, "pages").select("page_id", parse(url).alias("b")).select("page_id", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query(with_layers("cells", "SELECT n_nationkey, 'POLYGON ((' || xmin || ' ' || ymin || ', ' || xmax || ' ' || ymin || ', ' || xmax || ' ' || ymax || ', ' || xmin || ' ' || ymax || ', ' || xmin || ' ' || ymin || '))' AS wkt, CAST(2592 AS DOUBLE) AS area FROM cells"))
def wkt_text(spark, d):
    cells = nation_cells(spark, d).select("n_nationkey", G.to_wkt("cell").alias("wkt"))
    return cells.select("n_nationkey", "wkt", G.area(G.from_wkt("wkt")).alias("area"))


@query(with_layers("cust", "SELECT c_custkey, round(x, 4) AS lon, round(y, 4) AS lat FROM cust"))
def parse_geo(spark, d):
    def text(c, plus, minus):
        a = F.abs(F.col(c))
        deg = F.floor(a)
        minute = F.floor((a - deg) * 60)
        second = ((a - deg) * 60 - minute) * 60
        return F.concat(deg.cast("string"), F.lit("d "), minute.cast("string"), F.lit("m "), F.round(second, 4).cast("decimal(10,4)").cast("string"), F.lit("s "), F.when(F.col(c) < 0, F.lit(minus)).otherwise(F.lit(plus)))

    p = customer_points(spark, d).select("c_custkey", text("x", "E", "W").alias("lon"), text("y", "N", "S").alias("lat"))
    return p.select("c_custkey", r4(P.parse_geo("lon")).alias("lon"), r4(P.parse_geo("lat")).alias("lat"))
