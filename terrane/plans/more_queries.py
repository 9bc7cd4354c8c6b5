"""Registered queries of sources, row shapes, constructors and projections.

Source queries write files from the given tables into the shared folder and read
them back, so that reader and writer are held against the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import members as M
from terrane.functions import projection as P
from terrane.functions import scalars as S
from terrane.operators import aggregate as A
from terrane.operators import linear as L
from terrane.operators import overlay as O
from terrane.operators import rows as R
from terrane.operators import spatial_join as J
from terrane.plans.layers import PATH_ORDER, customer_points, nation_cells, order_paths, part_diamonds, supplier_points, table, with_layers
from terrane.plans.queries import ORACLES, QUERIES, query, r4
from terrane.sources import osm, rasters, shapefile_ranges, shapes, text
from terrane.workspace import Workspace, spread

__all__ = ["ORACLES", "QUERIES"]


def folder(spark, name: str) -> str:
    return f"{Workspace(spark, 'files').root}/{name}"


# --- sources and sinks ---------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def delimited_text(spark, d):
    path = folder(spark, "delimited")
    rows = table(spark, d, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.lit(""), "c_mktsegment").alias("value"))
    rows.unionByName(spark.range(1).select(F.lit("# a comment").alias("value"))).write.text(path)
    read = text.read_text_features(spark, path, "|")
    return read.select(F.col("`$1`").cast("long").alias("c_custkey"), F.col("`$2`").alias("c_name"), F.col("`$4`").alias("c_mktsegment"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS sx, round(sum(l_quantity), 2) AS sy FROM lineitem GROUP BY l_orderkey")
def stanzas(spark, d):
    path = folder(spark, "stanzas")
    line = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    body = order_paths(spark, d).groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    body.select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit("\n"), "body").alias("value")).write.text(path)
    read = text.read_stanzas(spark, path, F.col("line").startswith("order"))
    v = read.select(F.substring("header", 7, 20).cast("long").alias("l_orderkey"), text.stanza_vertices(F.col("lines")).alias("v"))
    total = lambda k: F.round(F.aggregate("v", F.lit(0.0), lambda a, p: a + p[k]), 2)
    return v.select("l_orderkey", F.size("v").cast("long").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query(with_layers("cust", """SELECT c_nationkey AS id, CASE WHEN count(*) > 0 THEN 'way' END AS type, count(*) AS n, round(arg_min(x, c_custkey), 6) AS first_x, round(arg_max(y, c_custkey), 6) AS last_y,
 CAST(1 AS BIGINT) AS unknown, min(n_name) AS name FROM cust JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey"""))
def osm_ways(spark, d):
    path = folder(spark, "osm")
    c = customer_points(spark, d)
    node = F.format_string('<node id="%d" lat="%s" lon="%s"><tag k="k" v="%d"/></node>', "c_custkey", F.col("y").cast("string"), F.col("x").cast("string"), "c_nationkey")
    # A reference to a node that there is not, at the end.
    refs = F.array_join(F.transform(F.array_append(F.array_sort(F.collect_list("c_custkey")), F.lit(-1)), lambda k: F.format_string('<nd ref="%d"/>', k)), "")
    ways = c.groupBy("c_nationkey").agg(refs.alias("refs"), F.array_join(F.collect_list(node), "").alias("nodes")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    way = F.format_string('<osm>%s<way id="%d">%s<tag k="name" v="%s"/></way></osm>', "nodes", "c_nationkey", "refs", "n_name")
    # One document a file: the format has one root.
    ways.select(way.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    _, found = osm.read_osm(spark, path)
    line = F.get(F.col("GEOMETRY.parts"), 0)
    return found.select(
        F.col("ID").alias("id"), F.col("TYPE").alias("type"), F.size(line).cast("long").alias("n"), F.round(F.get(line, 0)["x"], 6).alias("first_x"), F.round(F.element_at(line, -1)["y"], 6).alias("last_y"),
        F.col("UNKNOWN").cast("long").alias("unknown"), F.col("TAGS")["name"].alias("name"),
    )


def _diamond_shapefiles(spark, d: str) -> str:
    path = folder(spark, "shapefiles")
    shapefile_ranges.write_shapefiles(spread(part_diamonds(spark, d).select("p_partkey", "p_brand", "p_size", "diamond")), path, "diamond")
    return path


@query(with_layers("dia", "SELECT p_partkey, p_brand, p_size, CAST(5 AS INT) AS corners, round(2*r*r, 4) AS area, round(cx - r, 4) AS xmin, round(cy + r, 4) AS ymax FROM dia"))
def shapefile_ranges_roundtrip(spark, d):
    """Files written by tasks, each read as ranges of 64 KB."""
    read = shapefile_ranges.read_shapefile_ranges(spark, _diamond_shapefiles(spark, d), range_bytes=64 << 10)
    of = lambda name, kind: F.col("attributes")[name].cast(kind).alias(name)
    g = F.col("GEOMETRY")
    corners = F.size(F.get(g["parts"], 0)).alias("corners")
    return read.select(of("p_partkey", "long"), of("p_brand", "string"), of("p_size", "int"), corners, r4(G.area(g)).alias("area"), r4(g["xmin"]).alias("xmin"), r4(g["ymax"]).alias("ymax"))


@query(with_layers("dia", "SELECT p_partkey, p_brand FROM dia WHERE cx-r <= 33.3 AND cx+r >= -41.7 AND cy-r <= 20.1 AND cy+r >= -15.9"))
def shapefile_box(spark, d):
    """Shapes in a box with one of their fields, by files read whole."""
    read = shapes.read_shapefiles(spark, _diamond_shapefiles(spark, d), bbox=(-41.7, -15.9, 33.3, 20.1), columns=["p_partkey", "p_brand"])
    return read.select(F.col("attributes")["p_partkey"].cast("long").alias("p_partkey"), F.col("attributes")["p_brand"].alias("p_brand"))


@query(with_layers("dia", """SELECT p_partkey, CAST(n AS INT) AS n, round(CASE WHEN n = 4 THEN 2*r*r ELSE 0 END, 4) AS area, round(CASE WHEN n > 1 THEN cx - r WHEN n > 0 THEN cx END, 4) AS xmin, round(CASE WHEN n > 1 THEN cy + r WHEN n > 0 THEN cy END, 4) AS ymax,
 CASE n WHEN 0 THEN '' WHEN 1 THEN 'Point' WHEN 2 THEN 'Point,LineString' WHEN 3 THEN 'Point,LineString,MultiPoint' ELSE 'Point,LineString,MultiPoint,Polygon' END AS kinds FROM (SELECT *, p_partkey % 5 AS n FROM dia)"""))
def collections_roundtrip(spark, d):
    """Collections of none to four members through text, binary and text again; kinds are read from their JSON."""
    p = spread(part_diamonds(spark, d).select("p_partkey", "cx", "cy", "diamond"))
    ring = F.get(F.col("diamond.parts"), 0)
    members = F.array(G.make_point("cx", "cy"), G.make_line(ring), G.geometry(G.MULTIPOINT, F.transform(ring, lambda v: F.array(v))), F.col("diamond"))
    made = p.select("p_partkey", M.members_to_wkt(F.slice(members, F.lit(1), (F.col("p_partkey") % 5).cast("int"))).alias("t"))
    binary = shapes.to_wkb(made.select("p_partkey", M.members_from_wkt("t").alias("ms")), "ms", "wkb")
    back = shapes.from_wkb_members(binary.select("p_partkey", "wkb"), "wkb", "h").select("p_partkey", M.members_from_wkt(M.members_to_wkt("h")).alias("h"))
    box = M.extent("h")
    kinds = F.transform(F.from_json(F.get_json_object(M.members_to_geojson("h"), "$.geometry.geometries"), "array<struct<type:string>>"), lambda g: g["type"])
    return back.select("p_partkey", F.size("h").alias("n"), r4(M.area("h")).alias("area"), r4(box["xmin"]).alias("xmin"), r4(box["ymax"]).alias("ymax"), F.array_join(kinds, ",").alias("kinds"))


@query(with_layers("dia", "SELECT p_partkey, CAST(3 + p_partkey % 4 AS INT) AS gtype, round(CASE p_partkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 4*r*r ELSE 2*r*r END, 4) AS area, round(cx - r, 4) AS xmin FROM dia"))
def wkb_roundtrip(spark, d):
    p = part_diamonds(spark, d)
    ring, away = F.get(F.col("diamond.parts"), 0), F.get(G.shift("diamond", 1000.0, 0.0)["parts"], 0)
    k = F.col("p_partkey") % 4
    points = F.transform(ring, lambda v: F.array(v))
    parts = F.when(k == 0, F.array(ring)).when(k == 1, points).when(k == 2, F.array(F.slice(ring, 1, 3), F.slice(ring, 3, 3))).otherwise(F.array(ring, away))
    made = p.select("p_partkey", G.geometry((k + 3).cast("int"), parts).alias("g"))
    back = shapes.from_wkb(shapes.to_wkb(made, "g", "wkb").select("p_partkey", "wkb"), "wkb", "h")
    area = F.when(F.col("h.gtype").isin(G.POLYGON, G.MULTIPOLYGON), G.area("h")).otherwise(0.0)
    return back.select("p_partkey", "h", area.alias("area")).select("p_partkey", F.col("h.gtype").alias("gtype"), r4("area").alias("area"), r4(F.col("h.xmin")).alias("xmin"))


MULTI_WKT = """'MULTIPOLYGON (' || string_agg('((' || xmin || ' ' || ymin || ', ' || xmax || ' ' || ymin || ', ' || xmax || ' ' || ymax || ', ' || xmin || ' ' || ymax || ', ' || xmin || ' ' || ymin || '), (' ||
 xmin+1 || ' ' || ymin+1 || ', ' || xmin+1 || ' ' || ymin+2 || ', ' || xmin+2 || ' ' || ymin+2 || ', ' || xmin+2 || ' ' || ymin+1 || ', ' || xmin+1 || ' ' || ymin+1 || '))', ', ' ORDER BY n_nationkey) || ')'"""


@query(with_layers("cells", f"SELECT n_nationkey % 5 AS g, {MULTI_WKT} AS wkt, 2591.0 * count(*) AS area FROM cells GROUP BY n_nationkey % 5"))
def wkt_multipolygons(spark, d):
    cells = nation_cells(spark, d).select("n_nationkey", F.col("cell.xmin").alias("x"), F.col("cell.ymin").alias("y"), F.col("cell.xmax").alias("u"), F.col("cell.ymax").alias("v"))
    pair = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    # Rings run the wrong way round here; reading turns them.
    corners = lambda x, y, u, v: F.concat(F.lit("("), F.concat_ws(", ", pair(x, y), pair(x, v), pair(u, v), pair(u, y), pair(x, y)), F.lit(")"))
    x, y, u, v = (F.col(c) for c in "xyuv")
    hole = F.concat(F.lit("("), F.concat_ws(", ", pair(x + 1, y + 1), pair(x + 2, y + 1), pair(x + 2, y + 2), pair(x + 1, y + 2), pair(x + 1, y + 1)), F.lit(")"))
    polygon = F.concat(F.lit("("), corners(x, y, u, v), F.lit(", "), hole, F.lit(")"))
    many = cells.groupBy((F.col("n_nationkey") % 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", polygon.alias("t")))).alias("ps"))
    shape = many.select("g", G.from_wkt(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("ps", lambda p: p["t"]), ", "), F.lit(")"))).alias("shape"))
    # Outer rings come back counter-clockwise and from the corner that they began with.
    return shape.select("g", G.to_wkt("shape").alias("wkt"), G.area("shape").alias("area"))


@query(with_layers("cells", "SELECT n_nationkey, n_name, 'Polygon' AS kind, CAST(5 AS INT) AS corners, xmin AS x0, ymax AS y2 FROM cells"))
def geojson_features(spark, d):
    path = folder(spark, "geojson")
    text.write_geojson(nation_cells(spark, d), path, "cell", ["n_name"], "n_nationkey")
    schema = "type string, id string, properties struct<n_name:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    read = spark.read.schema(schema).json(path)
    ring = F.get(F.col("geometry.coordinates"), 0)
    return read.select(F.col("id").cast("int").alias("n_nationkey"), "properties.n_name", F.col("geometry.type").alias("kind"), F.size(ring).alias("corners"), F.get(F.get(ring, 0), 0).alias("x0"), F.get(F.get(ring, 2), 1).alias("y2"))


@query("SELECT count(*) AS n, CAST(sum(length(CAST(s_suppkey AS VARCHAR) || ' ' || s_name)) AS BIGINT) AS chars, min(CAST(s_suppkey AS VARCHAR) || ' ' || s_name) AS first FROM supplier")
def lines_and_documents(spark, d):
    """Lines written, and read back as whole compressed files."""
    lines, packed = folder(spark, "lines"), folder(spark, "packed")
    text.write_lines(table(spark, d, "supplier"), lines, "s_suppkey", "s_name")
    spark.read.text(lines).write.option("compression", "gzip").text(packed)
    found = text.read_documents(spark, packed).select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return found.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.min("line").alias("first"))


@query(with_layers("dia", """SELECT p_partkey, round(x0, 4) AS xmin, round(y1, 4) AS ymax, px, py, CAST(greatest(qx - px, 1) AS INT) AS pw, CAST(greatest(qy - py, 1) AS INT) AS ph FROM
 (SELECT *, CAST(least(round(greatest(0, least(1, (-50.0-x0)/(x1-x0)))*200), 199) AS INT) AS px, CAST(round(greatest(0, least(1, (60.0-x0)/(x1-x0)))*200) AS INT) AS qx,
 CAST(least(round((1 - greatest(0, least(1, (40.0-y0)/(y1-y0))))*100), 99) AS INT) AS py, CAST(round((1 - greatest(0, least(1, (-30.0-y0)/(y1-y0))))*100) AS INT) AS qy
 FROM (SELECT p_partkey, cx - 0.5*s AS x0, cx + 199.5*s AS x1, cy + 0.5*s AS y1, cy - 99.5*s AS y0 FROM (SELECT *, r/10.0 AS s FROM dia)) WHERE x0 <= 60 AND x1 >= -50 AND y0 <= 40 AND y1 >= -30)"""))
def raster_windows(spark, d):
    p, s = part_diamonds(spark, d), F.col("r") / 10.0
    world = p.select(F.col("p_partkey").alias("name"), s.alias("v0"), (-s).alias("v3"), F.col("cx").alias("v4"), F.col("cy").alias("v5"))
    images = p.select(F.col("p_partkey").alias("name"), F.lit(200).alias("columns"), F.lit(100).alias("rows"))
    w = rasters.raster_window(rasters.raster_footprints(images, world), -50.0, -30.0, 60.0, 40.0)
    return w.select(F.col("name").alias("p_partkey"), r4("xmin").alias("xmin"), r4("ymax").alias("ymax"), "px", "py", "pw", "ph")


@query(with_layers("cells", "SELECT n_nationkey, 2592.0 AS area, CAST(5 AS INT) AS corners FROM cells"))
def clip_files(spark, d):
    path = folder(spark, "clips")
    corners = nation_cells(spark, d).select("n_nationkey", F.posexplode(F.slice(F.get(F.col("cell.parts"), 0), 1, 4)).alias("pos", "v"))
    lines = corners.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(",", F.col("v.x").cast("string"), F.col("v.y").cast("string")).alias("t")))).alias("l"))
    body = lines.select("n_nationkey", F.concat(F.lit("# corners\n"), F.array_join(F.transform("l", lambda s: s["t"]), "\n")).alias("value"))
    body.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    rings = rasters.read_clip_polygon(spark, f"{path}/*/*.txt")
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    return rings.select(key.alias("n_nationkey"), G.area(G.make_polygon(F.col("ring"))).alias("area"), F.size("ring").alias("corners"))


# --- row shapes and expressions ------------------------------------------------


@query(with_layers("dia", "SELECT p_partkey FROM dia WHERE cx-r <= 33.3 AND cx+r >= -41.7 AND cy-r <= 20.1 AND cy+r >= -15.9"))
def bbox_filter(spark, d):
    return R.bbox_filter(part_diamonds(spark, d), "diamond", -41.7, -15.9, 33.3, 20.1).select("p_partkey")


@query("SELECT p_partkey, CAST(n AS INT) AS n FROM (SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS n FROM part)")
def repeat_rows(spark, d):
    return R.repeat_rows(table(spark, d, "part"), F.col("p_size") % 4).select("p_partkey", "n")


@query("""SELECT p_partkey, CAST(place AS INT) AS place, key, value FROM (SELECT p_partkey, unnest([0, 1, 2]) AS place, unnest(['2', '10', 'size']) AS key, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part)""")
def iterate_map(spark, d):
    pairs = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("10"), "p_type", F.lit("2"), "p_brand")
    return R.iterate_map(table(spark, d, "part").select("p_partkey", pairs.alias("m")), "m").select("p_partkey", "place", "key", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_rows(spark, d):
    o = table(spark, d, "orders").withColumn("down", -F.col("o_totalprice"))
    return R.first_rows(o, ["down", "o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, round(110000000.0 / (297.0/360), 2) AS scale FROM part WHERE p_size * 4000000.0 <= 110000000.0 / (297.0/360)")
def level_of_detail(spark, d):
    w = P.Window.fit((-180, -90, 180, 90), (0, 0, 297, 210))
    p = table(spark, d, "part").withColumn("least", F.col("p_size") * 4000000.0)
    return R.level_of_detail(p, "least", w).select("p_partkey", F.round(F.lit(w.world_scale("degrees")), 2).alias("scale"))


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def previous_changes(spark, d):
    return R.previous_changes(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("""SELECT p_partkey, round(p_retailprice + p_size * 2 - 1, 4) AS added, round(p_retailprice / p_size, 6) AS divided, p_brand || '-' || CAST(p_size AS VARCHAR) AS joined, coalesce(CASE WHEN p_size % 3 = 0 THEN p_type END, 'none') AS found,
 round(p_size + p_retailprice + 3, 4) AS total, (p_brand < 'Brand#3' AND NOT p_size > 20) OR p_type >= 'S' AS tested, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middling' ELSE 'large' END AS class, CAST(length(p_name) AS INT) AS n FROM part""")
def expressions(spark, d):
    """Guarded arithmetic, text, maps, logic and conditions over rows."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    found = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("a"), F.col("p_type"))).otherwise(F.create_map(F.lit("b"), F.col("p_type")))
    return table(spark, d, "part").select(
        "p_partkey", F.round(S.finite(price + size * 2 - 1), 4).alias("added"), F.round(S.finite(price / size), 6).alias("divided"), S.join_text("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("joined"),
        S.lookup(found, F.lit("a"), "none").alias("found"), F.round(S.total(F.array(size, price), F.lit(3)), 4).alias("total"), ((F.col("p_brand") < "Brand#3") & ~S.less(F.lit(20), F.col("p_size")) | (F.col("p_type") >= "S")).alias("tested"),
        F.when(S.less("p_size", F.lit(10)), "small").when(S.less("p_size", F.lit(30)), "middling").otherwise("large").alias("class"), F.length("p_name").alias("n"),
    )


@query("SELECT p_partkey, k FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS k FROM part) ORDER BY TRY_CAST(k AS DOUBLE) ASC NULLS LAST, k, p_partkey LIMIT 60")
def sorted_table(spark, d):
    k = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", k.alias("k"))
    # The order of the table, with the key as a last one for ties.
    return rows.orderBy(*A.numeric_first(F.col("k")), "p_partkey").limit(60)


@query(with_layers("supp", """SELECT l_orderkey, count(s_suppkey) AS n, round(sum(sx), 4) AS sx, count(*) - count(s_suppkey) AS unknown, round(arg_min(sy, l_linenumber * 1000000 + l_suppkey), 4) AS first_y
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) l LEFT JOIN (SELECT * FROM supp WHERE s_suppkey % 10 <> 3) s ON s_suppkey = l_suppkey GROUP BY l_orderkey HAVING count(s_suppkey) > 0"""))
def resolve_references(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey").alias("k")).distinct()
    lists = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["l_suppkey"]).alias("refs"))
    found = J.resolve_references(lists, "l_orderkey", "refs", supplier_points(spark, d).filter("s_suppkey % 10 <> 3"), "s_suppkey", "sx", "sy").filter(F.size("vertices") > 0)
    return found.select("l_orderkey", F.size("vertices").cast("long").alias("n"), r4(F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v["x"])).alias("sx"), F.col("unknown").cast("long").alias("unknown"), r4(F.get("vertices", 0)["y"]).alias("first_y"))


# --- joins ------------------------------------------------------------------------

IN_SMALL = "p_size < 7 AND abs(x-cx) + abs(y-cy) < r"


def _small(spark, d) -> tuple[DataFrame, DataFrame]:
    return customer_points(spark, d).withColumns({"x": F.col("x") + 0.3, "y": F.col("y") - 0.2}), part_diamonds(spark, d).filter("p_size < 7")


@query(with_layers("cust dia", "SELECT c_custkey FROM (SELECT c_custkey, x+0.3 AS x, y-0.2 AS y FROM cust) c WHERE EXISTS (SELECT 1 FROM dia WHERE " + IN_SMALL + ")"))
def pip_semi_small(spark, d):
    points, polygons = _small(spark, d)
    return J.pip_join(points, "x", "y", polygons, "diamond", how="semi", point_id="c_custkey").select("c_custkey")


@query(with_layers("cust dia", "SELECT c_custkey FROM (SELECT c_custkey, x+0.3 AS x, y-0.2 AS y FROM cust) c WHERE NOT EXISTS (SELECT 1 FROM dia WHERE " + IN_SMALL + ")"))
def pip_anti_small(spark, d):
    points, polygons = _small(spark, d)
    return J.pip_join(points, "x", "y", polygons, "diamond", how="anti", point_id="c_custkey").select("c_custkey")


@query(with_layers("cust cells", "SELECT c_custkey, n_nationkey FROM cust, cells WHERE n_nationkey % 4 = 1 AND sqrt(pow(greatest(xmin-x, 0, x-xmax), 2) + pow(greatest(ymin-y, 0, y-ymax), 2)) <= 2.0033"))
def within_buffer(spark, d):
    """Points in the buffers of polygons, the insides included."""
    return J.near_geometry(customer_points(spark, d), "x", "y", nation_cells(spark, d).filter("n_nationkey % 4 = 1"), "cell", 2.0033).select("c_custkey", "n_nationkey")


@query(with_layers("dia", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM dia a JOIN dia b ON abs((b.cx+b.cy-(a.cy-a.cx))/2 - a.cx) < 1 - 1e-7 AND abs((b.cx+b.cy-(a.cy-a.cx))/2 - b.cx) < 1 - 1e-7"""))
def crossing_lines(spark, d):
    """Diagonals through the parts' places, which cross others' antidiagonals, some at a vertex of both."""
    p = part_diamonds(spark, d)
    step = lambda dx, dy: G.vertex(F.col("cx") + dx, F.col("cy") + dy)
    up = p.select(F.col("p_partkey").alias("a"), G.make_line(F.array(step(-1, -1), step(0, 0), step(1, 1))).alias("ga"))
    down = p.select(F.col("p_partkey").alias("b"), G.make_line(F.array(step(-1, 1), step(0, 0), step(1, -1))).alias("gb"))
    return J.predicate_join(up, "ga", down, "gb", "crosses").select("a", "b")


# --- shapes -----------------------------------------------------------------------


@query(with_layers("dia", """SELECT p_partkey, round(cx+2.5-r, 4) AS xmin, round(cy-1.5+r, 4) AS ymax, round(cx+r, 4) AS first_x, round(cy-r, 4) AS second_y, round(4*sqrt(2)*r, 4) AS length FROM dia"""))
def shift_and_reverse(spark, d):
    moved, turned = G.shift("diamond", 2.5, -1.5), G.reverse("diamond")
    p = part_diamonds(spark, d).select("p_partkey", moved.alias("m"), turned.alias("t"))
    ring = F.get(F.col("t.parts"), 0)
    return p.select("p_partkey", r4(F.col("m.xmin")).alias("xmin"), r4(F.col("m.ymax")).alias("ymax"), r4(F.get(ring, 0)["x"]).alias("first_x"), r4(F.get(ring, 1)["y"]).alias("second_y"), r4(G.length("t")).alias("length"))


@query(with_layers("dia", """SELECT p_partkey, round(6/2.0*r*r*sin(2*pi()/6), 4) AS hexagon, round(64/2.0*r*r*sin(2*pi()/64), 4) AS circle, round(2*r*r, 4) AS box, round(2*sqrt(2)*r, 4) AS line,
 ['POINT', 'LINESTRING', 'POLYGON', 'MULTIPOINT', 'MULTILINESTRING', 'MULTIPOLYGON', 'GEOMETRYCOLLECTION'][CAST(p_partkey % 7 AS INT) + 1] AS path FROM dia"""))
def constructors(spark, d):
    p, r = part_diamonds(spark, d), F.col("r")
    ring = F.get(F.col("diamond.parts"), 0)
    point, open_ = F.slice(ring, 1, 1), F.slice(ring, 1, 3)
    kinds = [F.array(point), F.array(open_), F.array(ring), F.array(point, point), F.array(open_, open_), F.array(ring, ring), F.array(ring, open_)]
    parts = F.element_at(F.array(*kinds), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.element_at(F.create_map(*[F.lit(v) for kv in G.NAMES.items() for v in kv]), G.path_type(parts))
    return p.select(
        "p_partkey", r4(G.area(G.make_regular_polygon("cx", "cy", "r", 6, 15.0))).alias("hexagon"), r4(G.area(G.make_circle("cx", "cy", "r"))).alias("circle"),
        r4(G.area(G.make_box(F.col("cx") + r, F.col("cy"), F.col("cx") - r, F.col("cy") + r))).alias("box"), r4(G.length(G.make_line(open_))).alias("line"), name.alias("path"),
    )


@query(with_layers("seg meas", """, o AS (SELECT l_orderkey, max(m1) AS e, arg_max(nx, rn) < arg_min(x, rn) AS back FROM meas GROUP BY l_orderkey),
 t AS (SELECT m.l_orderkey, e, step, CASE WHEN back THEN nx ELSE x END AS x, CASE WHEN back THEN ny ELSE y END AS y, CASE WHEN back THEN x ELSE nx END AS nx, CASE WHEN back THEN y ELSE ny END AS ny,
 CASE WHEN back THEN e - m1 ELSE m0 END AS m0, CASE WHEN back THEN e - m0 ELSE m1 END AS m1 FROM meas m JOIN o ON m.l_orderkey = o.l_orderkey WHERE step > 0)
 SELECT l_orderkey, CAST(n AS INT) AS n, round(x+(nx-x)*(n*9001.5-m0)/step, 2) AS px, round(y+(ny-y)*(n*9001.5-m0)/step, 2) AS py FROM t, range(5) r(n) WHERE n*9001.5 >= m0 AND (n*9001.5 < m1 OR m1 = e)""").replace(") , o", "), o"))
def place_along(spark, d):
    paths = order_paths(spark, d)
    items = paths.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"), F.lit(9001.0).alias("w"))
    placed = L.place_along(paths, ["l_orderkey"], PATH_ORDER, items, "n", "w", spacing=0.5)
    return placed.select("l_orderkey", "n", F.round("px", 2).alias("px"), F.round("py", 2).alias("py"))


# --- overlay and projections ------------------------------------------------------


@query(with_layers("cells", """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2592.0 - w*h, 4) AS only_a, round(w*h, 4) AS shared, round(greatest(a.xmin, b.xmin+10.3), 4) AS xmin, CAST(1 AS INT) AS rings FROM cells a, cells b,
 LATERAL (SELECT least(a.xmax, b.xmax+10.3)-greatest(a.xmin, b.xmin+10.3) AS w, least(a.ymax, b.ymax+7.1)-greatest(a.ymin, b.ymin+7.1) AS h) WHERE w > 0 AND h > 0"""))
def overlay_geometries(spark, d):
    """Clockwise cells over counter-clockwise ones, as geometries."""
    a = nation_cells(spark, d).select(F.col("n_nationkey").alias("a"), G.reverse("cell").alias("ga"))
    b = nation_cells(spark, d, 10.3, 7.1).select(F.col("n_nationkey").alias("b"), F.col("cell").alias("gb"))
    pairs = J.bbox_join(a, "ga", b, "gb", 64.0)
    both = O.overlay(O.overlay(pairs, "ga", "gb", "intersection", "i"), "ga", "gb", "difference", "o").filter(F.size("i.parts") > 0)
    return both.select("a", "b", r4(G.area("o")).alias("only_a"), r4(G.area("i")).alias("shared"), r4(F.col("i.xmin")).alias("xmin"), F.size("i.parts").alias("rings"))


@query(with_layers("cells", """SELECT n_nationkey, round(greatest(0, least(xmax, 60.5)-greatest(xmin, -20.25)) * greatest(0, least(ymax, 30.5)-greatest(ymin, -70.0)), 4) AS inside FROM cells"""))
def mask_clip(spark, d):
    """Cells cut to two masks, of which they may keep what both share."""
    corners = [(-100.0, -70.0, 60.5, 80.0), (-20.25, -90.0, 170.0, 30.5)]
    boxes = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("a", "b", "c", "e"), box, strict=True)]) for box in corners])
    # One row of a given table gives the masks.
    masks = table(spark, d, "region").filter("r_regionkey = 0").select(F.explode(boxes).alias("m")).select(G.make_box(F.col("m.a"), F.col("m.b"), F.col("m.c"), F.col("m.e")).alias("mask"))
    cut = O.clip_to_mask(nation_cells(spark, d).select("n_nationkey", "cell"), "cell", masks, "mask")
    return cut.select("n_nationkey", r4(F.coalesce(G.area("cell"), F.lit(0.0))).alias("inside"))


CONIC = {"lat_1": 20.0, "lat_2": 50.0, "lat_0": 30.0}


@query(with_layers("cust", """, k AS (SELECT ln(cos(radians(20.0))/cos(radians(50.0)))/ln(tan(pi()/4+radians(50.0)/2)/tan(pi()/4+radians(20.0)/2)) AS n),
 f AS (SELECT n, cos(radians(20.0))*pow(tan(pi()/4+radians(20.0)/2), n)/n AS f FROM k)
 SELECT c_custkey, round(6378137.0*f/pow(tan(pi()/4+radians(y)/2), n)*sin(n*radians(x)), 1) AS px, round(6378137.0*f/pow(tan(pi()/4+radians(30.0)/2), n) - 6378137.0*f/pow(tan(pi()/4+radians(y)/2), n)*cos(n*radians(x)), 1) AS py FROM cust, f WHERE abs(y) < 80""").replace(") , k", "), k"))
def reproject_lcc(spark, d):
    x, y = P.forward("lcc", "x", "y", **CONIC)
    return customer_points(spark, d).filter("abs(y) < 80").select("c_custkey", F.round(x, 1).alias("px"), F.round(y, 1).alias("py"))


@query(with_layers("cust", """, k AS (SELECT (sin(radians(20.0))+sin(radians(50.0)))/2 AS n), f AS (SELECT n, pow(cos(radians(20.0)), 2)+2*n*sin(radians(20.0)) AS c FROM k)
 SELECT c_custkey, round(6378137.0*sqrt(c-2*n*sin(radians(y)))/n*sin(n*radians(x)), 2) AS px, round(6378137.0*sqrt(c-2*n*sin(radians(30.0)))/n - 6378137.0*sqrt(c-2*n*sin(radians(y)))/n*cos(n*radians(x)), 2) AS py FROM cust, f""").replace(") , k", "), k"))
def reproject_aea(spark, d):
    x, y = P.forward("aea", "x", "y", **CONIC)
    return customer_points(spark, d).select("c_custkey", F.round(x, 2).alias("px"), F.round(y, 2).alias("py"))


@query(with_layers("cust", """SELECT c_custkey, round(6378137.0*ln((1+cos(radians(y))*sin(radians(x-9.0)))/(1-cos(radians(y))*sin(radians(x-9.0))))/2, 1) AS px, round(6378137.0*atan2(tan(radians(y)), cos(radians(x-9.0))), 1) AS py FROM cust WHERE abs(x-9.0) < 80"""))
def reproject_tmerc(spark, d):
    x, y = P.forward("tmerc", "x", "y", lon0=9.0)
    return customer_points(spark, d).filter("abs(x - 9.0) < 80").select("c_custkey", F.round(x, 1).alias("px"), F.round(y, 1).alias("py"))


@query(with_layers("cust", "SELECT c_custkey, unnest(['merc', 'sinu', 'eqc', 'cea', 'moll', 'lcc', 'aea', 'tmerc']) AS name, round(x, 5) AS x, round(y, 5) AS y FROM cust WHERE abs(y) < 85 AND abs(x) < 85"))
def reproject_roundtrip(spark, d):
    """Forward and back through every projection."""
    points = customer_points(spark, d).filter("abs(y) < 85 and abs(x) < 85")
    out = None
    for name in ("merc", "sinu", "eqc", "cea", "moll", "lcc", "aea", "tmerc"):
        par = CONIC if name in ("lcc", "aea") else {"lat_ts": 25.0} if name in ("eqc", "cea") else {}
        there = points.withColumns(dict(zip(("px", "py"), P.forward(name, "x", "y", **par), strict=True)))
        x, y = P.inverse(name, "px", "py", **par)
        one = there.select("c_custkey", F.lit(name).alias("name"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


#: Krueger's series in SQL: t is the tangent of the conformal latitude.
UTM_SQL = """, c AS (SELECT c_custkey, x, y, CAST(0.0016792203863837047 AS DOUBLE) AS n, radians(x - 9.0) AS lam, sin(radians(y)) AS s FROM cust WHERE abs(x - 9.0) < 40 AND abs(y) < 84),
t AS (SELECT *, sinh(atanh(s) - 2*sqrt(n)/(1+n) * atanh(2*sqrt(n)/(1+n) * s)) AS t FROM c),
g AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta, n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3,
  0.9996*6378137.0/(1+n)*(1+n*n/4+n*n*n*n/64) AS k FROM t)
SELECT c_custkey, round(500000 + k*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)), 1) AS px,
  round(10000000 + k*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), 1) AS py, round(x, 5) AS x, round(y, 5) AS y FROM g"""


@query(with_layers("cust", UTM_SQL))
def reproject_utm(spark, d):
    """Into UTM zone 32 south and back, by projection text, for longitudes within 40 degrees of its meridian (farther off the series does not hold)."""
    utm = "+proj=utm +zone=32 +south +datum=WGS84 +units=m +no_defs"
    points = customer_points(spark, d).filter((F.abs(F.col("x") - 9.0) < 40) & (F.abs("y") < 84))
    px, py = P.reproject("latlong", utm, "x", "y")
    there = points.select("c_custkey", px.alias("px"), py.alias("py"))
    x, y = P.reproject(utm, "+proj=longlat", "px", "py")
    return there.select("c_custkey", F.round("px", 1).alias("px"), F.round("py", 1).alias("py"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


#: Closed forms on the ellipsoid of 1924 in SQL: u is the isometric latitude, q the authalic function, m a parallel's radius.
ELLIPSOID_SQL = """, ell AS (SELECT sqrt((1/297.0)*(2-1/297.0)) AS e, (1/297.0)/(2-1/297.0) AS n, 6378388.0 AS a),
aux AS (SELECT i, cos(radians(i))/sqrt(1-pow(e*sin(radians(i)), 2)) AS m, ln(tan(pi()/4+radians(i)/2)) - e*atanh(e*sin(radians(i))) AS u,
  (1-e*e)*(sin(radians(i))/(1-pow(e*sin(radians(i)), 2)) + atanh(e*sin(radians(i)))/e) AS q FROM (VALUES (20.0), (50.0), (30.0), (25.0)) t(i), ell),
par AS (SELECT max(CASE WHEN i = 20 THEN m END) AS m1, max(CASE WHEN i = 50 THEN m END) AS m2, max(CASE WHEN i = 25 THEN m END) AS mt, max(CASE WHEN i = 20 THEN u END) AS u1, max(CASE WHEN i = 50 THEN u END) AS u2,
  max(CASE WHEN i = 30 THEN u END) AS u0, max(CASE WHEN i = 20 THEN q END) AS q1, max(CASE WHEN i = 50 THEN q END) AS q2, max(CASE WHEN i = 30 THEN q END) AS q0 FROM aux),
cone AS (SELECT *, (ln(m1)-ln(m2))/(u2-u1) AS nl, (m1*m1-m2*m2)/(q2-q1) AS na FROM par),
c AS (SELECT c_custkey, x, y, radians(x-9.0) AS lam, ln(tan(pi()/4+radians(y)/2)) - e*atanh(e*sin(radians(y))) AS u,
  (1-e*e)*(sin(radians(y))/(1-pow(e*sin(radians(y)), 2)) + atanh(e*sin(radians(y)))/e) AS q, e, n, a FROM cust, ell),
r AS (SELECT c.*, cone.*, a*m1*exp(nl*(u1-u))/nl AS rl, a*m1*exp(nl*(u1-u0))/nl AS rl0, a/na*sqrt(greatest(m1*m1+na*(q1-q), 0)) AS ra, a/na*sqrt(m1*m1+na*(q1-q0)) AS ra0,
  atan2(sinh(u), cos(lam)) AS xi, CASE WHEN abs(x-9.0) <= 45 THEN atanh(sin(lam)/cosh(u)) END AS eta, n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3,
  0.9996*a/(1+n)*(1+n*n/4+n*n*n*n/64) AS k FROM c, cone),
f AS (SELECT c_custkey, 'merc' AS name, a*mt*lam AS px, a*mt*u AS py, x, y FROM r
 UNION ALL SELECT c_custkey, 'cea', a*mt*lam, a*q/(2*mt), x, y FROM r
 UNION ALL SELECT c_custkey, 'lcc', rl*sin(nl*lam), rl0 - rl*cos(nl*lam), x, y FROM r
 UNION ALL SELECT c_custkey, 'aea', ra*sin(na*lam), ra0 - ra*cos(na*lam), x, y FROM r
 UNION ALL SELECT c_custkey, 'tmerc', 500000 + k*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)),
   k*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), x, y FROM r)
SELECT c_custkey, name, round(px, 1) AS px, round(py, 1) AS py, CASE WHEN px IS NOT NULL THEN round(x, 4) END AS x, CASE WHEN px IS NOT NULL THEN round(y, 4) END AS y FROM f"""


@query(with_layers("cust", ELLIPSOID_SQL))
def reproject_ellipsoid(spark, d):
    """Every customer through each projection of the ellipsoid and back; null beyond the reach of the transverse one."""
    ways = {"merc": "+lat_ts=25", "cea": "+lat_ts=25", "lcc": "+lat_1=20 +lat_2=50 +lat_0=30", "aea": "+lat_1=20 +lat_2=50 +lat_0=30", "tmerc": "+k=0.9996 +x_0=500000"}
    points = customer_points(spark, d).select("c_custkey", F.explode(F.array(*[F.lit(n) for n in ways])).alias("name"), "x", "y")
    texts = {name: f"+proj={name} +lon_0=9 +ellps=intl {more}" for name, more in ways.items()}
    chosen = lambda pairs, i: F.coalesce(*[F.when(F.col("name") == name, pair[i]) for name, pair in pairs.items()])
    there = {name: P.reproject("latlong", text, "x", "y") for name, text in texts.items()}
    placed = points.select("c_custkey", "name", chosen(there, 0).alias("px"), chosen(there, 1).alias("py"))
    back = {name: P.reproject(text, "latlong", "px", "py") for name, text in texts.items()}
    return placed.select("c_custkey", "name", F.round("px", 1).alias("px"), F.round("py", 1).alias("py"), F.round(chosen(back, 0), 4).alias("x"), F.round(chosen(back, 1), 4).alias("y"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS padded, printf('%.2f', round(c_custkey / 8.0, 2)) AS eighths, chr(CAST(c_nationkey + 945 AS INTEGER)) AS letter, c_name AS trimmed, true AS below FROM customer")
def formatted_values(spark, d):
    """Number patterns, characters by code, trimmed control characters, random numbers below a bound."""
    control = F.concat(F.lit("\t\x01 "), "c_name", F.lit("\r\n "))
    any_number = S.random_below(10.0, 7)
    return table(spark, d, "customer").select(
        "c_custkey", S.format_pattern("c_custkey", "0000000").alias("padded"), S.format_pattern(F.round(F.col("c_custkey") / 8, 2), "0.00").alias("eighths"),
        S.character(F.col("c_nationkey") + 945).alias("letter"), S.trim_control(control).alias("trimmed"), any_number.between(0.0, 10.0).alias("below"),
    )


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 86399 SECOND, '%a, %b %-d %H:%M:%S') AS due FROM orders")
def order_timestamps(spark, d):
    """The last second of each order's day as text, without the session's zone."""
    text_of = S.timestamp_text(F.col("o_orderdate").cast("timestamp"), 86_399)
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(text_of, r" [^ ]+$", "").alias("due"))


@query("""SELECT p_partkey, round(v2 - CASE WHEN v > low THEN v2*s2*(v-r)/(v-low) ELSE 0 END, 6) AS r, round(v2 - CASE WHEN v > low THEN v2*s2*(v-g)/(v-low) ELSE 0 END, 6) AS g, round(v2 - CASE WHEN v > low THEN v2*s2*(v-b)/(v-low) ELSE 0 END, 6) AS b
 FROM (SELECT *, least(1.0, v*1.25) AS v2, CASE WHEN v > 0 THEN least(1.0, 0.5*(v-low)/v) ELSE 0 END AS s2
  FROM (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS low FROM (SELECT p_partkey, CAST(p_size AS DOUBLE)/50 AS r, CAST(p_partkey%7 AS DOUBLE)/7 AS g, CAST(p_partkey%11 AS DOUBLE)/11 AS b FROM part)))""")
def adjusted_colours(spark, d):
    """Half the saturation and five quarters of the brightness of each part's colour; the hue stays."""
    ratio = lambda c, n: F.col(c).cast("double") / n
    parts = table(spark, d, "part").select("p_partkey", ratio("p_size", 50).alias("r"), (F.col("p_partkey") % 7 / 7.0).alias("g"), (F.col("p_partkey") % 11 / 11.0).alias("b"))
    found = parts.select("p_partkey", S.adjust_hsb("r", "g", "b", saturation=0.5, brightness=1.25).alias("a"))
    return found.select("p_partkey", *[F.round(F.col("a")[k], 6).alias(k) for k in "rgb"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'red' WHEN o_totalprice >= 400000 THEN 'yellow' ELSE '0xff' || lpad(lower(to_hex(CAST(floor(255*((o_totalprice-1000)/399000.0) + 0.5) AS BIGINT))), 2, '0') || '00' END AS colour FROM orders")
def price_colour(spark, d):
    """A colour for each order's price, from red to yellow."""
    colour = S.interpolate_colour(F.col("o_totalprice").cast("double"), [(1000, "red"), (400_000, "yellow")])
    return table(spark, d, "orders").select("o_orderkey", colour.alias("colour"))
