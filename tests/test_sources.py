"""Sources and sinks on small generated files."""

import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F
from stages import rows_since, shuffled_rows

from terrane.functions import geometry as G
from terrane.functions import members as M
from terrane.sources import osm, rasters, shapefile_ranges, shapes, text


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n1,2,,x\n3,4\n")
    rows = [list(r) for r in text.read_text_features(spark, str(tmp_path / "a.txt"), ",").collect()]
    assert rows == [["1,2,,x", "1", "2", "", "x"], ["3,4", "3", "4", "", ""]]
    (tmp_path / "b.txt").write_text("33.83S  148.04E Oz\n")
    assert list(text.read_text_features(spark, str(tmp_path / "b.txt")).first())[1:] == ["33.83S", "148.04E", "Oz"]


def test_stanzas(spark, tmp_path):
    (tmp_path / "s.txt").write_text("2 road\n0 0\n3 4\n3 wood\n0 0\n1 0\n0 1\n")
    s = text.read_stanzas(spark, str(tmp_path), F.col("line").rlike("[a-z]"))
    got = {r.header: r.v for r in s.select("header", text.stanza_vertices(F.col("lines")).alias("v")).collect()}
    assert [(v.x, v.y) for v in got["2 road"]] == [(0, 0), (3, 4)] and len(got["3 wood"]) == 3


def test_stanzas_across_splits(spark, tmp_path):
    """Splits of 1 KB: numbers, order and lines as a loop over each file gives them."""
    rng = random.Random(5)
    want, places = {}, {}
    for name in ("a.txt", "b.txt"):
        lines = ["# before the first", ""]
        for n in range(200):
            lines += [f"head {n} {'x' * rng.randint(0, 90)}"] + [f"{name} {n} {k}" for k in range(rng.choice([0, 1, 5, 40]))] + [""] * (n % 3 == 0)
        end = "\r\n" if name == "b.txt" else "\n"
        (tmp_path / name).write_bytes("".join(line + end for line in lines).encode())
        places |= {(name, k): line for k, line in enumerate(lines)}
        for line in filter(None, lines[1:]):
            if line.startswith("head"):
                want[name, len([k for k in want if k[0] == name]) + 1] = (line, [])
            else:
                want[name, len([k for k in want if k[0] == name])][1].append(line)
    (tmp_path / "empty.txt").write_text("")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = text.read_stanzas(spark, str(tmp_path), F.col("line").startswith("head"))
        got = {(r.path.rsplit("/", 1)[1], r.stanza): (r.header, r.lines) for r in read.collect()}
        numbered = {(r.path.rsplit("/", 1)[1], r.pos): r.line for r in text.numbered_lines(spark, str(tmp_path)).collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == want and numbered == places


def test_zip_and_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a", "hello")
    assert text.read_zip(spark, str(tmp_path / "z.zip")).first().text == "hello"
    text.write_lines(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "out"), "n", "s")
    assert text.read_documents(spark, str(tmp_path / "out")).first().text == "1 a\n"


def _shp(path, shapes_):
    body = b""
    for i, (x0, y0, x1, y1) in enumerate(shapes_):
        ring = [(x0, y0), (x0, y1), (x1, y1), (x1, y1), (x1, y0), (x0, y0)]
        rec = struct.pack("<i4d2i1i", 5, x0, y0, x1, y1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *v) for v in ring)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    box = (min(s[0] for s in shapes_), min(s[1] for s in shapes_), max(s[2] for s in shapes_), max(s[3] for s in shapes_))
    path.write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0) + body)


def _dbf(path, names):
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(names) + 1, 32 + 64 + 1, 1 + 8 + 4)
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in ((b"NAME", b"C", 8), (b"SIZE", b"N", 4)))
    rows = [b"*" + b"gone    " + b"   0"] + [b" " + n.encode().ljust(8) + f"{i:4d}".encode() for i, n in enumerate(names)]
    path.write_bytes(head + fields + b"\r" + b"".join(rows))


def test_shapefiles(spark, tmp_path):
    for k, boxes in {"a": [(0, 0, 1, 1), (5, 5, 6, 6)], "far": [(100, 100, 101, 101)]}.items():
        _shp(tmp_path / f"{k}.shp", boxes)
    _dbf(tmp_path / "a.dbf", ["one", "two"])
    rows = shapes.read_shapefiles(spark, str(tmp_path), bbox=(4, 4, 10, 10), columns=["NAME"]).select("record", "attributes", G.area("GEOMETRY").alias("area"), F.size(F.col("GEOMETRY.parts")[0]).alias("n")).collect()
    assert [(r.record, r.attributes, r.area, r.n) for r in rows] == [(1, {"NAME": "two"}, 1.0, 5)]
    assert shapes.read_shapefiles(spark, str(tmp_path)).count() == 3


def _shx(path):
    data = path.read_bytes()
    at, body = 100, b""
    while at < len(data):
        size = struct.unpack_from(">i", data, at + 4)[0]
        body += struct.pack(">2i", at // 2, size)
        at += 8 + 2 * size
    path.with_suffix(".shx").write_bytes(data[:100] + body)


def test_shapefile_ranges_with_deleted_rows(spark, tmp_path):
    """Ranges of a few records of one file, deleted rows anywhere in the .dbf, against whole files."""
    rng = random.Random(3)
    boxes = [(x, y, x + 1, y + 1) for x, y in ((rng.randint(0, 50), rng.randint(0, 50)) for _ in range(300))]
    _shp(tmp_path / "many.shp", boxes)
    _shx(tmp_path / "many.shp")
    live = [f"n{i}".encode() for i in range(290)]  # fewer rows than shapes
    rows = [b" " + n.ljust(8) + f"{i:4d}".encode() for i, n in enumerate(live)]
    for _ in range(120):
        rows.insert(rng.choice([0, 5, rng.randint(0, len(rows)), len(rows)]), b"*gone       0")
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), 32 + 64 + 1, 13)
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in ((b"NAME", b"C", 8), (b"SIZE", b"N", 4)))
    (tmp_path / "many.dbf").write_bytes(head + fields + b"\r" + b"".join(rows))
    _shp(tmp_path / "plain.shp", [(5, 5, 6, 6), (90, 90, 91, 91)])  # neither .shx nor .dbf
    _shp(tmp_path / "far.shp", [(900, 900, 901, 901)])
    key = lambda r: (r.path.rsplit("/", 1)[1], r.record, tuple(sorted(r.attributes.items())), r.t)
    shown = lambda df: sorted(key(r) for r in df.withColumn("t", G.to_wkt("GEOMETRY")).collect())
    for bbox, columns in ((None, None), ((10, 10, 20, 30), ["NAME"]), ((2000, 0, 2001, 1), None)):
        want = shown(shapes.read_shapefiles(spark, str(tmp_path), bbox=bbox, columns=columns))
        read = shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path), bbox=bbox, columns=columns, range_bytes=2000)
        assert shown(read) == want and (bbox or (len(want) == 303 and read.rdd.getNumPartitions() > 10))
    alone = spark.read.format("shapefile").option("rangeBytes", 2000).load(str(tmp_path))
    assert shown(alone) == shown(shapes.read_shapefiles(spark, str(tmp_path)))
    one = shapefile_ranges.read_shapefile_ranges(spark, f"file:{tmp_path}/many.shp")
    assert one.count() == 300 and {r.attributes.get("NAME") for r in one.collect()} == {n.decode() for n in live} | {None}


def test_shapefiles_written(spark, tmp_path):
    """Every kind of shape, holes, null and empty shapes, null and long fields, in small files; again over the same folder."""
    texts = ["POINT (1.0 2.0)", "LINESTRING (0.0 0.0, 3.0 4.0)", "POLYGON ((0.0 0.0, 9.0 0.0, 9.0 9.0, 0.0 9.0, 0.0 0.0), (2.0 2.0, 2.0 4.0, 4.0 4.0, 4.0 2.0, 2.0 2.0))", "MULTIPOINT (1.0 1.0, 2.0 2.0)",
             "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0, 3.0 5.0))", "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))", None]
    rows = [(i, f"näme {i}" if i % 3 else None, i / 7, i % 2 == 0, texts[i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, name string, size double, even boolean, t string").withColumn("g", G.from_wkt("t"))
    out = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        shapefile_ranges.write_shapefiles(df.drop("t"), out, "g", mode, fileBytes=1500)
    back = shapefile_ranges.read_shapefile_ranges(spark, out)
    got = sorted((int(r.attributes["id"]), r.attributes["name"], float(r.attributes["size"]), r.attributes["even"], r.t, r.a) for r in back.withColumn("t", G.to_wkt("GEOMETRY")).withColumn("a", G.area("GEOMETRY")).collect())
    area = {i: r.a for i, r in enumerate(spark.createDataFrame([(t,) for t in texts], "t string").select(G.area(G.from_wkt("t")).alias("a")).collect())}
    turned = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(G.to_wkt(G.from_wkt("t")).alias("t")).collect()]
    assert [r[:4] for r in got] == [(i, n or "", s, "1" if e else "0") for i, n, s, e, _ in rows]
    assert all(r[4] == turned[i % 7] and r[5] == area[i % 7] for i, r in enumerate(got) if i % 7 not in (2, 5)) and all(r[5] == area[i % 7] for i, r in enumerate(got))
    assert len(list((tmp_path / "out").glob("*.shp"))) > 5 and not list((tmp_path / "out").glob("_writing*"))
    with pytest.raises(Exception, match="width"):
        shapefile_ranges.write_shapefiles(df.select("g", F.lit("x" * 300).alias("long")), out, "g")


def test_wkb(spark):
    point = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    line = struct.pack(">BII4d", 0, 2, 2, 0.0, 0.0, 3.0, 4.0)
    df = shapes.from_wkb(spark.createDataFrame([(bytearray(point),), (bytearray(line),), (None,)], "b binary"), "b", "g")
    assert [r.t for r in df.select(G.to_wkt("g").alias("t")).collect()][:2] == ["POINT (3.0 4.0)", "LINESTRING (0.0 0.0, 3.0 4.0)"]
    with pytest.raises(ValueError):
        shapes.decode_wkb(b"\x01\x01")


def test_collections(spark):
    """Members through text, binary and JSON: nested, empty, single, wrong and null ones."""
    texts = {
        "GEOMETRYCOLLECTION (POINT (1.0 2.0), LINESTRING (3.0 4.0, 5.0 6.0))": ["POINT (1.0 2.0)", "LINESTRING (3.0 4.0, 5.0 6.0)"],
        "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(1e1 2),POINT EMPTY),MULTIPOINT((1 1),(2 2)) ) ": ["POINT (10.0 2.0)", "POINT EMPTY", "MULTIPOINT ((1.0 1.0), (2.0 2.0))"],
        "GEOMETRYCOLLECTION (MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5))), POLYGON ((0 0, 9 0, 9 9, 0 0)))":
            ["MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))", "POLYGON ((0.0 0.0, 9.0 0.0, 9.0 9.0, 0.0 0.0))"],
        "GEOMETRYCOLLECTION EMPTY": [], "POINT (7 8)": ["POINT (7.0 8.0)"],
        "GEOMETRYCOLLECTION (POINT (x 2))": None, "GEOMETRYCOLLECTION (CIRCLE (1 2 3))": None, "nothing": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ms", M.members_from_wkt("t"))
    df = shapes.from_wkb_members(shapes.to_wkb(df, "ms", "wkb"), "wkb", "back")
    shown = lambda c: F.transform(c, G.to_wkt)
    rows = df.select("t", shown(F.col("ms")).alias("m"), shown(F.col("back")).alias("b"), M.members_to_wkt("ms").alias("w"), M.area("ms").alias("a"), M.extent("ms").alias("e"), M.members_to_geojson("ms").alias("j")).collect()
    for r in rows:
        assert r.m == texts[r.t] and r.b == texts[r.t], r.t
        assert (r.j is None) == (r.m is None) and (r.m is None or [g["type"].upper() for g in json.loads(r.j)["geometry"]["geometries"]] == [t.split()[0] for t in r.m])
    assert rows[0].w == rows[0].t and tuple(rows[0].e) == (1, 2, 5, 6) and rows[2].a == 41.5 and rows[3].w == rows[3].t and rows[3].e.xmin is None
    flat = M.member_rows(df.select("t", "ms"), "ms", "n", "g")
    assert flat.count() == 8 + 5 and flat.filter("n is null").count() == 5
    assert [tuple(x) for x in flat.filter("g.gtype = 3 and n = 1").withColumn("p", G.make_point(F.col("n") + 7.0, F.col("n"))).select("n", G.contains("g", "p")).collect()] == [(1, True)]


def test_jdbc(spark, tmp_path):
    """An embedded database: written by Spark, read by a query that it runs, in parts too."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i, f"name {i % 3}" if i % 7 else None, i / 4) for i in range(100)]
    spark.createDataFrame(rows, "ID int, NAME string, SIZE double").write.format("jdbc").options(url=url, dbtable="SHAPES", driver=driver).save()
    got = text.read_jdbc(spark, url, "SELECT NAME, COUNT(*) AS N, SUM(SIZE) AS TOTAL FROM (SELECT ID, SIZE, CAST(NAME AS VARCHAR(20)) AS NAME FROM SHAPES) s WHERE ID < 50 GROUP BY NAME", driver=driver)
    want = {}
    for i, name, size in rows[:50]:
        n, total = want.get(name, (0, 0.0))
        want[name] = (n + 1, total + size)
    assert {r.NAME: (r.N, r.TOTAL) for r in got.collect()} == want
    parts = text.read_jdbc(spark, url, "SELECT ID, NAME FROM SHAPES", driver=driver, key="ID", bounds=(0, 100), parts=4)
    assert parts.rdd.getNumPartitions() == 4 and sorted((r.ID, r.NAME) for r in parts.collect()) == [r[:2] for r in rows]
    assert text.read_jdbc(spark, url, "SELECT * FROM SHAPES WHERE ID < 0", driver=driver).count() == 0


def test_osm(spark, tmp_path):
    (tmp_path / "m.osm").write_text(
        '<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="2"><tag k="a" v="b"/></node><node id="3" lat="2" lon="2"/><node id="9" lat="9" lon="9" visible="false"/>'
        '<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="area" v="yes"/></way><way id="8"><nd ref="3"/><nd ref="1"/><nd ref="44"/></way></osm>'
    )
    nodes, ways = osm.read_osm(spark, str(tmp_path / "m.osm"))
    assert nodes.count() == 3 and {r.ID: r.TAGS for r in nodes.collect()}[2] == {"a": "b"}
    got = {r.ID: (r.t, r.UNKNOWN) for r in ways.select("ID", "UNKNOWN", G.to_wkt("GEOMETRY").alias("t")).collect()}
    assert got[7][0].startswith("POLYGON") and got[8] == ("LINESTRING (2.0 2.0, 0.0 0.0)", 1)
    assert osm.unified(nodes, ways).count() == 5


def test_rasters(spark, tmp_path):
    (tmp_path / "img.tfw").write_text("2.0\n0\n0\n-2.0\n101.0\n199.0\n")
    images = spark.createDataFrame([("img", 50, 40)], "name string, columns int, rows int")
    cat = rasters.raster_footprints(images, rasters.read_world_files(spark, str(tmp_path / "*.tfw")))
    r = cat.first()
    assert (r.xmin, r.ymin, r.xmax, r.ymax) == (100.0, 120.0, 200.0, 200.0)
    w = rasters.raster_window(cat, 120.0, 100.0, 140.0, 160.0).first()
    assert (w.px, w.pw, w.py, w.ph) == (10, 10, 20, 20)
    (tmp_path / "clip.txt").write_text("# c\n0 0\n4,0\n4 4\n")
    ring = rasters.read_clip_polygon(spark, str(tmp_path / "clip.txt")).first().ring
    assert len(ring) == 4 and ring[0] == ring[-1]
    b = spark.range(1).select(rasters.wms_bbox(F.lit("http://x/?BBOX=5,6,1,2&a=b")), rasters.wms_bbox(F.lit("http://x/?bbox=1,2,3")), rasters.is_map_request(F.lit("http://x/?ReQuest=GetMap"))).first()
    assert tuple(b[0]) == (1, 2, 5, 6) and b[1] is None and b[2]


def test_stanzas_are_put_together_in_their_splits(spark, tmp_path):
    """Stanzas over many splits and Arrow batches; lines are not shuffled, only what crosses a border."""
    rng = random.Random(6)
    want, places = {}, {}
    for f in range(3):
        lines = ["before"] * rng.choice([0, 2, 900])
        for n in range(60):
            lines += [f"head {n}"] + [f"{f} {n} {k}" for k in range(2000 if n % 20 == 7 else rng.randint(0, 30))]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines))
        places |= {(f"{f}.txt", k): line for k, line in enumerate(lines)}
        for line in lines:
            if line.startswith("head"):
                want[f"{f}.txt", 1 + int(line[5:])] = (line, [])
            elif line != "before":
                want[f"{f}.txt", 1 + int(line.split()[1])][1].append(line)
    settings = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    keep = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        before = shuffled_rows(spark)
        read = text.read_stanzas(spark, str(tmp_path), F.col("line").startswith("head"))
        got = {(r.path.rsplit("/", 1)[1], r.stanza): (r.header, r.lines) for r in read.collect()}
        numbered = {(r.path.rsplit("/", 1)[1], r.pos): r.line for r in text.numbered_lines(spark, str(tmp_path)).collect()}
        shuffled = rows_since(spark, before)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == want and numbered == places and len(places) > 20000
    assert 0 < shuffled < len(places) / 10


def test_shapefile_ranges_read_their_own_rows(spark, tmp_path):
    """Stretches of deleted rows longer than a range: what a range decodes is its own rows, and one count task has many ranges."""
    rng = random.Random(9)
    _shp(tmp_path / "long.shp", [(i, 0, i + 1, 1) for i in range(3000)])
    _shx(tmp_path / "long.shp")
    rows = [b" " + f"n{i}".encode().ljust(8) + f"{i:4d}".encode() for i in range(3000)]
    for n in (1, 2, 700, 5, 900):
        at = rng.randint(0, len(rows))
        rows[at:at] = [b"*gone       0"] * n
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), 32 + 64 + 1, 13)
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in ((b"NAME", b"C", 8), (b"SIZE", b"N", 4)))
    (tmp_path / "long.dbf").write_bytes(head + fields + b"\r" + b"".join(rows))
    read = shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path), range_bytes=4000)
    assert sorted((r.record, r.attributes["NAME"], r.attributes["SIZE"], r.x) for r in read.select("record", "attributes", F.col("GEOMETRY.xmin").alias("x")).collect()) == [(i, f"n{i}", str(i), i) for i in range(3000)]
    options = {"path": str(tmp_path), "rangebytes": "4000"}
    counting = shapefile_ranges.RangeReader(options, True)
    counts = [r for p in counting.partitions() for b in counting.read(p) for r in b.to_pylist()]
    assert len(counting.partitions()) == 1 and len(counts) > 10 and sum(r["deleted"] for r in counts) == 1608
    marks = {str(tmp_path / "long"): [(r["first"], r["rows"], r["deleted"]) for r in counts if r["deleted"]]}
    planned = shapefile_ranges.RangeReader(options | {"marks": json.dumps(marks)}, False)
    decoded = []
    keep = shapefile_ranges.decode_dbf
    try:
        shapefile_ranges.decode_dbf = lambda *a: decoded.append(keep(*a)) or decoded[-1]
        assert sum(b.num_rows for p in planned.partitions() for b in planned.read(p)) == 3000
    finally:
        shapefile_ranges.decode_dbf = keep
    assert sum(map(len, decoded)) == 3000
