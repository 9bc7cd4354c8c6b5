"""Scalar helpers against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import projection as P
from terrane.functions import scalars as S

def cases():
    return [
        (S.pad_left(F.lit("abcdef"), 3), "def"),
        (S.pad_left(F.lit("ab"), 4, ""), "  ab"),
        (S.pad_left(F.lit("ab"), 0), ""),
        (S.pad_right(F.lit("abcdef"), 3), "abc"),
        (S.round_half_up(F.lit(-2.5)), -2),
        (S.round_half_up(F.lit(2.5)), 3),
        (S.split_text(F.lit("a,b,,"), ","), ["a", "b"]),
        (S.split_text(F.lit("  a b\tc ")), ["a", "b", "c"]),
        (S.split_text(F.lit("a,b"), ",", keep_delimiters=True), ["a", ",", "b"]),
        (S.match_index(F.lit("hello"), "l+"), 3),
        (S.match_index(F.lit("hello"), "z"), 0),
        (S.character(F.lit(960)), "π"),
        (S.substring_from(F.lit("hello"), 0, 3), "hel"),
        (S.substring_from(F.lit("hello"), -5, 3), "hel"),
        (S.substring_from(F.lit("hello"), 2), "ello"),
        (S.format_pattern(F.lit(42), "00000"), "00042"),
        (S.roman(F.lit(1994)), "MCMXCIV"),
        (S.roman(F.lit(4000)), "MMMM"),
        (S.cos_degrees(F.lit(60)), 0.5),
        (S.modulo(F.lit(-5.5), 2), 0.5),
        (S.interpolate(F.lit(50.0), [(0, 10), (100, 20)]), 15.0),
        (S.interpolate(F.lit(-1.0), [(0, 10), (100, 20)]), 10.0),
        (S.interpolate(F.lit(100.0), [(0, 10), (100, 20)]), 20.0),
        (S.trim_control(F.lit("\ta\n")), "a"),
        (S.repeat_text(F.lit("ab"), 2.9), "abab"),
        (S.to_number(F.lit("abc")) + 1, 1.0),
        (S.to_number(F.lit(" 12 ")), 12.0),
        (S.equal(F.lit(0.1) + F.lit(0.2), F.lit(0.3)), True),
        (S.number_text(F.lit(2.50)), "2.5"),
        (S.number_text(F.lit(3.0)), "3"),
        (S.word_wrap(F.lit("aa bb cc dddddd"), 5), ["aa bb", "cc", "dddd-", "dd"]),
        (S.total(F.array(F.lit(1.0), F.lit(2.0)), F.lit(4.0)), 7.0),
        (S.lookup(F.create_map(F.lit("a"), F.lit("1")), F.lit("b")), ""),
        (S.ordered_keys(F.create_map(*[F.lit(x) for k in ("b", "10", "2", "a") for x in (k, k)])), ["2", "10", "a", "b"]),
        (S.interpolate_colour(F.lit(0.0), [(0, "red"), (1, "blue")]), "0xff0000"),
        (S.interpolate_colour(F.lit(1.0), [(0, "red"), (1, "blue")]), "blue"),
        (S.interpolate_colour(F.lit(-1.0), [(0, "red"), (1, "blue")]), "red"),
        (S.interpolate_colour(F.lit(0.5), [(0, "#ff0000"), (1, "0x00ff00")]), "0xffff00"),
        (S.interpolate_colour(F.lit(0.5), [(0, "cmyk(0,0.5,1,0)"), (1, "cmyk(1,0.5,0,0)")]), "cmyk(0.5,0.5,0.5,0.0)"),
        (S.interpolate_colour(F.lit(0.0), [(0, "cmyk(0,1,1,0)"), (1, "blue")]), "0xff0000"),
        (S.word_wrap(F.lit("ex~am~ple of hy~phen~a~tion"), 8, "~"), ["example", "of hy-", "phena-", "tion"]),
        (S.word_wrap(F.lit("a bb ccc d eee"), 7, justify=True), ["a    bb", "ccc   d", "eee"]),
        (S.word_wrap(F.lit("a bb\n\nccc dd\n"), 4, keep_newlines=True), ["a bb", "", "ccc", "dd"]),
        (S.word_wrap(F.lit(" "), 4), []),
        (P.parse_geo(F.lit("33.83S")), -33.83),
        (P.parse_geo(F.lit("148.04E")), 148.04),
        (P.parse_geo(F.lit("42d 11m 47.75s")), 42 + 11 / 60 + 47.75 / 3600),
        (P.parse_geo(F.lit("W 10d 30m")), -10.5),
        (P.parse_geo(F.lit("0d 30m 0s S")), -0.5),
        (P.parse_geo(F.lit("nowhere")), None),
    ]


def test_values(spark):
    known = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(known)]).first()
    for i, (_, want) in enumerate(known):
        got = row[i]
        assert (got == pytest.approx(want)) if isinstance(want, float) else (got == want), (i, got, want)


def test_errors(spark):
    for bad in (S.square_root(F.lit(-1.0)), S.log_10(F.lit(0.0)), S.roman(F.lit(0)), S.power(F.lit(1e200), 2.0)):
        with pytest.raises(Exception):  # noqa: B017
            spark.range(1).select(bad).collect()
    with pytest.raises(ValueError):
        S.interpolate(F.lit(1), [(2, 1), (1, 1)])


def test_colour_names(spark):
    names = spark.createDataFrame([("Red",), ("Light Goldenrod\tYellow",), ("REBECCAPURPLE",), ("no colour",), ("",), (None,)], "n string")
    got = [tuple(round(255 * v) for v in r.c) if r.c else None for r in names.select(S.colour_name_rgb("n").alias("c")).collect()]
    assert got == [(255, 0, 0), (250, 250, 210), (102, 51, 153), None, None, None]
    assert len(S.COLOURS) == 148 and S.COLOURS["grey"] == S.COLOURS["gray"] and S.colour_components("dark Orange") == (1.0, 140 / 255, 0.0)


def test_colours_come_back(spark):
    rgb = spark.range(1).select(S.adjust_hsb(F.lit(0.2), F.lit(0.4), F.lit(0.9)).alias("c")).first().c
    assert (rgb.r, rgb.g, rgb.b) == (pytest.approx(0.2), pytest.approx(0.4), pytest.approx(0.9))


@pytest.mark.parametrize("name", ["latlong", "merc", "sinu", "eqc", "cea", "moll", "tmerc"])
def test_projections_invert(spark, name):
    df = spark.createDataFrame([(12.5, 41.9), (-70.25, -33.4), (0.0, 0.0)], "lon double, lat double")
    x, y = P.forward(name, "lon", "lat")
    lon, lat = P.inverse(name, "x", "y")
    for r in df.withColumns({"x": x, "y": y}).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-6) and r.b == pytest.approx(r.lat, abs=1e-6)


def test_window_keeps_aspect():
    w = P.Window.fit((0, 0, 100, 10), (0, 0, 200, 200))
    assert w.sx == w.sy == 2.0
    assert P.Window.fit((0, 0, 100, 10), (0, 0, 200, 200), distortion=True).sy == 20.0
    assert math.isclose(w.world_scale(), 500.0)


def wrapped(text: str, width: int, marker: str) -> list[str]:
    """The longest run of each word's pieces that fits, tried longest first."""
    lines, line = [], ""
    for word in text.split():
        left, head = [p for p in word.split(marker) if p], True
        while left:
            glue = " " if line and head else ""
            tried = [(n, line + glue + "".join(left[:n]) + "-" * (n < len(left))) for n in range(len(left), 0, -1)]
            fit = next(((n, t) for n, t in tried if len(t) <= width), None)
            if fit:
                line, left = fit[1], left[fit[0] :]
            elif not line:
                line, left[0] = left[0][: width - 1] + "-", left[0][width - 1 :]
            if left:
                lines.append(line)
                line = ""
            head = head and not fit
    return lines + [line] * bool(line)


def test_word_wrap_against_trial(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("ab~") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 8))) for _ in range(200)]
    for width in (2, 3, 7, 11):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.word_wrap("t", width, "~").alias("lines")).collect()
        for r in rows:
            assert r["lines"] == wrapped(r["t"], width, "~"), (r["t"], width)


def test_projection_text(spark):
    """Known grid coordinates, and false origins, scale and radius by text."""
    import pytest

    # The tower of Paris lies at 448,252 east and 5,411,933 north in zone 31.
    utm = P.reproject("latlong", "+proj=utm +zone=31", F.lit(2.2945), F.lit(48.8582))
    plain = P.reproject("latlong", "merc", F.lit(10.0), F.lit(20.0))
    moved = P.reproject("latlong", "+proj=merc +lon_0=0 +k=2 +x_0=100 +y_0=-50", F.lit(10.0), F.lit(20.0))
    back = P.reproject("+proj=merc +k_0=2 +x_0=100 +y_0=-50", "+proj=longlat", *moved)
    far = P.reproject("latlong", "+proj=utm +zone=31", F.lit(120.0), F.lit(10.0))
    row = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate([*utm, *plain, *moved, *back, *far])]).first())
    assert row[0] == pytest.approx(448_252, abs=20) and row[1] == pytest.approx(5_411_933, abs=20)
    assert row[4:6] == pytest.approx([2 * row[2] + 100, 2 * row[3] - 50]) and row[6:8] == pytest.approx([10, 20]) and row[8:] == [None, None]
    for wrong in ("+proj=merc +foo=1", "+proj=merc +units=ft", "+proj=utm +zone=61"):
        with pytest.raises(ValueError):
            P.reproject("latlong", wrong, F.lit(1.0), F.lit(2.0))


def test_projections_on_ellipsoids(spark):
    """Worked examples of the published manual of map projections (Clarke 1866), and back; domains; wrong definitions."""
    import pytest

    cases = [
        ("+proj=merc +lon_0=-180 +ellps=clrk66", -75.0, 35.0, 11_688_673.7, 4_139_145.6),
        ("+proj=tmerc +lon_0=-75 +k=0.9996 +ellps=clrk66", -73.5, 40.5, 127_106.5, 4_484_124.4),
        ("+proj=cea +lon_0=-75 +lat_ts=5 +ellps=clrk66", -78.0, 5.0, -332_699.8, 554_248.5),
        ("+proj=aea +lon_0=-96 +lat_0=23 +lat_1=29.5 +lat_2=45.5 +datum=NAD27", -75.0, 35.0, 1_885_472.7, 1_535_925.0),
        ("+proj=lcc +lon_0=-96 +lat_0=23 +lat_1=33 +lat_2=45 +a=6378206.4 +b=6356583.8", -75.0, 35.0, 1_894_410.9, 1_564_649.5),
        # The same grid by either way: UTM by its own formula and by a named datum.
        ("+proj=utm +zone=31 +datum=WGS84", 2.2945, 48.8582, None, None),
    ]
    columns = []
    for text, lon, lat, *_ in cases:
        x, y = P.reproject("latlong", text, F.lit(lon), F.lit(lat))
        columns += [x, y, *P.reproject(text, "latlong", x, y)]
    row = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())
    for k, (text, lon, lat, x, y) in enumerate(cases):
        if x is not None:
            assert row[4 * k : 4 * k + 2] == pytest.approx([x, y], abs=0.11), text
        assert row[4 * k + 2 : 4 * k + 4] == pytest.approx([lon, lat], abs=1e-7), text
    plain = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(P.reproject("latlong", "+proj=utm +zone=31", F.lit(2.2945), F.lit(48.8582)))]).first())
    assert row[20:22] == pytest.approx(plain, abs=1e-3)
    outside = [*P.reproject("latlong", "+proj=merc +ellps=GRS80", F.lit(1.0), F.lit(90.0)), *P.reproject("latlong", "+proj=tmerc +ellps=GRS80", F.lit(46.0), F.lit(0.0)), *P.reproject("+proj=cea +ellps=GRS80", "latlong", F.lit(0.0), F.lit(1e8)), *P.reproject("latlong", "+proj=aea +lat_1=20 +lat_2=50 +ellps=GRS80", F.lit(0.0), F.lit(91.0))]
    assert list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(outside)]).first()) == [None] * 8
    sphere = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate([*P.reproject("latlong", "+proj=merc +a=6371000 +b=6371000", F.lit(10.0), F.lit(20.0)), *P.reproject("latlong", "+proj=merc +R=6371000", F.lit(10.0), F.lit(20.0))])]).first())
    assert sphere[:2] == pytest.approx(sphere[2:])
    for wrong in ("+proj=merc +ellps=none", "+proj=merc +datum=none", "+proj=merc +rf=300", "+proj=merc +a=1 +b=3", "+proj=lcc +lat_1=20 +lat_2=-20 +ellps=intl"):
        with pytest.raises(ValueError):
            P.reproject("latlong", wrong, F.lit(1.0), F.lit(2.0))


def test_colours_halfway_between_two(spark):
    prices = [14300.0, 67500.0, 120700.0, 173900.0, 227100.0, 306900.0, 333500.0, 360100.0]
    df = spark.createDataFrame([(p,) for p in prices], "p double").select("p", S.interpolate_colour("p", [(1000, "red"), (400_000, "yellow")]).alias("c"))
    assert [r.c for r in df.orderBy("p").collect()] == [f"0xff{v}00" for v in ("09", "2b", "4d", "6f", "91", "c4", "d5", "e6")]
