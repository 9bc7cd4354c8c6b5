"""Row shapes, and stateless operators on a stream."""

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions.projection import Window
from terrane.operators import rows
from terrane.streaming import points


def test_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id int, x double, y double").withColumn("g", G.make_box("x", "y", F.col("x") + 1, F.col("y") + 1))
    assert [r.id for r in rows.bbox_filter(df, "g", 1.0, 1.0, 2.0, 2.0).collect()] == [1]
    with pytest.raises(ValueError):
        rows.bbox_filter(df, "g", 2.0, 0.0, 1.0, 1.0)
    assert rows.repeat_rows(df, F.col("id") - 1).count() == 1
    m = df.limit(1).select(F.create_map(*[F.lit(v) for k in ("b", "10", "9") for v in (k, k * 2)]).alias("m"))
    assert [(r.place, r.key, r.value) for r in rows.iterate_map(m, "m").orderBy("place").collect()] == [(0, "9", "99"), (1, "10", "1010"), (2, "b", "bb")]
    w = Window.fit((0, 0, 10, 10), (0, 0, 100, 100))
    assert rows.level_of_detail(df.withColumn("s", F.col("id") * 10_000_000.0), "s", w).count() == 1
    assert rows.append(df.select("id"), df.select("id", "x")).filter("x is null").count() == 2
    assert rows.first_rows(df, ["id"], 1).first().id == 1
    assert rows.previous_changes(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k int, o int, v string"), ["k"], ["o"], "v").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0), (3, 3.5, 3.5)], "id int, x double, y double").write.parquet(str(tmp_path / "in"))
    layer = spark.createDataFrame([("a", 0.0), ("b", 3.0)], "name string, o double").select("name", G.make_box("o", "o", F.col("o") + 1, F.col("o") + 1).alias("cell"))
    stream = spark.readStream.schema("id int, x double, y double").parquet(str(tmp_path / "in"))
    located = points.projected(points.locate(stream, "x", "y", layer, "cell"), "x", "y", "merc").select("id", "name", "px")
    q = located.writeStream.format("memory").queryName("located").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.name) for r in spark.table("located").collect()} == {(1, "a"), (3, "b")}
