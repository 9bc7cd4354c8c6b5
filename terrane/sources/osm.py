"""OpenStreetMap extracts: nodes and ways as features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import geometry as G
from terrane.operators.spatial_join import resolve_references

_TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
_NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("_visible", T.BooleanType()), T.StructField("tag", _TAG)])
_WAY = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_visible", T.BooleanType()), T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))), T.StructField("tag", _TAG)])


def _tags() -> F.Column:
    pairs = F.transform(F.coalesce("tag", F.array().cast(_TAG)), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    return F.map_from_entries(pairs)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways), each with TYPE, ID, GEOMETRY, TAGS; invisible elements are
    dropped.  A way that ends where it starts is a polygon, others are lines;
    references to unknown nodes are left out and counted in UNKNOWN."""
    seen = F.coalesce("_visible", F.lit(True))
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter(seen)
    raw = read("node", _NODE)
    nodes = raw.select(F.lit("node").alias("TYPE"), F.col("_id").alias("ID"), G.make_point("_lon", "_lat").alias("GEOMETRY"), _tags().alias("TAGS"))
    ways = read("way", _WAY)
    refs = ways.select(F.col("_id").alias("ID"), F.transform("nd", lambda n: n["_ref"]).alias("refs"))
    lines = resolve_references(refs, "ID", "refs", raw.select(F.col("_id").alias("node"), "_lon", "_lat"), "node", "_lon", "_lat")
    closed = (F.size("vertices") > 3) & (F.element_at("vertices", 1) == F.element_at("vertices", -1))
    shape = G.geometry(F.when(closed, G.POLYGON).otherwise(G.LINESTRING), F.array("vertices"))
    shaped = lines.filter(F.size("vertices") > 0).select("ID", shape.alias("GEOMETRY"), F.col("unknown").alias("UNKNOWN"))
    return nodes, ways.select(F.lit("way").alias("TYPE"), F.col("_id").alias("ID"), _tags().alias("TAGS")).join(shaped, "ID").select("TYPE", "ID", "GEOMETRY", "TAGS", "UNKNOWN")


def unified(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    return nodes.unionByName(ways.drop("UNKNOWN"))
