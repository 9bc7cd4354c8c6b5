"""Map layers derived from the star-schema tables.

The tables have no coordinates; whole-number arithmetic on the keys gives every
row a place (exact in double), so that both engines see the same layers.  Half
widths end in .0033 and points in .005, which keeps points off borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str, a: int, b: int) -> tuple[Column, Column]:
    return (F.col(key) * a % 36000) / 100.0 - 180 + 0.005, (F.col(key) * b % 18000) / 100.0 - 90 + 0.005


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = place("c_custkey", 7919, 10473)
    return table(spark, d, "customer").withColumns({"x": x, "y": y})


def supplier_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = place("s_suppkey", 7907, 10457)
    return table(spark, d, "supplier").withColumns({"sx": x, "sy": y})


def nation_cells(spark: SparkSession, d: str, dx: float = 0.0, dy: float = 0.0, geom: str = "cell") -> DataFrame:
    x0 = F.lit(-180.0) + 72 * (F.col("n_nationkey") % 5) + dx
    y0 = F.lit(-90.0) + 36 * F.floor(F.col("n_nationkey") / 5) + dy
    return table(spark, d, "nation").withColumn(geom, G.make_box(x0, y0, x0 + 72, y0 + 36))


def part_diamonds(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = place("p_partkey", 7919, 10473)
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", cx.alias("cx"), cy.alias("cy"), (F.col("p_size") / 10.0 + 0.0033).alias("r"))
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    ring = F.array(G.vertex(x + r, y), G.vertex(x, y + r), G.vertex(x - r, y), G.vertex(x, y - r), G.vertex(x + r, y))
    return p.withColumn("diamond", G.make_polygon(ring))


PATH_ORDER = ["l_linenumber", "x", "y"]


def order_paths(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of a line for each order."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


def user_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of a ring for each user: place in its history, and value."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", F.row_number().over(w).cast("double").alias("x"), F.col("value").alias("y"))


#: The same layers in SQL.
SQL = {
    "cust": "SELECT *, (c_custkey*7919 % 36000)/100.0 - 180 + 0.005 AS x, (c_custkey*10473 % 18000)/100.0 - 90 + 0.005 AS y FROM customer",
    "supp": "SELECT *, (s_suppkey*7907 % 36000)/100.0 - 180 + 0.005 AS sx, (s_suppkey*10457 % 18000)/100.0 - 90 + 0.005 AS sy FROM supplier",
    "cells": "SELECT n_nationkey, n_name, CAST(-180 + 72*(n_nationkey % 5) AS DOUBLE) AS xmin, CAST(-90 + 36*(n_nationkey // 5) AS DOUBLE) AS ymin, CAST(-108 + 72*(n_nationkey % 5) AS DOUBLE) AS xmax, CAST(-54 + 36*(n_nationkey // 5) AS DOUBLE) AS ymax FROM nation",
    "dia": "SELECT p_partkey, p_brand, p_size, (p_partkey*7919 % 36000)/100.0 - 180 + 0.005 AS cx, (p_partkey*10473 % 18000)/100.0 - 90 + 0.005 AS cy, p_size/10.0 + 0.0033 AS r FROM part",
    "path": "SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y FROM lineitem",
    "seg": """SELECT * FROM (SELECT l_orderkey, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
        row_number() OVER w AS rn FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y FROM lineitem)
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y)) WHERE nx IS NOT NULL""",
    "meas": """SELECT *, m1 - step AS m0 FROM (SELECT *, sum(step) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS UNBOUNDED PRECEDING) AS m1
        FROM (SELECT *, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS step FROM seg))""",
    "track": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x, value AS y FROM events",
}


def with_layers(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body
