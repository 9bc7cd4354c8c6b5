"""Connected components of an edge table, by alternating star contraction.

Each round rewrites every node's edges to point at the smallest node it knows
(first over larger neighbours, then over smaller ones); the edge count never
grows and the table becomes a set of stars in a number of rounds logarithmic
in the longest path.  Rounds are written tables, so lineage stays short, and
nothing but two checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.workspace import Workspace


def _star(ws: Workspace, name: str, edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v) with u > v, hooked to the smallest neighbour of u.  The
    neighbours are written, so that the edges of a hub can be split in the join."""
    if both:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.keep(around.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), f"{name}-around")
        moved = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = ws.keep(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        joined = edges.join(least, "u")
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(ws: Workspace, pairs: DataFrame, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``pairs``; component is its smallest node."""
    start = pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = ws.keep(start, f"{label}-0")
    checksum = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen, n = checksum(edges), 0
    while seen[0]:
        n += 1
        name = f"{label}-{n}"
        around = ws.keep(_star(ws, name, edges, True), f"{name}-half")
        edges = ws.keep(_star(ws, name, around, False), name)
        now = checksum(edges)
        ws.drop(f"{label}-{n - 1}", f"{name}-around", f"{name}-half", f"{name}-least")
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
