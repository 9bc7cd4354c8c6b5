"""Raster catalogues, map requests and clip files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wms_bbox(url: Column) -> Column:
    """Box of a map request's BBOX parameter (any case); corners in either
    order.  NULL unless it is four numbers."""
    text = F.regexp_extract(url, r"(?i)[?&]bbox=([^&#]*)", 1)
    parts = F.transform(F.split(text, ","), lambda s: s.try_cast("double"))
    a, b, c, d = (F.get(parts, i) for i in range(4))
    box = F.struct(F.least(a, c).alias("xmin"), F.least(b, d).alias("ymin"), F.greatest(a, c).alias("xmax"), F.greatest(b, d).alias("ymax"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull()), box)


def is_map_request(url: Column) -> Column:
    return url.rlike(r"(?i)[?&]request=getmap(&|$|#)")


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name (without suffix) and the six numbers of world files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\s+"), lambda s: s != "").alias("v"))
    numbers = [F.get(F.col("v"), i).try_cast("double").alias(f"v{i}") for i in range(6)]
    return files.select("path", F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1).alias("name"), *numbers)


def raster_footprints(images: DataFrame, world: DataFrame) -> DataFrame:
    """images(name, columns, rows) with the box that their world file gives:
    the origin is the centre of the upper left pixel; rotation is ignored."""
    w, h = F.col("v0"), -F.col("v3")
    left, top = F.col("v4") - w / 2, F.col("v5") + h / 2
    box = {"xmin": left, "ymax": top, "xmax": left + w * F.col("columns"), "ymin": top - h * F.col("rows")}
    return images.join(world, "name").withColumns(box)


def raster_window(catalog: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Images that meet a window, with the pixel rectangle to read."""
    hit = catalog.filter((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    part = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col(lo)) / (F.col(hi) - F.col(lo))))
    x0, x1 = (F.round(part(F.lit(v), "xmin", "xmax") * F.col("columns")).cast("int") for v in (xmin, xmax))
    y0, y1 = (F.round((1 - part(F.lit(v), "ymin", "ymax")) * F.col("rows")).cast("int") for v in (ymax, ymin))
    at_least = lambda a, b, n: (F.least(a, F.col(n) - 1), F.greatest(b - a, F.lit(1)))
    (px, pw), (py, ph) = at_least(x0, x1, "columns"), at_least(y0, y1, "rows")
    return hit.withColumns({"px": px, "py": py, "pw": pw, "ph": ph})


def read_clip_polygon(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring) of files with one ``x y`` or ``x,y`` a line and # comments;
    the ring is closed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    lines = F.filter("lines", lambda s: (F.trim(s) != "") & ~F.ltrim(s).startswith("#"))
    vertex = lambda s: F.struct(F.get(F.split(F.trim(s), r"[\s,]+"), 0).try_cast("double").alias("x"), F.get(F.split(F.trim(s), r"[\s,]+"), 1).try_cast("double").alias("y"))
    ring = files.select("path", F.transform(lines, vertex).alias("r"))
    return ring.select("path", F.when(F.element_at("r", 1) == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1))).alias("ring"))
