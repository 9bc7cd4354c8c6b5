"""Filters and row shapes over feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.projection import Window as PageWindow
from terrane.functions.scalars import ordered_keys


def bbox_filter(df: DataFrame, geom: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose closed box meets a window.  The stored box is compared,
    so Parquet's statistics prune row groups."""
    if xmin > xmax or ymin > ymax:
        raise ValueError("the window's lower corner is above its upper corner")
    g = F.col(geom)
    return df.filter((g["xmin"] <= xmax) & (g["xmax"] >= xmin) & (g["ymin"] <= ymax) & (g["ymax"] >= ymin))


def repeat_rows(df: DataFrame, times: Column, counter: str = "n") -> DataFrame:
    """Each row so many times, numbered from 1; none for less than one."""
    n = F.greatest(F.floor(times + 1e-9), F.lit(0)).cast("int")
    return df.withColumn(counter, F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))


def iterate_map(df: DataFrame, mapping: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row for each entry of a map, with its place: whole numbers in numeric
    order, then other keys in their own."""
    keys = df.select("*", F.posexplode(ordered_keys(mapping)).alias("place", key))
    return keys.withColumn(value, F.try_element_at(F.col(mapping), F.col(key)))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def level_of_detail(df: DataFrame, min_scale: str, window: PageWindow, unit: str = "degrees") -> DataFrame:
    """Features shown at the window's scale: those whose least scale it reaches."""
    return df.filter(F.col(min_scale) <= window.world_scale(unit))


def append(*layers: DataFrame) -> DataFrame:
    """All layers' rows; columns that a layer lacks are NULL."""
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def previous_changes(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Rows where a column differs from the row before in its group."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.col(column))).drop("__before")
