"""Streams of points against static layers.

The operators without state work on streaming DataFrames as they are: filters,
derived columns, projections, and joins with a static layer.  Nothing here keeps
state, so no watermark is needed and late rows are handled like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrane.functions import projection as P
from terrane.operators.spatial_join import pip_join


def locate(points: DataFrame, x: str, y: str, layer: DataFrame, geom: str, base: float | None = None) -> DataFrame:
    """Stream of points with the polygons that contain them; the layer's cells
    are computed once, when the query is defined."""
    return pip_join(points, x, y, layer, geom, base=base)


def projected(points: DataFrame, x: str, y: str, projection: str, **parameters: float) -> DataFrame:
    """Stream of points with projected coordinates px, py."""
    px, py = P.forward(projection, x, y, **parameters)
    return points.withColumns({"px": px, "py": py})
