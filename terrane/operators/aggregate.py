"""Grouped and ordered summaries: extents, legends, shares, ticks, trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.covered import areas_of_runs
from terrane.workspace import Workspace, partitions


def extents(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Box, centre and size of the points of each group (or of all)."""
    out = df.groupBy(*(keys or [])).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
    return out.withColumns({"center_x": (F.col("xmin") + F.col("xmax")) / 2, "center_y": (F.col("ymin") + F.col("ymax")) / 2, "width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})


def keyed_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and count by key; what is no number counts as 0."""
    return df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("total"), F.count("*").alias("n"))


#: The order in which kinds of legend entries come.
LEGEND_KINDS = ("point", "line", "zigzag", "box")


def legend(df: DataFrame, block: str, kind: str, description: str, order: str) -> DataFrame:
    """One entry for each (block, description) with its count and the kind it
    had first; ``(#)`` in a description becomes the count.  place: its rank by
    kind and description."""
    found = df.groupBy(block, description).agg(F.count("*").alias("n"), F.min_by(kind, order).alias(kind))
    rank = F.array_position(F.array(*[F.lit(k) for k in LEGEND_KINDS]), F.col(kind))
    text = F.replace(F.col(description), F.lit("(#)"), F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")")))
    # The entries of a legend are few; their order is one small window.
    place = F.row_number().over(Window.orderBy(rank, description, block))
    return found.select(block, kind, description, "n", text.alias("label"), place.alias("place"))


def legend_pages(entries: DataFrame, per_page: int) -> DataFrame:
    return entries.withColumn("page", F.ceil(F.col("place") / per_page).cast("int"))


def numbered(df: DataFrame, keys: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """df with each row's number in its group (__number, from 1), the sum of
    ``value`` before it (__before) and the group's total (__total).

    Rows are dealt into ranges of (keys, order), so that a group of any size is
    cut into many; numbers and sums run inside a range, and start at what the
    group's earlier ranges have, of which there are a few rows.  The dealt rows
    are written, since ranges are drawn from a sample.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ranges")
    dealt = df.repartitionByRange(partitions(spark), *keys, *order).withColumn("__range", F.spark_partition_id())
    dealt = ws.keep(dealt, "dealt")
    amount = F.col(value) if value else F.lit(0.0)
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), zero(F.sum("__n").over(earlier)).alias("__n0"), zero(F.sum("__s").over(earlier)).alias("__s0"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    own = {"__n1": F.row_number().over(inside), "__s1": zero(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)))}
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__range") == F.col("__r")]
    both = dealt.withColumns(own).join(starts, same)
    return both.select(*df.columns, (F.col("__n0") + F.col("__n1")).cast("int").alias("__number"), (F.col("__s0") + F.col("__s1")).alias("__before"), "__total")


def share_of_total(df: DataFrame, keys: list[str], order: list[str], value: str, whole: float = 360.0) -> DataFrame:
    """Each positive value's share of its group's total, times ``whole``, and
    where it starts when the shares are laid out in order."""
    rows = numbered(df.filter(F.col(value) > 0), keys, order, value)
    return rows.withColumns({"share": F.col(value) / F.col("__total") * whole, "start": F.col("__before") / F.col("__total") * whole}).drop("__number", "__before", "__total")


def scale_to_max(df: DataFrame, keys: list[str], value: str, size: float) -> DataFrame:
    """Each value's share of its group's greatest, times ``size``.  Maxima are
    combined before the shuffle and joined back, so a large group is split."""
    most = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(value).alias("__most"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(most, on, "left").withColumn("scaled", F.col(value) / F.col("__most") * size).drop("__most", *[f"__{k}" for k in keys])


def nice_axis(low: float, high: float, intervals: int) -> list[float]:
    """Tick values at 1, 2 or 5 times a power of ten: the least spacing that
    covers the range with at most so many intervals.  One interval over a range
    with 0 inside is twice such a spacing wide, with 0 in its middle."""
    if not high > low:
        raise ValueError("the range is empty")
    if not 1 <= intervals <= 10_000:
        raise ValueError("number of intervals out of range")
    power = math.floor(math.log10((high - low) / intervals)) - 1
    while True:
        for factor in (1, 2, 5):
            step = factor * 10.0**power
            # What a step may fail to cover by rounding, never more than a share of the range itself.
            slack = 1e-9 * min(1.0, (high - low) / step)
            first, last = math.floor(low / step + slack), math.ceil(high / step - slack)
            if intervals == 1 and first == -1 and last == 1:
                return [-step, step]
            if last - first <= intervals:
                return [k * step for k in range(first, last + 1)]
        power += 1


def axis_histogram(df: DataFrame, value: str, intervals: int) -> DataFrame:
    """Rows counted between neighbouring ticks of the column's own axis.  No
    values give no rows; equal ones give one bin without width that holds all."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    low, high = known.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        bins = known.groupBy(F.lit(0).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min(F.col(value).cast("double")).alias("at"))
        return bins.select("bin", F.col("at").alias("from_tick"), F.col("at").alias("to_tick"), "n")
    ticks = nice_axis(float(low), float(high), intervals)
    first, step = ticks[0], ticks[1] - ticks[0]
    bin_no = F.least(F.floor((F.col(value) - first) / step), F.lit(len(ticks) - 2)).cast("long")
    return known.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * step + first).alias("from_tick"), ((F.col("bin") + 1) * step + first).alias("to_tick"), "n")


def tree_levels(df: DataFrame, entry: str, delimiter: str = " ") -> DataFrame:
    """Rows of an indented tree: every prefix of the entries once, with level,
    text and the number of entries below.

    Grouping by prefix shows each prefix once, which is what hiding the part
    that an entry shares with the one before gives, and needs no global order.
    """
    import re

    parts = F.split(F.col(entry), re.escape(delimiter))
    levels = df.filter(F.col(entry).isNotNull()).select(parts.alias("p"), F.posexplode(parts).alias("level", "label"))
    path = F.array_join(F.slice("p", 1, F.col("level") + 1), delimiter)
    return levels.select(path.alias("path"), "level", "label").groupBy("path", "level", "label").agg(F.count("*").alias("n"))


def align_columns(columns: list[tuple[DataFrame, str, str]], key: str, default: str = "") -> DataFrame:
    """Tables of (key, value) side by side: rows are the first one's keys,
    missing values the default."""
    out = None
    for df, k, v in columns:
        one = df.select(F.col(k).alias(key), F.col(v).cast("string").alias(v))
        out = one if out is None else out.join(one, key, "left")
    return out.fillna(default)


def thin(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """Every k-th row of each group, the first included."""
    return numbered(df, keys, order).filter((F.col("__number") - 1) % every == 0).select(*df.columns)


def running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Running number and sum of each group; a null value adds nothing."""
    rows = numbered(df, keys, order, value)
    return rows.select(*df.columns, F.col("__number").alias("counter"), (F.col("__before") + F.coalesce(F.col(value), F.lit(0))).alias("accumulated"))


def numeric_first(c: Column) -> list[Column]:
    """Sort keys: numbers in numeric order before other text in its own."""
    return [c.try_cast("double").asc_nulls_last(), c.asc()]


def sorted_rows(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    keys = [F.col(by).try_cast("double"), F.col(by)]
    return df.orderBy(keys[0].desc_nulls_first(), keys[1].desc()) if descending else df.orderBy(keys[0].asc_nulls_last(), keys[1].asc())


def hull_points(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise (monotone chain); points on
    a straight border, to within rounding, are no corners."""
    pts = sorted(set(xy))
    if len(pts) < 3:
        return pts
    # Sine of the turn at o, which does not depend on the unit.
    turn = lambda o, a, b: ((a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])) / (math.dist(o, a) * math.dist(o, b))
    chains = []
    for run in (pts, pts[::-1]):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 1e-12:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def hull_agg(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Corners of each group's convex hull: key, pos, x, y.

    Hulls of parts of a group come first (inside the partitions that the rows
    already lie in), so that the shuffle carries corners, not points, and a
    group of any size ends in one small hull.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, x double, y double"

    def partial(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key):
                hull = hull_points(list(zip(g["x"], g["y"], strict=True)))
                yield type(pdf)({key: [k] * len(hull), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    def final(pdf):
        hull = hull_points(list(zip(pdf["x"], pdf["y"], strict=True)))
        return type(pdf)({key: [pdf[key].iloc[0]] * len(hull), "pos": range(len(hull)), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    points = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(f"{key} is not null and x is not null and y is not null")
    return points.mapInPandas(partial, schema).groupBy(key).applyInPandas(final, f"{key} {dict(df.dtypes)[key]}, pos long, x double, y double")


#: Boxes of a tile that one task takes; a tile with more is cut into four.
TILE_BOXES = 1 << 20


def dissolved_area(rects: DataFrame, keys: list[str], bounds: tuple[str, str, str, str], most: int = TILE_BOXES) -> DataFrame:
    """Area of the union of each group's axis-parallel boxes.

    Boxes are cut along tiles about twice as large as a middling box, so that a
    group of any size is spread over tasks; a tile's pieces come sorted to one
    task, which adds up what they cover (``covered_area``) and holds no pairs.
    Where boxes lie on one another, tiles of over ``most`` pieces are cut into
    four until they have fewer, or until one piece covers them.  Boxes with a
    null bound or no area count nothing; a group without a box has no row.
    """
    spark = rects.sparkSession
    ws = Workspace(spark, "tiles")
    x0, y0, x1, y1 = (F.col(b) for b in bounds)
    boxes = rects.select(*keys, *[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)]).filter("x0 < x1 and y0 < y1")
    boxes = ws.keep(boxes.distinct(), "boxes")
    middle, low, high = boxes.agg(F.percentile_approx(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 0.5, 100), F.least(F.min("x0"), F.min("y0")), F.greatest(F.max("x1"), F.max("y1"))).first()
    # Even a box over everything has at most 512 x 512 tiles.
    size = max(2 * middle, (high - low) / 512) if middle else 1.0
    tile = [*keys, "level", "tx", "ty"]

    def cut(rows: DataFrame, level: int) -> DataFrame:
        side = size / 2**level
        at = lambda c: F.floor(F.col(c) / side).cast("long")
        tiled = rows.withColumn("level", F.lit(level)).withColumn("tx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("ty", F.explode(F.sequence(at("y0"), at("y1"))))
        sides = {"x0": F.greatest("x0", F.col("tx") * side), "x1": F.least("x1", (F.col("tx") + 1) * side), "y0": F.greatest("y0", F.col("ty") * side), "y1": F.least("y1", (F.col("ty") + 1) * side)}
        return tiled.withColumns(sides).filter("x0 < x1 and y0 < y1")

    def crowded(pieces: DataFrame, level: int) -> DataFrame:
        side = size / 2**level
        full = (F.col("x0") <= F.col("tx") * side) & (F.col("x1") >= (F.col("tx") + 1) * side) & (F.col("y0") <= F.col("ty") * side) & (F.col("y1") >= (F.col("ty") + 1) * side)
        found = pieces.groupBy(*tile).agg(F.count("*").alias("n"), F.max(full).alias("full")).filter((F.col("n") > most) & ~F.col("full"))
        return ws.keep(found.select(*[F.col(c).alias(f"__{c}") for c in tile]), f"crowded-{level}")

    pieces, found = cut(boxes, 0), []
    for level in range(30):
        heavy = crowded(pieces, level)
        if heavy.isEmpty():
            break
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in tile]
        found.append(pieces.join(heavy, on, "left_anti"))
        pieces = ws.keep(cut(pieces.join(heavy, on, "left_semi").drop("level", "tx", "ty"), level + 1).distinct(), f"pieces-{level}")
    for other in found:
        pieces = pieces.unionByName(other)
    dealt = pieces.repartition(partitions(spark), *tile).sortWithinPartitions(*tile)
    schema = ", ".join([f"`{k}` {dict(rects.dtypes)[k]}" for k in keys] + ["area double"])
    areas = dealt.mapInArrow(areas_of_runs(tile, keys, ("x0", "y0", "x1", "y1")), schema)
    return areas.groupBy(*keys).agg(F.sum("area").alias("area"))
