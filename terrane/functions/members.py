"""Mixed collections: an array of geometries, their members.

A GEOMETRYCOLLECTION has no parts of its own, so it is an array column whose
entries are geometries of the other six types; collections in it are flattened,
which loses no shape.  Measures are sums over the array; predicates and overlays
take members as rows (``member_rows``), and a relation of the whole is the
aggregate that its definition asks for.

Defined results: null stays null; an empty collection is an empty array; any
other text or geometry is a collection of one; a member that does not parse
makes the whole null; empty members stay and count as members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry as G

_LEAF = r"(?:POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)"
#: A member's text: EMPTY, or brackets and numbers up to the last bracket before the next name.
MEMBER = _LEAF + r"\s*(?:EMPTY|\([^A-DF-Za-df-z]*\))"


def members_from_wkt(text) -> Column:
    """Members of a well-known text of any type."""
    text = F.trim(G._col(text))
    found = F.regexp_extract_all(text, F.lit(MEMBER), 0)

    def own(leaf: Column) -> Column:
        # The last member of a collection is followed by the collection's brackets, which it has not opened.
        opened = F.length(leaf) - F.length(F.replace(leaf, F.lit("("), F.lit("")))
        return F.when(opened == 0, leaf).otherwise(F.concat(F.call_function("substring_index", leaf, F.lit(")"), opened.cast("int")), F.lit(")")))

    members = F.transform(F.transform(found, own), G.from_wkt)
    # What is left beside the members: names, brackets and commas of collections.
    rest = F.regexp_replace(text, MEMBER, "")
    sound = text.rlike(r"^(GEOMETRYCOLLECTION|" + _LEAF + r")\b") & ~F.regexp_replace(rest, r"GEOMETRYCOLLECTION|EMPTY|[\s(),]", "").rlike(".")
    # Bound once: the members would be read again for the test.
    whole = lambda ms: F.when(~F.exists(ms, lambda m: m.isNull()), ms)
    return F.when(sound, F.get(F.transform(F.array(members), whole), 0))


def members_to_wkt(members) -> Column:
    """Text of the collection, whatever its members are."""
    members = G._col(members)
    body = F.array_join(F.transform(members, G.to_wkt), ", ")
    return F.when(F.size(members) == 0, F.lit("GEOMETRYCOLLECTION EMPTY")).when(members.isNotNull(), F.concat(F.lit("GEOMETRYCOLLECTION ("), body, F.lit(")")))


def members_to_geojson(members, properties: Column | None = None) -> Column:
    """A feature whose geometry is the collection, as one line of JSON."""
    members = G._col(members)
    # A member's shape is the geometry of its own feature.
    shape = lambda m: F.regexp_extract(G.to_geojson(m), r'"geometry":(.*),"properties":null\}$', 1)
    attributes = F.coalesce(F.to_json(properties), F.lit("null")) if properties is not None else F.lit("null")
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(members, shape), ","), F.lit(']},"properties":'), attributes, F.lit("}"))


def total(members, measure) -> Column:
    """Sum of a measure (``G.area``, ``G.length``) over the members."""
    return F.aggregate(F.transform(G._col(members), lambda m: F.coalesce(measure(m), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)


def area(members) -> Column:
    return total(members, lambda m: F.when(G.is_polygon(m), G.area(m)))


def extent(members) -> Column:
    """Box of all members; null where all are empty."""
    members = G._col(members)
    least = lambda k: F.array_min(F.transform(members, lambda m: m[k])).alias(k)
    most = lambda k: F.array_max(F.transform(members, lambda m: m[k])).alias(k)
    return F.struct(least("xmin"), least("ymin"), most("xmax"), most("ymax"))


def member_rows(df: DataFrame, column: str, number: str, geometry: str) -> DataFrame:
    """A row for each member with its number, in place of the collection; rows
    of null or empty collections stay with null for both."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode_outer(column).alias(number, geometry))
