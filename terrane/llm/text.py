"""Column helpers shared by the operators that stay in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space and 0x09-0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long.  Every run of separators is folded into one
    space first, so that the count is a length and builds no array."""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(folded, SPACE_CLASS + "+", "")).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a lambda variable
    holds it, which keeps the whole computation in one projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may see: crc32(doc_id) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed_span(text: Column, key: Column, chars: int) -> Column:
    """At most so many characters of a text, from a place that its key's hash
    picks evenly; a text of no more characters is whole."""
    start = F.pmod(F.xxhash64(F.lit("span"), key), F.greatest(F.length(text) - chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    return F.substring(text, start, F.lit(chars))
