"""Quality rules: a threshold table compiled into one projection.

``RULES`` is data: every rule names an integer measure, a multiple of it, and
the bound that it is held against.  ``apply_rules`` compiles the table into a
single ``select`` over the documents, so the whole operator is one narrow scan
with no shuffle, no join and no user function; it is linear in the input and
each row is independent of every other.

Defined results for odd input: a null or blank text has no words, fails the
base rule and is not kept; repeated rows are judged one by one; a very long
text costs one sort of its own windows; columns of the input with clashing
names are not carried, except ``id_column``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import let, words

#: Very common words of the languages that are served.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "his", "from", "at", "which", "an", "you",
    # German
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    # French
    "le", "la", "les", "et", "des", "du", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "pas", "au", "avec", "en",
    # Spanish
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "más", "es", "de",
)


@dataclass(frozen=True)
class Rule:
    """Fails a text when ``left_factor * left  <op>  right_factor * right``."""

    name: str
    left_factor: int
    left: str
    op: str
    right_factor: int
    right: str  # a measure, or "1" for a constant bound


#: The base rules come first; the contract fixes them.
BASE_RULES = (
    Rule("too_few_words", 1, "n_words", "<", 20, "1"),
    Rule("repeated_windows", 100, "n_repeat_words", ">", 30, "n_words"),
)
RULES = (
    Rule("words_too_short", 10, "word_chars", "<", 20, "n_words"),
    Rule("words_too_long", 10, "word_chars", ">", 140, "n_words"),
    Rule("too_many_symbols", 100, "n_symbols", ">", 10, "n_words"),
    Rule("too_few_stop_words", 100, "n_stop_words", "<", 5, "n_words"),
    Rule("too_many_repeated_lines", 100, "n_dup_lines", ">", 30, "n_lines"),
    Rule("shouting", 100, "n_capitals", ">", 40, "word_chars"),
)


def _failed(rule: Rule, measure: dict[str, Column]) -> Column:
    left = F.lit(rule.left_factor) * measure[rule.left]
    right = F.lit(rule.right_factor) * measure.get(rule.right, F.lit(1))
    return left < right if rule.op == "<" else left > right


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in an 8-word window which the text holds twice or more.

    A text whose window hashes are all distinct (a hash set tells) has none.
    Otherwise the (hash, position) pairs are sorted once, equal neighbours mark
    repeated windows, and the union of their spans is summed over the sorted
    positions: n log n for a text of n words, whatever its repetition.
    """
    size = 8

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        hits = F.filter(F.transform(pairs, lambda p, i: F.when(same(i, i - 1) | same(i, i + 1), p["p"])), lambda p: p.isNotNull())
        return let(F.sort_array(hits), covered)

    def spans(codes: Column) -> Column:
        pairs = F.transform(codes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(codes)) == F.size(codes), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    def windows(hashes: Column) -> Column:
        return F.when(F.size(hashes) > size, let(doubled(doubled(doubled(hashes, 1), 2), 4), spans)).otherwise(F.lit(0))

    def doubled(codes: Column, width: int) -> Column:
        """Codes of windows twice as wide: each is paired with the one ``width`` on."""
        return let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - width), F.slice(c, width + 1, F.size(c) - width), lambda a, b: F.xxhash64(a, b)))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)


def _measures(text: Column) -> Column:
    """Struct of every measure, all from one split of the text."""
    text = F.coalesce(text, F.lit(""))

    def from_lines(lines: Column, tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(tokens).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(tokens, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.size(F.split(text, "[A-Z]")) - 1).cast("long").alias("n_capitals"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda tokens: let(lines, lambda ls: from_lines(ls, tokens)))


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``kept`` and the
    names of the rules it fails."""
    found = docs.select(F.col(id_column), _measures(F.col(text_column)).alias("m"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals")
    measure = {n: F.col(f"m.{n}") for n in names}
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | _failed(r, measure)
    failed = base_failed
    for r in rules:
        failed = failed | _failed(r, measure)
    broken = F.filter(F.array(*[F.when(_failed(r, measure), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    return found.select(id_column, *[measure[n].alias(n) for n in names], base_failed.alias("base_failed"), (~failed).alias("kept"), broken.alias("failed_rules"))


def op3(docs: DataFrame) -> DataFrame:
    """Contract columns; the remaining measures follow."""
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_capitals")
