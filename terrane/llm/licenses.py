"""Licence scan: Dice coefficient of word bigrams against licence templates.

Every line and every paragraph (lines between blank lines) of a document is a
passage.  Passages and templates are normalised alike: lower case, anything but
letters and digits is a separator.  A passage matches a template when the Dice
coefficient 2|A & B| / (|A| + |B|) of their sets of word bigrams is at least
``threshold``.  Since Dice is at most 2 min(a, b) / (a + b), a passage with b
bigrams can only match a template whose size lies between b t / (2 - t) and
b (2 - t) / t; that bound is checked before any bigram is compared.  The same bounds say that a match holds at least a share
t / (2 - t) of the template's bigrams, so it holds a word of any group of words
whose bigrams are more than the rest: ``marker_words`` picks such groups, and
texts and passages without one of them are dropped by a plain search.

A licence of several paragraphs, or one inside a longer line, is no such
passage.  So windows of words slide over the whole normalised text as well: a
window may start and end at any bigram of the template and hold at most
size (2 - t) / t bigrams; the best end is kept for each start.  Of windows that
overlap, the best is the passage that is counted (then the longest, then the
first); a window inside a matching line or paragraph of the same licence is that
passage and not another one.

Both are expressions over a row, and the templates are literals in them; the
only shuffle carries matches.

Defined results: null and empty texts, and texts without a match, give one row
with 0 matches and null licence; rows that repeat an id all get the matches of
that id's texts together; ties of Dice go to the licence first in order of name;
texts of any length are scanned whole (long passages fall to the size bound,
windows go on); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import let

#: Wording by which each licence is commonly granted.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "permissive",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    (
        "MIT",
        "permissive",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "BSD-3-Clause",
        "permissive",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "copyleft",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
)


def bigrams(passage: Column) -> Column:
    """Distinct word bigrams of a passage, as strings; fewer than two words: none."""
    pairs = lambda ws: F.when(F.size(ws) > 1, F.array_distinct(F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))
    return let(tokens_of(passage), pairs)


def template_bigrams(body: str) -> list[str]:
    """Distinct word bigrams of a template, which is plain ASCII."""
    tokens = [w for w in re.split(r"[^a-z0-9]+", body.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)))


def template_array(templates, threshold: float) -> Column:
    """The templates as literals: bigrams, their number, the least number of
    them in a match and the most bigrams in a window."""
    rows = []
    for name, kind, body in templates:
        b = template_bigrams(body)
        need, width = math.ceil(len(b) * threshold / (2 - threshold) - 1e-9), math.floor(len(b) * (2 - threshold) / threshold + 1e-9)
        fields = {"license": F.lit(name), "kind": F.lit(kind), "bigrams": F.array(*map(F.lit, b)), "size": F.lit(len(b)), "need": F.lit(max(1, need)), "width": F.lit(width)}
        rows.append(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return F.array(*rows)


def marker_words(templates=TEMPLATES, threshold: float = 0.8) -> list[str]:
    """Words of which every possible match holds one: for each template, words
    that touch more bigrams than a match may lack.  Words that serve many
    templates are taken first, so that the list stays short."""
    pairs = []
    for _, _, body in templates:
        tokens = [w for w in re.split(r"[^a-z0-9]+", body.lower()) if w]
        pairs.append(set(zip(tokens, tokens[1:], strict=False)))
    serves = Counter(w for p in pairs for w in {w for pair in p for w in pair} if len(w) >= 3)
    chosen: list[str] = []
    for p in sorted(pairs, key=len):
        free = [pair for pair in p if not set(pair) & set(chosen)]
        for w in sorted({w for pair in free for w in pair}, key=lambda w: (len(w) < 3, -serves[w] * (len(w) > 5), -len(w), w)):
            if len(free) < len(p) * threshold / (2 - threshold):
                break
            chosen.append(w)
            free = [pair for pair in free if w not in pair]
    return chosen


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def match(key: Column, dice: Column, template: Column, words: Column) -> Column:
    return F.struct(key.alias("key"), dice.alias("dice"), template["license"].alias("license"), template["kind"].alias("kind"), words.alias("words"))


def passage_matches(passages: Column, known: Column, threshold: float, least: float, most: float) -> Column:
    """Matches of lines and paragraphs with the templates."""
    sized = F.filter(F.transform(passages, lambda p: F.struct(p.alias("p"), bigrams(p).alias("b"))), lambda s: F.size(s["b"]).between(least, most))

    def against(s: Column) -> Column:
        n = F.size(s["b"])
        near = F.filter(known, lambda t: (n >= t["size"] * (threshold / (2 - threshold))) & (n <= t["size"] * ((2 - threshold) / threshold)))
        dice = lambda t: 2 * F.size(F.array_intersect(s["b"], t["bigrams"])) / (n + t["size"])
        return F.filter(F.transform(near, lambda t: match(F.xxhash64(s["p"]), dice(t), t, F.array_join(tokens_of(s["p"]), " "))), lambda m: m["dice"] >= threshold)

    return F.flatten(F.transform(sized, against))


def window_matches(text: Column, known: Column, every: Column, threshold: float) -> Column:
    """Matches of windows of the whole text with the templates; a window that
    overlaps a better one has no key."""

    def of_template(tokens: Column, grams: Column, t: Column) -> Column:
        def ends(hits: Column, k: Column) -> Column:
            first = F.get(hits, k)
            last = F.filter(F.slice(hits, k + t["need"], t["width"] - t["need"] + 1), lambda e: e - first < t["width"])

            def ending(e: Column) -> Column:
                dice = lambda w: 2 * F.size(F.array_intersect(w, t["bigrams"])) / (F.size(F.array_distinct(w)) + t["size"])
                return F.struct(let(F.slice(grams, first + 1, e - first + 1), dice).alias("dice"), (-e).alias("e"))

            best = F.array_max(F.transform(last, ending))
            return F.struct((-best["dice"]).alias("d"), (first + best["e"]).alias("shorter"), first.alias("a"), (-best["e"]).alias("e"), t["license"].alias("license"), t["kind"].alias("kind"))

        def of_hits(hits: Column) -> Column:
            # Starts whose window holds as many hits as a match must.
            starts = F.filter(F.transform(hits, lambda h, k: F.when(F.get(hits, k + t["need"] - 1) - h < t["width"], k)), lambda k: k.isNotNull())
            return F.filter(F.transform(starts, lambda k: ends(hits, k)), lambda w: -w["d"] >= threshold)

        hits = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["bigrams"], g), i)), lambda i: i.isNotNull())
        return let(hits, of_hits)

    def of_grams(tokens: Column, grams: Column) -> Column:
        common = F.array_intersect(grams, every)
        live = let(common, lambda c: F.filter(known, lambda t: F.size(F.array_intersect(t["bigrams"], c)) >= t["need"]))
        found = F.array_sort(F.flatten(F.transform(live, lambda t: of_template(tokens, grams, t))))
        # A window a .. e of bigrams has the words a .. e + 1.
        meets = lambda v, w: (v["a"] <= w["e"] + 1) & (w["a"] <= v["e"] + 1)

        def keyed(ws: Column) -> Column:
            span = lambda w: F.struct(w["a"].alias("a"), w["e"].alias("e"))
            kept = F.aggregate(ws, F.array().cast("array<struct<a:int,e:int>>"), lambda acc, w: F.when(F.exists(acc, lambda v: meets(v, w)), acc).otherwise(F.concat(acc, F.array(span(w)))))
            words = lambda w: F.array_join(F.slice(tokens, w["a"] + 1, w["e"] - w["a"] + 2), " ")
            own = lambda ks, w: F.exists(ks, lambda v: (v["a"] == w["a"]) & (v["e"] == w["e"]))
            return let(kept, lambda ks: F.transform(ws, lambda w: let(words(w), lambda x: match(F.when(own(ks, w), F.xxhash64(x)), -w["d"], w, x))))

        return let(found, keyed)

    def of_tokens(tokens: Column) -> Column:
        n = F.size(tokens) - 1
        grams = F.zip_with(F.slice(tokens, 1, F.greatest(n, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return let(grams, lambda g: of_grams(tokens, g))

    return let(tokens_of(text), of_tokens)


def scan(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document id with a match: number of its different matching
    passages, the best licence, its kind and Dice coefficient, and all licences
    that match."""
    known = template_array(templates, threshold)
    # The templates are a fixed list: their sizes are known here and bound what is compared.
    sizes = [len(template_bigrams(body)) for _, _, body in templates]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    every = F.array(*[F.lit(g) for g in dict.fromkeys(g for _, _, body in templates for g in template_bigrams(body))])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    marked = lambda c: F.lower(c).rlike("|".join(marker_words(templates, threshold)))
    rows = rows.filter(marked(F.col("text")))
    lines = F.split("text", r"\r?\n")
    blocks = F.split("text", r"\r?\n[ \t]*\r?\n\s*")
    passages = F.filter(F.array_union(lines, F.filter(blocks, lambda b: F.instr(b, "\n") > 0)), marked)

    inside = lambda w, m: (w["license"] == m["license"]) & F.contains(F.concat(F.lit(" "), m["words"], F.lit(" ")), F.concat(F.lit(" "), w["words"], F.lit(" ")))
    windows = window_matches(F.col("text"), known, every, threshold)
    matches = let(passage_matches(passages, known, threshold, least, most), lambda ms: F.concat(ms, F.filter(windows, lambda w: ~F.exists(ms, lambda m: inside(w, m)))))
    found = (
        rows.select("doc_id", F.inline(matches))
        .groupBy("doc_id")
        .agg(
            F.countDistinct("key").alias("n_matches"),
            F.min(F.struct((-F.col("dice")).alias("d"), "license", "kind")).alias("best"),
            F.sort_array(F.collect_set("license")).alias("licenses"),
        )
    )
    return found.select("doc_id", "n_matches", F.col("best.license").alias("license"), F.col("best.kind").alias("kind"), F.round(-F.col("best.d"), 6).alias("dice"), "licenses")


def op10(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every document, with or without a licence passage."""
    found = scan(docs, threshold)
    every = docs.select(F.col("doc_id").alias("id"))
    return every.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "license", "kind", "dice", F.array_join("licenses", ",").alias("licenses"))
