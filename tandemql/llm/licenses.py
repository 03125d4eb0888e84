"""Licence scan: units of text against licence templates by the Dice coefficient over word bigrams.

Only DataFrame operations: no Python code runs on the executors.

A document's units are its lines, its paragraphs (between blank lines) of two lines or more, and windows of words.
Windows are looked for in what no line or paragraph that fits a template covers: runs of words of one paragraph,
within a line or over several, of as many bigrams as the size bounds of a template allow. Of those that fit, the one with the
greatest coefficient is taken, then the next that shares no word with it, and so on. A window is numbered in its document,
and its text is that of its normalised words. It begins and ends with a bigram of its template: others only lower the coefficient. A unit
and a template are normalised alike: lower case, every run of characters other than a-z and 0-9 a space.
With A and B their sets of bigrams, Dice = 2|A and B| / (|A| + |B|) can reach the threshold t only if
t/(2-t) |B| <= |A| <= (2-t)/t |B|; these size bounds prune the templates that a unit is compared with.
They also say how many of the template's bigrams a unit must have at least: of any |B| minus that many plus
one of them it has one. One pattern of such bigrams leaves out, without a loss, the texts and units that
can fit no template, before anything is cut into words.

Defined cases: null and empty texts have no units; a unit of fewer than two words matches nothing; of
templates with the same coefficient the first name by code point wins; repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemql.llm import common

THRESHOLD = 0.8

# The public licences' usual one-line notices, and paragraphs: all of MIT's, BSD's, ISC's, zlib's, Boost's and the
# Unlicense's, and the notices that the long licences ask for.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that a set may have to reach the threshold with a set of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def needed_pattern(known: list[tuple[str, list[str], int, int]]) -> str:
    """A pattern that every lower-case text which fits a template has: for each, its longest bigrams, as many as are needed."""
    needed = {g for _, grams, least, _ in known for g in sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - least + 1]}
    by_first: dict[str, list[str]] = {}
    for gram in sorted(needed):
        by_first.setdefault(gram[0], []).append(gram[1:].replace(" ", "[^a-z0-9]+"))
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + ")(?![a-z0-9])"


#: Stands in a document's words for what windows don't reach over. No word is equal to it.
BREAK = "\n"


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _fits(text: Column, known: list[tuple[str, list[str], int, int]], threshold: float) -> Column:
    def against(grams: Column) -> Column:
        fit = F.lit(False)
        for _, own, lo, hi in known:
            enough = F.size(F.array_intersect(grams, F.array(*map(F.lit, own)))) * 2.0 >= (F.size(grams) + len(own)) * (threshold - 1e-12)
            fit = fit | (F.size(grams).between(lo, hi) & enough)
        return fit

    return _let(_words(text), lambda words: _let(F.array_distinct(_bigrams(words)), against))


def _uncovered(text: Column, known: list[tuple[str, list[str], int, int]], needed: str, threshold: float) -> Column:
    """The words that no fitting line or paragraph covers, with BREAK between runs. Paragraphs without a needed bigram have no window."""
    gap = F.array(F.lit(BREAK))

    def line(unit: Column) -> Column:
        return F.when(F.lower(unit).rlike(needed) & _fits(unit, known, threshold), gap).otherwise(F.array_remove(_words(unit), ""))

    def paragraph(unit: Column) -> Column:
        covered = F.contains(unit, F.lit("\n")) & _fits(unit, known, threshold)
        return F.when(~F.lower(unit).rlike(needed) | covered, gap).otherwise(F.concat(F.flatten(F.transform(F.split(unit, "\n"), line)), gap))

    return F.flatten(F.transform(F.split(text, "\n[ \t\r]*\n"), paragraph))


def _windows(text: Column, known: list[tuple[str, list[str], int, int]], needed: str, threshold: float) -> Column:
    """The texts of the windows that fit, in order. A candidate is (-Dice, license, first word, bigrams)."""
    kind = "array<struct<less:double,license:string,first:int,size:int>>"
    none = F.array().cast(kind)

    def candidates(words: Column, grams: Column, name: str, own: list[str], lo: int, hi: int) -> Column:
        both = F.array(*map(F.lit, own))

        def judged(first: Column, size: Column) -> Column:
            window = F.slice(grams, first, size)
            dice = F.lit(2.0) * F.size(F.array_intersect(window, both)) / (F.size(F.array_distinct(window)) + len(own))
            whole = ~F.array_contains(F.slice(words, first, size + 1), F.lit(BREAK))
            return F.struct(F.when(whole, -dice).otherwise(0.0).alias("less"), F.lit(name).alias("license"), first.alias("first"), size.alias("size"))

        def begun(first: Column) -> Column:
            able = F.size(F.array_intersect(F.slice(grams, first, F.lit(hi)), both)) >= lo
            sizes = F.filter(F.sequence(F.lit(lo), F.least(F.lit(hi), F.size(grams) - first + 1)), lambda m: F.element_at(grams, first + m - 1).isin(own))
            fit = F.filter(F.transform(sizes, lambda m: judged(first, m)), lambda c: c["less"] <= -threshold + 1e-12)
            return F.when(able, fit.cast(kind)).otherwise(none)

        firsts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.element_at(grams, i).isin(own))
        return F.flatten(F.transform(firsts, begun))

    def apart(kept: Column, c: Column) -> Column:
        touches = F.exists(kept, lambda k: (k["first"] <= c["first"] + c["size"]) & (c["first"] <= k["first"] + k["size"]))
        return F.when(touches, kept).otherwise(F.concat(kept, F.array(c)))

    def of(words: Column, grams: Column) -> Column:
        ranked = F.array_sort(F.concat(*[candidates(words, grams, *k) for k in known]))
        kept = F.array_sort(F.transform(F.aggregate(ranked, none, apart), lambda c: F.struct(c["first"], c["size"])))
        return F.transform(kept, lambda c: F.array_join(F.slice(words, c["first"], c["size"] + 1), " "))

    def found(words: Column) -> Column:
        able = (F.size(words) > 1) & F.array_join(words, " ").rlike(needed)
        return F.when(able, _let(_bigrams(words), lambda grams: of(words, grams))).otherwise(F.array().cast("array<string>"))

    return _let(_uncovered(text, known, needed, threshold), found)


def _units(text: Column, windows: Column) -> Column:
    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("unit_no"), s.alias("unit")))

    lines = numbered("line", F.split(text, "\n"))
    paragraphs = F.filter(numbered("paragraph", F.split(text, "\n[ \t\r]*\n")), lambda u: F.contains(u["unit"], F.lit("\n")))
    return F.concat(lines, paragraphs, numbered("window", windows))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per unit that fits a template: doc_id, kind, unit_no (from 0), license, dice, unit.

    A narrow plan without a shuffle: units are cut, pruned and compared in the scan's own stage.
    """
    templates = TEMPLATES if templates is None else templates
    known = [(name, grams, *size_bounds(len(grams), threshold)) for name, text in templates if (grams := template_bigrams(text))]
    if not known:
        raise ValueError("no template has a bigram")
    least, most = min(lo for *_, lo, _ in known), max(hi for *_, hi in known)

    needed = needed_pattern(known)
    texts = common.pick(docs, doc_id=id_col, text=text_col).where(F.lower("text").rlike(needed))
    cut = texts.select("doc_id", F.inline(_units(F.col("text"), _windows(F.col("text"), known, needed, threshold)))).where(F.lower("unit").rlike(needed))
    words = F.split(F.trim(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " ")), " ")
    cut = cut.withColumn("_words", words).withColumn("_n", F.size("_words") - 1).where(F.col("_n") >= max(1, least))
    pairs = F.zip_with(F.slice("_words", F.lit(1), F.col("_n")), F.slice("_words", F.lit(2), F.col("_n")), lambda a, b: F.concat(a, F.lit(" "), b))
    cut = cut.withColumn("_grams", F.array_distinct(pairs)).withColumn("_size", F.size("_grams")).where(F.col("_size") <= most)

    def compared(name: str, grams: list[str], lo: int, hi: int) -> Column:
        both = F.size(F.array_intersect("_grams", F.array(*map(F.lit, grams))))
        dice = F.lit(2.0) * both / (F.col("_size") + len(grams))
        return F.when(F.col("_size").between(lo, hi), F.struct((-dice).alias("less"), F.lit(name).alias("license")))

    best = F.array_min(F.array(*[compared(*k) for k in known]))
    found = cut.withColumn("_best", best).where(F.col("_best.less") <= -threshold + 1e-12)
    return found.select("doc_id", "kind", "unit_no", F.col("_best.license").alias("license"), (-F.col("_best.less")).alias("dice"), "unit")


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan() over ``documents``, with the templates as a table and no pruning."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in template_bigrams(text))}])" for name, text in TEMPLATES)
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
lines AS (SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS parts FROM documents),
paragraphs AS (SELECT doc_id, 'paragraph' AS kind, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents),
units AS (
  SELECT doc_id, kind, unnest(generate_series(0, len(parts) - 1)) AS unit_no, unnest(parts) AS unit
  FROM (SELECT * FROM lines UNION ALL SELECT * FROM paragraphs)
),
worded AS (
  SELECT doc_id, kind, unit_no, unit, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM units WHERE kind = 'line' OR contains(unit, chr(10))
),
grammed AS (
  SELECT doc_id, kind, unit_no, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM worded WHERE len(w) > 1
),
scored AS (
  SELECT doc_id, kind, unit_no, unit, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grammed, templates WHERE len(g) <= 200
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind, unit_no ORDER BY dice DESC, license) AS r
  FROM scored WHERE dice >= {threshold} - 1e-12
)
SELECT doc_id, kind, CAST(unit_no AS BIGINT) AS unit_no, license, CAST(dice AS DOUBLE) AS dice, unit FROM best WHERE r = 1"""
