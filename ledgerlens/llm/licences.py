"""Licence scan: Dice coefficient of word bigrams; DataFrame functions only.

Texts are compared with licence templates in units: every line, the whole text
where it has several lines with words (for licence files), and windows of the
text's words (for notices inside longer files, wrapped ones and sentences
within a line).  A window has as many words as a template and is laid so that a
telling bigram of that template stands at its place in it; it is compared with
that template only, and ends with the text.

A unit is normalised (lower case, words of letters and digits) and taken as its
set of word bigrams; a unit of one word has that word as its only element.
With a, b the sizes and s the shared bigrams, Dice is 2 s / (a + b).  As s is
at most the smaller size, a unit reaches ``least`` only if its size lies within
``b * least / (2 - least)`` and ``b * (2 - least) / least``; only templates
that pass this bound are compared, and only by units that share a bigram with
any template.  A match shares ``b * least / (2 - least)`` of a template's
bigrams at least, so it has one of any larger rest of them, the template's
telling bigrams: texts without the longer word of any of these are left before
they are compared, and every window that could match holds one.

The templates are fixed values in this module, so what goes to the workers is
bounded.  Of long licences they hold the heading or the notice.

Defined results: a null text counts as empty; units without words match
nothing; ties go to lines and whole texts before windows, then to the earliest
unit, then to the template that comes first; repeated rows are kept; an empty
table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names and texts, as published by their stewards.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)

#: Dice in hundredths that a match has to reach.
LEAST = 80
WORD = "[a-z0-9]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])}) or sorted(set(words))


def telling_bigrams(grams: list[str], least: int) -> list[str]:
    """So many of a template's bigrams that a match has at least one of them."""
    shared = -(-len(grams) * least // (200 - least))
    return sorted(grams, key=lambda g: (-max(map(len, g.split(" "))), -len(g), g))[: len(grams) - shared + 1]


def telling_places(text: str, least: int) -> list[tuple[str, int]]:
    """A template's telling bigrams and the first place of each in it."""
    words = re.findall(WORD, text.lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [(g, pairs.index(g)) for g in telling_bigrams(template_bigrams(text), least)] if pairs else []


def template_names(templates=TEMPLATES) -> list[str]:
    """A template's name: its licence and its number in the list."""
    return [f"{licence}#{k}" for k, (licence, _) in enumerate(templates)]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def bigrams(words: Column) -> Column:
    """The pairs of neighbours among some words; of a single word, that word."""
    n = F.size(words)
    rest = F.greatest(n - 1, F.lit(0))
    return F.when(n >= 2, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


UNITS = "array<struct<unit:int,grams:array<string>>>"
#: Added to the first word of a window, which may lie before the text.
BEFORE = 1 << 20


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_units`` (lines and whole texts) and
    ``n_windows`` that match, and the best match (``licence``, ``template``,
    ``unit``, ``start``, ``shared``, ``dice``; null if none).

    ``unit`` numbers the lines from 1, 0 is the whole text; of a window it is
    null, and ``start`` is its first word, from 0.
    """
    sets = [template_bigrams(t) for _, t in templates]
    places = [(g, k, at, len(re.findall(WORD, text.lower()))) for k, (_, text) in enumerate(templates) for g, at in telling_places(text, least)]
    low = min(-(-len(g) * least // (200 - least)) for g in sets)
    high = max(len(g) * (200 - least) // least for g in sets)
    listed = lambda values: F.array(*map(F.lit, values))
    any_bigram = listed(sorted(set().union(*sets)))
    any_word = listed(sorted({max(g.split(" "), key=lambda w: (len(w), w)) for g, *_ in places} | {g for s in sets for g in s if " " not in g}))
    telling = listed(sorted({g for g, *_ in places}))
    table = F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(k).alias("of"), F.lit(at).alias("at"), F.lit(n).alias("words")) for g, k, at, n in places])
    known = F.array(*[F.struct(listed(g).alias("grams"), F.lit(len(g)).alias("b"), F.lit(licence).alias("licence"), F.lit(name).alias("template"), F.lit(k).alias("of"), F.lit(len(re.findall(WORD, text.lower()))).alias("words")) for k, (g, name, (licence, text)) in enumerate(zip(sets, template_names(templates), templates))])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    maybe = F.arrays_overlap("words", any_word)
    rows = rows.select("doc_id", F.when(maybe, F.col("text")).alias("text"), F.when(maybe, F.col("words")).alias("words"))

    unit = lambda number, grams: F.struct(number.cast("int").alias("unit"), F.array_distinct(grams).alias("grams"))
    null = F.lit(None).cast("int")

    def tried(t: Column, grams: Column, number: Column, start: Column) -> Column:
        """How a set of bigrams compares with a template."""
        a = F.size(grams)
        return _let(F.size(F.array_intersect(grams, t["grams"])), lambda s: F.struct((F.lit(2.0) * s / (a + t["b"])).alias("dice"), number.isNotNull().alias("whole"), (-F.coalesce(number, start)).alias("before"), (-t["of"]).alias("first"), number.alias("unit"), start.alias("start"), s.alias("shared"), t["licence"].alias("licence"), t["template"].alias("template"), (200 * s >= least * (a + t["b"])).alias("match")))

    def best_of(u: Column) -> Column:
        """A unit's best template: highest Dice, then the first."""
        a = F.size(u["grams"])
        bound = lambda t: (a * (200 - least) >= least * t["b"]) & (a * least <= (200 - least) * t["b"])
        return F.array_max(F.filter(F.transform(F.filter(known, bound), lambda t: tried(t, u["grams"], u["unit"], null)), lambda t: t["match"]))

    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, k: unit(k + 1, bigrams(words_of(x)))), lambda u: F.size(u["grams"]) > 0)
    # the whole text's bigrams are only worth having if no line is far too long
    whole = lambda found: F.when((F.size(found) > 1) & (F.array_max(F.transform(found, lambda u: F.size(u["grams"]))) <= high), F.array(unit(F.lit(0), bigrams(F.col("words"))))).otherwise(F.array().cast(UNITS))
    sized = _let(lines, lambda found: F.filter(F.concat(found, whole(found)), lambda u: (F.size(u["grams"]) >= low) & (F.size(u["grams"]) <= high) & F.arrays_overlap(u["grams"], any_bigram)))

    def windows(grams: Column) -> Column:
        """What the windows that telling bigrams lay have in common with their templates.

        A window is one number of its start and its template, so that equal ones
        are found by hashing; its bigrams are cut out as it is compared and go
        with it, so that a long text's windows never lie side by side.
        """
        laid = lambda g, p: F.when(F.array_contains(telling, g), F.transform(F.filter(table, lambda e: e["gram"] == g), lambda e: (p - e["at"] + BEFORE).cast("bigint") * len(templates) + e["of"]))
        keys = F.array_distinct(F.flatten(F.array_compact(F.transform(grams, laid))))

        def compared(key: Column) -> Column:
            start = (F.floor(key / len(templates)) - BEFORE).cast("int")
            cut = lambda t: F.array_distinct(F.slice(grams, F.greatest(start, F.lit(0)) + 1, start + t["words"] - 1 - F.greatest(start, F.lit(0))))
            return _let(F.get(known, (key % len(templates)).cast("int")), lambda t: _let(cut(t), lambda own: F.when(F.size(own) * (200 - least) >= least * t["b"], tried(t, own, null, start))))

        return F.filter(F.transform(keys, compared), lambda t: F.coalesce(t["match"], F.lit(False)))

    found = F.concat(F.array_compact(F.transform(sized, best_of)), _let(bigrams(F.col("words")), windows))
    out = rows.select("doc_id", F.when(F.col("text").isNotNull(), found).alias("found"))
    number = lambda whole: F.coalesce(F.size(F.filter("found", lambda t: t["whole"] == whole)), F.lit(0)).cast("bigint")
    best = F.array_max("found")
    return out.select(
        "doc_id",
        F.when(F.col("found").isNull(), F.lit(0).cast("bigint")).otherwise(number(True)).alias("n_units"),
        F.when(F.col("found").isNull(), F.lit(0).cast("bigint")).otherwise(number(False)).alias("n_windows"),
        best["licence"].alias("licence"),
        best["template"].alias("template"),
        best["unit"].cast("bigint").alias("unit"),
        best["start"].cast("bigint").alias("start"),
        best["shared"].cast("bigint").alias("shared"),
        best["dice"].alias("dice"),
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST) -> str:
    """The query's rows in DuckDB SQL, every unit against every template."""
    rows, places = [], []
    for k, ((licence, text), name) in enumerate(zip(templates, template_names(templates))):
        g = template_bigrams(text)
        rows += [f"({k}, '{licence}', '{name}', {len(g)}, '{x}')" for x in g]
        places += [f"({k}, '{x}', {at}, {len(re.findall(WORD, text.lower()))})" for x, at in telling_places(text, least)]
    return f"""
WITH t(k, licence, template, b, gram) AS (VALUES {', '.join(rows)}),
place(k, gram, at_, n) AS (VALUES {', '.join(places)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit FROM d),
w AS (SELECT r, unit, regexp_extract_all(lower(x), '{WORD}') AS words FROM l
    UNION ALL SELECT r, 0, regexp_extract_all(lower(text), '{WORD}') FROM d WHERE r IN (SELECT r FROM l WHERE regexp_matches(lower(x), '{WORD}') GROUP BY r HAVING count(*) > 1)),
g AS (SELECT r, unit, list_distinct(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS grams FROM w WHERE len(words) > 0),
s AS (SELECT r, unit, NULL::BIGINT AS start, k, licence, template, b, len(grams) AS a, count(*) AS shared FROM (SELECT r, unit, grams, unnest(grams) AS gram FROM g) JOIN t USING (gram) GROUP BY ALL),
v AS (SELECT r, regexp_extract_all(lower(text), '{WORD}') AS words FROM d),
p AS (SELECT r, unnest(range(len(words) - 1)) AS p, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM v WHERE len(words) > 1),
x AS (SELECT DISTINCT r, k, p - at_ AS start, n FROM p JOIN place USING (gram)),
y AS (SELECT x.r, x.k, start, count(DISTINCT gram) AS a FROM x JOIN p ON p.r = x.r AND p.p >= start AND p.p < start + n - 1 GROUP BY ALL),
z AS (SELECT x.r, x.k, start, licence, template, b, count(DISTINCT p.gram) AS shared FROM x JOIN p ON p.r = x.r AND p.p >= start AND p.p < start + n - 1 JOIN t ON t.k = x.k AND t.gram = p.gram GROUP BY ALL),
c AS (SELECT r, unit, start, k, licence, template, b, a, shared FROM s UNION ALL SELECT r, NULL, start, k, licence, template, b, a, shared FROM z JOIN y USING (r, k, start)),
m AS (SELECT *, 2.0::DOUBLE * shared / (a + b) AS dice FROM (SELECT r, unit, start, k, licence, template, b, a, CAST(shared AS DOUBLE) AS shared FROM c) WHERE 200 * shared >= {least} * (a + b)),
u AS (SELECT * FROM m WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, k) = 1),
n AS (SELECT r, count(unit) AS n, count(start) AS n_windows FROM (SELECT r, unit, start FROM u UNION ALL SELECT r, unit, start FROM m WHERE start IS NOT NULL) GROUP BY r),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, unit IS NULL, coalesce(unit, start), k) = 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_units, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, licence, template,
    CAST(unit AS BIGINT) AS unit, start, CAST(shared AS BIGINT) AS shared, dice
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN best ON best.r = d.r
"""
