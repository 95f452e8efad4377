"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

Units are the lines of a text, the whole text, and windows of words: where a template's anchor word occurs, the window
that a copy of the template would fill there, wherever lines break and whatever stands around it. A line or text is
compared with a template only if their bigram counts allow the threshold: 2 * min / (a + b) >= t; others are pruned before
any comparison. Only texts that hold a word of licences are looked at for windows. Templates are a fixed list in the plan;
everything is a column function of one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.words import bound, lines_of

THRESHOLD = 0.8
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public "
        f"License as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
        "any later version."
    )


#: SPDX identifier, anchor word, text of licences and of notices of them; a licence may have several forms.
TEMPLATES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "This project is licensed under the MIT License."),
    ("MIT", "sublicense", _MIT),
    (
        "MIT",
        "sublicense",
        _MIT
        + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. " + _AS_IS + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
    ("ISC", "fee", _ISC + _ISC_NOTICE),
    ("ISC", "fee", _ISC + _ISC_NOTICE + _ISC_END),
    ("0BSD", "fee", _ISC + "." + _ISC_END),
    ("BSD-3-Clause", "redistribution", _BSD),
    ("BSD-2-Clause", "redistribution", _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", "redistribution", _BSD + _BSD_TWO + _BSD_THREE + _BSD_END),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
    ),
    (
        "Apache-2.0",
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0-only", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "gnu", _gnu("General", "3")),
    ("GPL-2.0-only", "gnu", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "gnu", _gnu("General", "2")),
    ("LGPL-3.0-only", "gnu", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", "gnu", _gnu("Lesser General", "3")),
    ("AGPL-3.0-or-later", "gnu", _gnu("Affero General", "3")),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "mozilla",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "cc", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "commons", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "commons", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "Zlib",
        "warranty",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "unencumbered",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
)
#: Every anchor implies a match of this in the text; words end where those of the normal form do, at any other character.
_HINT = r"(?i)(?<![a-z0-9])(?:mit|sublicense|fee|redistribution|apache|gnu|mozilla|cc|commons|warranty|unencumbered)(?![a-z0-9])"


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the most bigrams that a unit may have to reach the threshold against n of a template."""
    fits = [m for m in range(1, int(n * 2 / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n)]
    return min(fits), max(fits)


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def _hashes(grams: list[str]) -> Column:
    pairs = (g.split(" ") for g in grams)
    return F.expr("array(" + ", ".join(f"xxhash64('{a}', '{b}')" for a, b in pairs) + ")")


def best_template(words: Column, threshold: float = THRESHOLD) -> Column:
    """struct(score, order) of the best template for some words, null if none reaches the threshold; ties go to the first.

    Bigrams are compared as 64-bit hashes. A template is intersected only if the unit's bigram count lies in its bounds.
    """

    def compared(b: Column) -> Column:
        scores = []
        for i, (_, _, text) in enumerate(TEMPLATES):
            grams = bigrams_of(text)
            low, high = bounds(len(grams), threshold)
            shared = F.when(F.size(b).between(low, high), F.size(F.array_intersect(b, _hashes(grams)))).otherwise(0)
            dice = 2.0 * shared / (F.size(b) + len(grams))
            scores.append(F.struct(dice.alias("score"), F.lit(-i).alias("order")))
        return bound(F.greatest(*scores), lambda best: F.when(best["score"] >= threshold, best))

    return bound(_bigrams(words), compared)


def windows(words: Column, threshold: float = THRESHOLD) -> Column:
    """array of struct(score, order): for each template the best of the windows about its anchor's occurrences."""
    anchors = sorted({anchor for _, anchor, _ in TEMPLATES})
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def best_of(at: Column, anchor: str, text: str) -> Column:
        own, grams = normal_words(text), bigrams_of(text)
        before = own.index(anchor)

        def score(x: Column) -> Column:
            window = F.slice(words, F.greatest(x["i"] - before + 1, F.lit(1)), F.lit(len(own)))
            return bound(_bigrams(window), lambda b: 2.0 * F.size(F.array_intersect(b, _hashes(grams))) / (F.size(b) + len(grams)))

        return F.array_max(F.transform(F.filter(at, lambda x: x["w"] == anchor), score))

    def found(at: Column) -> Column:
        best = [
            F.struct(best_of(at, anchor, text).alias("score"), F.lit(-k).alias("order")) for k, (_, anchor, text) in enumerate(TEMPLATES)
        ]
        return F.filter(F.array(*best), lambda b: F.coalesce(b["score"] >= threshold, F.lit(False)))

    return bound(F.filter(numbered, lambda x: x["w"].isin(*anchors)), found)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `licenses`: array of (line, license, score).

    First the whole text (line -1) if it has several lines and matches, then the lines that match, in order, then (line
    -2) licences found in windows of words only, best first, each once. Null and empty texts have none; repeated rows have
    equal results; null ids pass through; an empty table gives an empty one; other columns pass through, and a column
    named licenses is replaced.
    """
    names = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])
    none = F.array().cast("array<struct<line:int,license:string,score:double>>")

    def entry(line: Column, best: Column) -> Column:
        return F.struct(
            line.cast("int").alias("line"), F.get(names, -best["order"]).alias("license"), best["score"].alias("score")
        )

    def matches(lines: Column) -> Column:
        judged = F.transform(
            lines, lambda x, i: F.struct(i.alias("line"), best_template(F.split(_normal(x), " "), threshold).alias("best"))
        )
        return F.transform(F.filter(judged, lambda j: j["best"].isNotNull()), lambda j: entry(j["line"], j["best"]))

    body = F.coalesce(F.col("text"), F.lit(""))

    def of_text(words: Column) -> Column:
        whole = F.when(F.contains(body, F.lit("\n")), best_template(words, threshold))
        first = bound(whole, lambda w: F.when(w.isNotNull(), F.array(entry(F.lit(-1), w))).otherwise(none))
        inside = F.when(body.rlike(_HINT), windows(words, threshold)).otherwise(F.array().cast("array<struct<score:double,order:int>>"))
        ordered = F.transform(F.array_sort(F.transform(inside, lambda x: F.struct((-x["score"]).alias("s"), (-x["order"]).alias("o")))), lambda x: F.struct((-x["s"]).alias("score"), (-x["o"]).alias("order")))
        return F.struct(first.alias("whole"), F.transform(ordered, lambda x: entry(F.lit(-2), x)).alias("windows"))

    def joined(text: Column, lines: Column) -> Column:
        """Windows are told only of licences that no line and not the whole text has, and of each only the first."""
        units = F.concat(text["whole"], lines)

        def add(found: Column, x: Column) -> Column:
            known = F.exists(found, lambda y: y["license"] == x["license"])
            return F.when(known, found).otherwise(F.concat(found, F.array(x)))

        return F.aggregate(text["windows"], units, add)

    several = F.contains(body, F.lit("\n")) | body.rlike(_HINT)
    nothing = F.struct(none.alias("whole"), none.alias("windows"))
    text = F.when(several, bound(F.split(_normal(body), " "), of_text)).otherwise(nothing)
    both = bound(F.struct(text.alias("text"), matches(lines_of(F.col("text"))).alias("lines")), lambda b: joined(b["text"], b["lines"]))
    return docs.withColumn("licenses", both)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = F.array_sort(
        F.transform("licenses", lambda x: F.struct((-x["score"]).alias("s"), x["line"].alias("line"), x["license"].alias("license")))
    )
    return (
        scan(docs)
        .select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.get(order, F.lit(0)).alias("best"))
        .select(
            "doc_id",
            "n_matches",
            F.col("best.license").alias("license"),
            F.round(-F.col("best.s"), 6).alias("score"),
            F.col("best.line").alias("line"),
        )
    )


def _sql() -> str:
    rows = ", ".join(
        f"({i}, '{name}', '{anchor}', {normal_words(text).index(anchor)}, {len(normal_words(text))}, [{', '.join(repr(g) for g in bigrams_of(text))}])"
        for i, (name, anchor, text) in enumerate(TEMPLATES)
    )
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t(i, license, anchor, ahead, n, g) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
u AS (
  SELECT r, unnest(range(len(l))) AS line, unnest(l) AS unit
  FROM (SELECT r, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL)
  UNION ALL SELECT r, -1, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT r, line, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT r, line, {grams} AS b FROM w),
s AS (
  SELECT r, line, i, license, 2.0::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) AS score
  FROM b JOIN t ON len(b) BETWEEN floor(len(g) * {THRESHOLD} / (2 - {THRESHOLD})) AND ceil(len(g) * (2 - {THRESHOLD}) / {THRESHOLD})),
m AS (
  SELECT r, line, license, score FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY score DESC, i) AS k FROM s WHERE score >= {THRESHOLD})
  WHERE k = 1),
x AS (SELECT r, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d WHERE text IS NOT NULL),
a AS (SELECT r, w AS whole, unnest(range(len(w))) AS place, unnest(w) AS anchor FROM x),
v AS (SELECT r, i, license, g, list_slice(whole, greatest(place - ahead, 0) + 1, greatest(place - ahead, 0) + n) AS w FROM a JOIN t ON t.anchor = a.anchor),
z AS (SELECT r, i, license, 2.0::DOUBLE * len(list_intersect({grams}, g)) / (len({grams}) + len(g)) AS score FROM v),
y AS (
  SELECT r, -2 AS line, license, max(score) AS score FROM z WHERE score >= {THRESHOLD}
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.r = z.r AND m.license = z.license) GROUP BY r, license),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, line, license) AS best, count(*) OVER (PARTITION BY r) AS n FROM (SELECT r, line, license, score FROM m UNION ALL SELECT r, line, license, score FROM y))
SELECT d.doc_id, coalesce(o.n, 0)::BIGINT AS n_matches, o.license, round(o.score, 6) AS score, o.line::INTEGER AS line
FROM d LEFT JOIN o ON o.r = d.r AND o.best = 1
"""


OP7_SQL = _sql()
