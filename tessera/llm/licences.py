"""Licence scans: normalised text against licence templates by Dice's coefficient over word bigrams.

Normalising maps A-Z to lower case and everything but a-z, 0-9 and line ends to spaces; lines
without words are blank. A document is read as units, ranges of its lines that are not blank:
the whole text, its blocks between blank lines, and for each template the lines that speak
for it (half of their bigrams or more are the template's) and the runs of such, over gaps of
up to `GAP` other lines. So a licence is found wherever it stands in a longer text, wrapped or in
several paragraphs. A unit's bigrams go on from line to line; a unit of one word has that word
for its only bigram.

A unit with a distinct bigrams can reach the coefficient t against a template with b only if
b * t / (2 - t) <= a <= b * (2 - t) / t, and shares b * t / (2 - t) of them at least. So
templates are compared with a document only if its text holds that many of their bigrams, and no
document is split into bigrams unless it holds one of a few words that such a share must touch.
Both bounds are exact: every document is read whole.

Templates are the notices and short licences below and the whole texts in the folder
`templates`. Licences of nearly one wording (the AGPL and the GPL) match one another.

Rows: null and empty texts, and texts without a letter or digit, match nothing. Equal
coefficients go to the template first in name. Repeated rows stay, null doc_ids too; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from math import ceil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

DICE = 0.8
GAP = 2

# The wording of licences and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice long": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "Released into the public domain under CC0 1.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}

# Common words, which say little about a licence.
COMMON = frozenset(
    """a about all also an and any are as at be been being but by can could do does each either for from had has have he her here his how if in into is it its
    may more must no not of on one only or other our shall she should so some such than that the their them then there these they this those to under up us use
    used was we were what when where which who whom will with without would you your""".split()
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def all_templates() -> dict[str, str]:
    """The templates above and the whole texts in the folder."""
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


def words_of(text: str) -> list[str]:
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return "".join(c if c in _LOWER + "0123456789" else " " for c in low).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} if len(words) > 1 else set(words))


def needed(n: int, dice: float) -> int:
    """How many of a template's n bigrams a unit has at least."""
    return ceil(n * dice / (2 - dice) - 1e-9)


def telling_words(grams: list[str], dice: float) -> set[str]:
    """Words of which a unit that matches has at least one: together they touch more bigrams than it may lack."""
    lacking, left, chosen = len(grams) - needed(len(grams), dice), [set(g.split()) for g in grams], set()
    while len(grams) - len(left) <= lacking:
        often = Counter(w for g in left for w in g)
        best = min(often, key=lambda w: (w in COMMON, len(w) < 4, -often[w], w))
        chosen.add(best)
        left = [g for g in left if best not in g]
    return chosen


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def candidates(docs: DataFrame, held: dict[str, list[str]], dice: float) -> DataFrame:
    """__key, __hash, __lines of each document and the name, grams of each template of which it has enough bigrams."""
    spark = docs.sparkSession
    telling = sorted(set().union(*(telling_words(g, dice) for g in held.values())))
    low = F.translate("text", _UPPER, _LOWER)
    spoken = docs.filter(F.arrays_overlap(F.split(low, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in telling])))
    lines = F.filter(
        F.transform(F.split(F.regexp_replace(low, "[^a-z0-9\n]+", " "), "\n"), lambda x, i: F.struct(i.alias("i"), F.filter(F.split(x, " "), lambda w: w != "").alias("words"))), lambda x: F.size(x["words"]) > 0
    )
    spoken = spoken.select(F.col("doc_id").cast("long").alias("__key"), F.xxhash64("text").alias("__hash"), _with(lines, _with_own).alias("__lines"))
    spoken = written(spoken, "licence-texts")
    grams = spoken.select("__key", "__hash", F.explode(_with(F.flatten(F.transform("__lines", lambda x: x["words"])), _bigrams)).alias("gram"))
    # The templates' bigrams are a fixed list, some thousands.
    known = spark.createDataFrame([(name, g, len(gs)) for name, gs in held.items() for g in gs], "name string, gram string, n int")
    least = spark.createDataFrame([(name, gs, needed(len(gs), dice)) for name, gs in held.items()], "name string, grams array<string>, least int")
    shared = grams.join(F.broadcast(known), "gram").groupBy("__key", "__hash", "name").agg(F.count(F.lit(1)).alias("shared"))
    enough = shared.join(F.broadcast(least), "name").filter("shared >= least").select(F.col("__key").alias("k"), F.col("__hash").alias("h"), "name", "grams")
    return spoken.join(enough, spoken["__key"].eqNullSafe(F.col("k")) & (spoken["__hash"] == F.col("h"))).drop("k", "h")


def _with_own(lines: Column) -> Column:
    """Lines, each with its distinct bigrams, the one to the next line included."""

    def own(x: Column, j: Column) -> Column:
        after = F.get(lines, j + 1)["words"]
        return _bigrams(F.concat(x["words"], F.when(after.isNull(), F.array().cast("array<string>")).otherwise(F.slice(after, 1, 1))))

    return F.transform(lines, lambda x, j: F.struct(x["i"].alias("i"), x["words"].alias("words"), own(x, j).alias("own")))


def _speaking(lines: Column, grams: Column) -> Column:
    """Numbers of the lines of whose bigrams the template has half."""
    says = F.transform(lines, lambda x, j: F.when(2 * F.size(F.array_intersect(x["own"], grams)) >= F.size(x["own"]), j))
    return F.filter(says, lambda j: j.isNotNull())


def _ranges(numbers: Column, reach: Column | int) -> Column:
    """first, last of the runs of ascending numbers that lie `reach` apart at most."""
    first = F.filter(F.transform(numbers, lambda x, j: F.when((j == 0) | (x - F.get(numbers, j - 1) > reach), x)), lambda x: x.isNotNull())
    last = F.filter(F.transform(numbers, lambda x, j: F.when((j == F.size(numbers) - 1) | (F.get(numbers, j + 1) - x > reach), x)), lambda x: x.isNotNull())
    return F.transform(first, lambda a, k: F.struct(a.alias("a"), F.get(last, k).alias("b")))


def _units(lines: Column, grams: Column) -> Column:
    """The ranges of lines to compare with a template."""
    size = F.size(lines)
    whole = F.array(F.struct(F.lit(0).alias("a"), (size - 1).alias("b")))
    # A block's lines follow one another in the text; what their numbers are among those not blank is the difference.
    starts = F.filter(F.transform(lines, lambda x, j: F.when((j == 0) | (x["i"] != F.get(lines, j - 1)["i"] + 1), j)), lambda j: j.isNotNull())
    blocks = F.transform(starts, lambda a, k: F.struct(a.alias("a"), F.coalesce(F.get(starts, k + 1) - 1, size - 1).alias("b")))
    # A line that matches speaks for the template: it shares two thirds of its bigrams or more.
    said = _with(_speaking(lines, grams), lambda p: F.concat(F.transform(p, lambda j: F.struct(j.alias("a"), j.alias("b"))), _ranges(p, GAP + 1)))
    return F.array_distinct(F.concat(whole, blocks, said))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, n_licences, licences (names of all that match), best and best_dice."""
    templates = all_templates() if templates is None else templates
    held = {name: grams for name, grams in sorted((name, bigrams_of(text)) for name, text in templates.items()) if grams}
    found = candidates(docs, held, dice)
    lines, grams = F.col("__lines"), F.col("grams")
    least = F.size(grams) * F.lit(dice / (2 - dice)) - 1e-9
    words = F.transform(F.col("units"), lambda u: F.flatten(F.transform(F.slice(lines, u["a"] + 1, u["b"] - u["a"] + 1), lambda x: x["words"])))
    coefficient = F.transform(F.filter(words, lambda w: F.greatest(F.size(w) - 1, F.lit(1)) >= least), lambda w: _with(_bigrams(w), lambda g: 2.0 * F.size(F.array_intersect(g, grams)) / (F.size(g) + F.size(grams))))
    best = found.withColumn("units", _units(lines, grams)).select("__key", "__hash", "name", F.array_max(coefficient).alias("d")).filter(F.col("d") >= dice)
    # Rows that repeat both doc_id and text are one here.
    per = best.groupBy("__key", "__hash", "name").agg(F.max("d").alias("d")).groupBy("__key", "__hash").agg(
        F.count(F.lit(1)).alias("n_licences"),
        F.array_join(F.sort_array(F.collect_list("name")), ",").alias("licences"),
        F.min(F.struct((-F.col("d")).alias("d"), "name")).alias("first"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    joined = rows.join(per, rows["doc_id"].eqNullSafe(per["__key"]) & (rows["h"] == per["__hash"]), "left")
    return joined.select("doc_id", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("licences", F.lit("")).alias("licences"), F.col("first.name").alias("best"), (-F.col("first.d")).alias("best_dice"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql(templates: dict[str, str], dice: float = DICE) -> str:
    rows = ", ".join(f"('{name}', {bigrams_of(text)!r})" for name, text in sorted(templates.items()))
    return rf"""
WITH t AS MATERIALIZED (SELECT * FROM (VALUES {rows}) AS v(name, grams)),
tg AS (SELECT name, len(grams) AS size, unnest(grams) AS gram FROM t),
p AS (SELECT DISTINCT doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS text FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
l1 AS MATERIALIZED (SELECT doc_id, i, list_filter(string_split(line, ' '), lambda x: x <> '') AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l0 WHERE trim(line) <> ''),
ls AS MATERIALIZED (SELECT doc_id, list(words ORDER BY j) AS lines FROM l1 GROUP BY doc_id),
w0 AS (SELECT doc_id, j, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM l1),
w AS (SELECT doc_id, j, word, lead(word) OVER (PARTITION BY doc_id ORDER BY j, k) AS after, count(*) OVER (PARTITION BY doc_id) AS n FROM w0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, j, CASE WHEN n = 1 THEN word ELSE word || ' ' || after END AS gram FROM w WHERE n = 1 OR after IS NOT NULL),
m AS MATERIALIZED (SELECT doc_id, j, gram, name, size FROM g JOIN tg USING (gram)),
c AS MATERIALIZED (SELECT doc_id, name FROM m GROUP BY doc_id, name HAVING count(DISTINCT gram) >= any_value(size) * {dice} / (2 - {dice}) - 1e-9),
sp AS (SELECT s.doc_id, s.name, s.j FROM (SELECT doc_id, j, name, count(*) AS shared FROM m GROUP BY ALL) s JOIN (SELECT doc_id, j, count(*) AS n FROM g GROUP BY ALL) USING (doc_id, j) WHERE 2 * shared >= n),
r0 AS (SELECT *, coalesce(j - lag(j) OVER (PARTITION BY doc_id, name ORDER BY j) > {GAP + 1}, TRUE) AS new FROM sp),
r1 AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, name ORDER BY j) AS run FROM r0),
u AS (SELECT doc_id, name, min(j) AS a, max(j) AS b FROM r1 GROUP BY doc_id, name, run
      UNION SELECT d.doc_id, c.name, d.a, d.b FROM c JOIN (
        SELECT doc_id, min(j) AS a, max(j) AS b FROM l1 GROUP BY doc_id UNION SELECT doc_id, min(j), max(j) FROM l1 GROUP BY doc_id, i - j UNION SELECT doc_id, j, j FROM l1) d USING (doc_id)),
f AS (SELECT u.doc_id, u.name, t.grams, flatten(list_slice(ls.lines, u.a, u.b)) AS words FROM u JOIN c USING (doc_id, name) JOIN ls USING (doc_id) JOIN t USING (name)),
b AS (SELECT doc_id, name, grams, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS own
      FROM f WHERE greatest(len(words) - 1, 1) >= len(grams) * {dice} / (2 - {dice}) - 1e-9),
d AS (SELECT doc_id, name, max(2.0 * len(list_intersect(own, grams))::DOUBLE / (len(own) + len(grams))) AS d FROM b GROUP BY doc_id, name),
a AS (SELECT doc_id, count(*) AS n_licences, string_agg(name, ',' ORDER BY name) AS licences, arg_min(name, (-d, name)) AS best, max(d) AS best_dice FROM d WHERE d >= {dice} GROUP BY doc_id)
SELECT doc_id, coalesce(n_licences, 0) AS n_licences, coalesce(licences, '') AS licences, best, best_dice FROM documents LEFT JOIN a USING (doc_id)
"""


SQL = sql(all_templates())
