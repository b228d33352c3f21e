"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams, DataFrame functions only.

A text is compared as a whole, by paragraphs (parted by blank lines), by lines, and by passages: windows over the words of the
whole text, which find licences of several paragraphs and notices inside a line of prose. With the Dice threshold ``t`` a template of
``b`` bigrams can only match a unit of ``t / (2 - t) * b`` to ``(2 - t) / t * b`` bigrams, so units are pruned by their word
count before bigrams are made, and again for each template. Any match holds ``t / (2 - t) * b`` of the template's bigrams, so
texts with fewer of them are pruned first; in the others, windows start where a bigram of the template is followed by enough
more of them, have lengths in steps over the template's range, and end at such a bigram. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and the usual notices that name a licence.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", MIT_TEXT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", ISC_TEXT),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", BSD_TEXT),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", GPL_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

PERCENT, STEPS = 80, 6


def bigrams(text: str) -> set[str]:
    """The distinct word bigrams of a normalised text, in plain Python."""
    words = re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a bound variable, so that ``value`` is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(unit: Column) -> Column:
    # the two letters beyond A-Z whose lower case holds one of a-z part words, as all others do
    parted = F.replace(F.replace(unit, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))
    return F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda w: w != "")


def _units(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the whole text, each once."""
    lines = F.split(text, "\\r?\\n")
    paragraphs = F.filter(F.split(text, "\\r?\\n[ \\t]*\\r?\\n\\s*"), lambda p: F.instr(p, "\n") > 0)
    return F.array_distinct(F.when(F.instr(text, "\n") > 0, F.concat(lines, paragraphs, F.array(text))).otherwise(F.array(text)))


def _passage(b: Column, template: list[str], length: int, low: int, high: int) -> Column:
    """The best coefficient of a window of the bigrams ``b``, null without a window that could match."""
    lengths = sorted({length, *(low + (high - low) * j // STEPS for j in range(STEPS + 1))})

    def dice(at: Column, k: Column, most: int) -> Column:
        first = F.get(at, k)
        last = F.array_max(F.filter(F.slice(at, k + 1, most), lambda i: i < first + most))
        window = F.array_distinct(F.slice(b, first + 1, last - first + 1))
        return let(window, lambda a: F.lit(2) * F.size(F.array_intersect(a, F.array(*[F.lit(x) for x in template]))) / (F.size(a) + len(template)))

    def best(at: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - low), lambda k: F.get(at, k + (low - 1)) - F.get(at, k) < lengths[-1])
        return F.when(F.size(at) >= low, F.array_max(F.flatten(F.transform(starts, lambda k: F.array(*[dice(at, k, n) for n in lengths])))))

    return let(F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.get(b, i).isin(template)), best)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """Rows ``doc_id, licence, units, best_dice``: how many units of the document match the licence, and the best coefficient.

    A unit matches a template when 100 * 2 * |A & B| >= percent * (|A| + |B|) over their sets of word bigrams; normalised: only
    runs of a-z and 0-9 count, A-Z lower-cased. Equal units of one text count once. Null or empty texts and units below two words
    match nothing. A licence found only in a passage counts as one unit. Null and repeated ids: each row is scanned for itself. Empty table: no rows.
    """
    known = [(name, sorted(bigrams(t))) for name, t in (templates or TEMPLATES)]
    bounds = [(-(-percent * len(b) // (200 - percent)), (200 - percent) * len(b) // percent) for _, b in known]
    low, high = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    # Without repeats a unit has a bigram less than words; repeats only make the set smaller, so the lower bound holds for words too.
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.array(*[F.lit(x) for x in sorted({x for _, b in known for x in b})])
    lengths = [max(len(re.findall("[a-z0-9]+", t.lower())) - 1, 1) for _, t in (templates or TEMPLATES)]

    def held(w: Column) -> Column:
        """All bigrams in order, and which templates enough of them are in."""
        more = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
        enough = lambda c: F.array(*[F.size(F.array_intersect(c, F.array(*[F.lit(x) for x in b]))) >= lo for (_, b), (lo, _) in zip(known, bounds, strict=True)])
        both = lambda b: F.struct(b.alias("b"), let(F.array_intersect(b, every), lambda c: F.when(F.size(c) >= low, enough(c))).alias("near"))
        return F.when(F.size(w) > low, let(more, both))

    near = docs.select("doc_id", text.alias("text"), F.explode(F.filter(F.transform(F.array(_words(text)), held), lambda s: F.exists(s["near"], lambda x: x))).alias("s"))
    passages = [
        F.struct(F.lit(name).alias("licence"), F.when(F.get("s.near", F.lit(i)), _passage(F.col("s.b"), b, n, lo, max(lo, n * (200 - percent) // percent))).alias("dice"))
        for i, ((name, b), (lo, _), n) in enumerate(zip(known, bounds, lengths, strict=True))
    ]
    # one row for the passages, with a null unit, and one for each unit
    unit = near.select("doc_id", F.when(F.size("s.near") > 0, F.array(*passages)).alias("passages"), "text").select("doc_id", "passages", F.explode(F.concat(F.array(F.lit(None).cast("string")), _units(F.col("text")))).alias("unit"))
    unit = unit.where(F.col("unit").isNull() | (F.char_length("unit") >= 2 * low))

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) > low, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))

    # a bound variable, so that the words are split once
    sets = unit.select("doc_id", "passages", F.col("unit").isNull().alias("inside"), F.explode(F.filter(F.transform(F.array(_words(F.coalesce("unit", F.lit("")))), pairs), lambda a: F.col("unit").isNull() | F.size(a).between(low, high))).alias("a"))
    hits = []
    for (name, b), (lo, hi) in zip(known, bounds, strict=True):
        both = F.size(F.array_intersect("a", F.array(*[F.lit(x) for x in b])))
        dice = F.when(F.size("a").between(lo, hi), 2 * both / (F.size("a") + len(b)))
        hits.append(F.struct(F.lit(name).alias("licence"), dice.alias("dice")))
    matched = sets.select("doc_id", "inside", F.explode(F.filter(F.when(F.col("inside"), F.col("passages")).otherwise(F.array(*hits)), lambda h: h["dice"] * 100 >= percent)).alias("h"))
    best = matched.groupBy("doc_id", "h.licence").agg(F.greatest(F.count_if(~F.col("inside")), F.lit(1)).cast("long").alias("units"), F.max("h.dice").alias("best_dice"))
    return best.select("doc_id", "licence", "units", "best_dice")
