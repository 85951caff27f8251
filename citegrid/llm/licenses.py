"""Licence scans: notices compared with licence templates by the Dice coefficient over word bigrams.

Text is normalised by turning every run of other characters than A-Z, a-z and 0-9 into one space and lower-casing the
rest. The units of a text are its lines, its sentences (up to . : ; ! or ? before white space, wherever the lines
end), its paragraphs (between lines without a letter or digit) and the whole; equal units count once. So a notice
is found on a line of its own, inside prose, wrapped over several lines of a comment, or as a file of its own; one that is
none of these, such as half a sentence of a long line, is not. A unit's set holds its distinct pairs of
neighbouring words. Since Dice(A, B) >= t needs |B| between t/(2-t) |A| and (2-t)/t |A|, templates outside those
bounds are never compared, and units outside the bounds of all templates get no bigrams at all; texts without any of
the words that a notice must have are not cut into units. Of several notices
that reach the threshold the one with most bigrams in common with its template is reported, then the one with the
highest coefficient.

Everything is one projection of DataFrame functions; no shuffle and no Python on the executors.

Defined results: a null or empty text has no notices (license null, dice null, n_notices 0); ties between
templates go to the smaller name; each row of the input gives one row, repeated rows included; very long texts are
units like others, which the bounds drop; an empty table gives no rows; columns other than the two named ones are
ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words that most texts have; they tell notices apart only where a template's other words don't do.
EVERYDAY = frozenset("a an and any are as at be by for from has in is it not of on or that the this to was which with you".split())

# Common notices, file headers, clauses and whole texts of public licences.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:"""
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_WARRANTY = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free
Software Foundation, either version {} of the License, or (at your option) any later version."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEMPLATES = [
    ("agpl-3.0", GPL_HEADER.format("Affero General Public License", 3)),
    ("apache-2.0", APACHE_HEADER),
    ("apache-2.0", APACHE_WARRANTY),
    ("bsd-2-clause", " ".join([BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_WARRANTY])),
    ("bsd-3-clause", " ".join([BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_NAME, BSD_WARRANTY])),
    ("bsd-3-clause", BSD_NAME),
    ("gpl-2.0", GPL_HEADER.format("General Public License", 2)),
    ("gpl-3.0", GPL_HEADER.format("General Public License", 3)),
    ("isc", ISC_GRANT),
    ("isc", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("lgpl-2.1", GPL_HEADER.format("Lesser General Public License", 2.1).replace("program", "library")),
    ("lgpl-3.0", GPL_HEADER.format("Lesser General Public License", 3).replace("program", "library")),
    ("mit", MIT_GRANT),
    ("mit", MIT_WARRANTY),
    ("mit", f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("mpl-2.0", MPL_HEADER),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def normal_words(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text)
    return kept.lower().split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and the largest size of a set that can reach the threshold with one of ``size``; wide by one."""
    return int(threshold / (2 - threshold) * size), int((2 - threshold) / threshold * size) + 1


def telling_words(sets: list[tuple[str, tuple[str, ...]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one.

    Of a template's t bigrams such a unit has at least threshold (s + t) / 2, s being the smallest set within the bounds; so
    it has one of any t - that + 1 of them. The template's longest words, which are rare in other texts, are taken, everyday words last,
    until that many of its bigrams hold one.
    """
    found: set[str] = set()
    for _, grams in sets:
        t = len(grams)
        common = threshold * (max(1, size_bounds(t, threshold)[0]) + t) / 2
        missing = t - ceil(common - 1e-9)  # what may be missing at most
        mine: set[str] = set()
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in EVERYDAY, -len(w), w)):
            if sum(any(w in mine for w in g.split()) for g in grams) >= min(t, missing + 1):
                break
            mine.add(word)
        found |= mine
    return sorted(found)


def _units(text: Column) -> Column:
    """The different lines, sentences and paragraphs, and the whole, normalised: words with one space between them."""
    lines = F.split(text, "\n")
    sentences = F.split(text, r"[.:;!?]+[\x20\x09-\x0D]+")
    paragraphs = F.split(text, r"\n[^A-Za-z0-9\n]*\n")
    units = F.concat(lines, sentences, paragraphs, F.array(text))
    return F.array_distinct(F.transform(units, lambda u: F.trim(F.lower(F.regexp_replace(u, "[^A-Za-z0-9]+", " ")))))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan(df: DataFrame, doc: str, text: str, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, license, dice, n_notices): the best template of a text's units, and how many different units reach the threshold."""
    sets = sorted({(name, tuple(bigrams(normal_words(body)))) for name, body in templates or TEMPLATES})
    bounds = [size_bounds(len(grams), threshold) for _, grams in sets]
    least, most = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.split(F.lit("|".join(g)), "[|]").alias("grams"))
            for (name, g), (lo, hi) in zip(sets, bounds, strict=True)
        ]
    )

    def best(grams: Column) -> Column:
        near = F.filter(known, lambda t: F.size(grams).between(t["lo"], t["hi"]))
        common = F.transform(near, lambda t: F.struct((-F.size(F.array_intersect(grams, t["grams"]))).alias("fewer"), t["n"].alias("n"), t["name"].alias("name")))
        scored = F.transform(common, lambda c: F.struct(c["fewer"], (c["fewer"] * F.lit(2.0) / (F.size(grams) + c["n"])).alias("less"), c["name"]))
        return F.array_min(F.filter(scored, lambda s: s["less"] <= -threshold))

    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.lower(F.regexp_replace(whole, "[^A-Za-z0-9]+", " ")), " ")
    telling = F.split(F.lit("|".join(telling_words(sets, threshold))), "[|]")
    rows = df.select(F.col(doc), F.when(F.arrays_overlap(words, telling), _units(whole)).otherwise(F.array().cast("array<string>")).alias("_units"))
    # A unit of k words takes 2 k - 1 characters at least; one of fewer words than bigrams can't be.
    rows = rows.select(doc, F.filter("_units", lambda u: F.length(u) > 2 * max(1, least)).alias("_units"))
    rows = rows.select(doc, F.transform("_units", lambda u: F.split(u, " ")).alias("_words"))
    # More distinct words than bigrams plus one can't be either: most units fall to these bounds.
    rows = rows.select(doc, F.filter("_words", lambda w: (F.size(w) > max(1, least)) & (F.size(F.array_distinct(w)) <= most + 1)).alias("_words"))
    rows = rows.select(doc, F.filter(F.transform("_words", _bigrams), lambda g: F.size(g).between(max(1, least), most)).alias("_grams"))
    rows = rows.select(doc, F.filter(F.transform("_grams", best), lambda s: s.isNotNull()).alias("_found"))
    top = F.array_min("_found")
    return rows.select(doc, top["name"].alias("license"), (-top["less"]).alias("dice"), F.size("_found").cast("long").alias("n_notices"))
