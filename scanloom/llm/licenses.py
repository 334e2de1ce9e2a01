"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Every sentence of a whole text, cut at line ends and again with lines joined,
becomes a sparse vector of word counts times inverse template frequency (words
that no template has weigh as the rarest) and is compared with the notices
below. So do every comment (its lines joined, its marks dropped) and every whole
text; these are compared with headers and texts of licences too. Cosines of
``threshold`` or more are finds, and a file's own licence is its best find, by
headers and texts if there are any, else by notices. A
file is a licence file if its name says so or finds make up half of its words;
it licenses its directory. Files without a find inherit from their nearest
ancestor directory that is licensed, by joins on directory paths. All steps are
DataFrame functions.

Most text never meets a template, and none is lost by that. The squared weights
of a template's words that stand in a text sum to the square of their cosine or
more. And a text's products with all templates at once, over the least length
that its number of words and of distinct words allow, are every cosine or more.
Both bounds, then the cosines themselves (but for words that share a slot), are
taken within each row; what stays below the threshold goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from importlib.resources import files as resources
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import bitmap, in_bitmap, written

#: Licence names and the sentences of their usual notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_GNU = "{0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {4}"
_TO_2 = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_TO_3 = ". If not, see <https://www.gnu.org/licenses/>."
_BSD = "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Licence names and whole headers, and the licences that are short enough to stand in headers.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *((name, _GNU.format(f"This {what}", kind, version, mark, what) + to) for name, what, kind, version, mark in (
        ("GPL-2.0", "program", "General Public License", "2", ";"), ("GPL-3.0", "program", "General Public License", "3", ":"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1", ";"), ("LGPL-3.0", "library", "Lesser General Public License", "3", ":"),
        ("AGPL-3.0", "program", "Affero General Public License", "3", ":"),
    ) for to in (_TO_2, _TO_3)),
    ("ISC", 'Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Licences whose whole texts lie in ``license_texts``.
TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

WORDS = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Ends of sentences in a text's lines, and in its paragraphs (lines joined).
SENTENCE_END = r"\n|(?<=[.!?;])\s+"
PARAGRAPH_END = r"(?<=[.!?])\s+|\n[ \t\r]*\n\s*"
#: What a comment line begins with, and how comments of several lines open and close (as regex) and close (as it stands).
LINE_MARK = r"(?dm)^[ \t]*+(?:#++!?|//++[/!]*+|/\*++|\*++/?|--++|;++|%++|<!--++|(?i:rem|dnl)\b)"
LONG_COMMENTS = ((r"/\*", "*/"), ("<!--", "-->"), ('"{3}', None), ("'{3}", None))
#: Templates that share a bound, where all have ``MANY`` words or more.
TOGETHER = 4
MANY = 512
#: Tasks that the copies of one text are dealt to.
SALTS = 32
FILE_NAME = r"(?i)^(?:un)?licen[cs]e|^copying|^copyright|^notice"


@dataclass(frozen=True)
class LicenseParams:
    """``threshold``: least cosine of a find; ``file_share``: share of words that makes a licence file."""

    threshold: float = 0.7
    file_share: float = 0.5


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def whole_templates() -> tuple[tuple[str, str], ...]:
    """Licence names and what comments and whole texts are compared with: notices, headers and texts.

    The text of AGPL-3.0 is that of GPL-3.0 under the other name.
    """
    texts = {name: (resources("scanloom.llm") / "license_texts" / f"{name}.txt").read_text("utf-8") for name in TEXTS}
    affero = texts["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    return (*NOTICES, *HEADERS, *texts.items(), ("AGPL-3.0", affero))


def vectors(named: tuple[tuple[str, str], ...]) -> list[tuple[int, str, str, float, float]]:
    """notice, license, term, weight (unit length) and idf of each term of each template."""
    counts = [Counter(re.findall(WORDS, text.lower())) for _, text in named]
    held = Counter(term for c in counts for term in c)
    idf = {term: log((1.0 + len(named)) / (1 + n)) + 1 for term, n in held.items()}
    norms = [sqrt(sum((n * idf[term]) ** 2 for term, n in c.items())) for c in counts]
    return [(k, named[k][0], term, n * idf[term] / norms[k], idf[term]) for k, c in enumerate(counts) for term, n in sorted(c.items())]


def templates(spark: SparkSession, named: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``vectors`` as a table, which is small whatever the files."""
    return spark.createDataFrame(vectors(named), "notice int, license string, term string, weight double, idf double")


def bounds(spark: SparkSession, named: tuple[tuple[str, str], ...], params: LicenseParams) -> Callable[..., DataFrame]:
    """A filter of rows by their column ``text``: those that hold enough of a template to be close to it, or to have a part that is (``parts``, a condition).

    Words that share a slot count as the heavier of them, and as the more
    frequent one in lengths; so do ``TOGETHER`` neighbouring templates (of
    many words), which are much alike. No bound is too low by that, and the tables stay small.
    """
    weights = vectors(named)
    words = sorted({term for _, _, term, _, _ in weights})
    together = 1 if len(words) < MANY else TOGETHER
    n, size = -(-len(named) // together), 1 << (2 * len(words)).bit_length()
    rarest = log(1.0 + len(named)) + 1
    vocabulary = spark.createDataFrame([(t,) for t in words], "word string")
    slot = {r.word: r.slot for r in vocabulary.select("word", F.expr(f"hash(word) & {size - 1}").alias("slot")).collect()}  # words of the templates
    squares, products, idfs = [0.0] * (size * n), [0.0] * (size * n), [rarest] * size
    for k, _, term, weight, idf in weights:
        s = slot[term]
        at = s * n + k // together
        squares[at] = max(squares[at], weight * weight)
        products[at] = max(products[at], weight * idf)
        idfs[s] = min(idfs[s], idf)

    def listed(numbers: list[float]) -> Column:
        return F.split(F.lit(",".join(f"{x:.6g}" for x in numbers)), ",").cast("array<float>")

    given = {"__known": bitmap(vocabulary), "__squares": listed(squares), "__products": listed(products), "__idfs": listed(idfs), "__most": listed([max(products[s * n : (s + 1) * n]) for s in range(size)])}

    def named_once(name: str, value: str, condition: str) -> str:
        return f"exists(array({value}), {name} -> {condition})"  # the optimizer would compute a column for each of its uses

    def slots(terms: str) -> str:
        return f"transform(filter({terms}, t -> {in_bitmap('t', '__known')}), t -> hash(t) & {size - 1})"

    def sums(slots: str, start: str, table: str) -> str:
        return f"aggregate({slots}, array_repeat(cast({start} as float), {n}), (sums, s) -> transform(sums, (x, k) -> cast(x + get({table}, s * {n} + k) as float)))"

    covered = f"exists({sums(slots('array_distinct(terms)'), '0', '__squares')}, x -> x >= {params.threshold ** 2 - 1e-3})"
    least = f"{params.threshold - 1e-3} * aggregate(slots, cast({rarest} * size(terms) as double), (sum, s) -> sum + get(__idfs, s) - {rarest}) / sqrt(size(array_distinct(terms)))"
    any_near = f"aggregate(slots, cast(0 as double), (sum, s) -> sum + get(__most, s)) >= {least}"  # for all templates at once, by the least length
    # The length itself, by runs of equal words in sorted order; the last run ends at a null.
    squared = "r.sum + pow(r.n * r.idf, 2)"
    idf = f"if({in_bitmap('t', '__known')}, cast(get(__idfs, hash(t) & {size - 1}) as double), cast({rarest} as double))"
    runs = "aggregate(sort_array(transform(terms, t -> struct(xxhash64(t) as h, " + idf + " as idf))), struct(cast(null as bigint) as h, 0 as n, cast(0 as double) as idf, cast(0 as double) as sum), (r, w) -> if(r.h = w.h, struct(r.h as h, r.n + 1 as n, r.idf as idf, r.sum as sum), struct(w.h as h, 1 as n, w.idf as idf, " + squared + " as sum)), r -> sqrt(" + squared + "))"
    near = named_once("slots", slots("terms"), f"{any_near} and " + named_once("length", f"{params.threshold - 1e-3} * {runs}", f"exists({sums('slots', '-length', '__products')}, x -> x >= 0)"))
    enough = named_once("terms", f"regexp_extract_all(lower(text), r'{WORDS}', 0)", f"size(terms) > 0 and (__parts or {near}) and {covered}")

    def close(rows: DataFrame, parts: Column) -> DataFrame:
        return rows.withColumns(given | {"__parts": parts}).where(enough).drop(*given, "__parts")

    return close


def lines_and_paragraphs(files: DataFrame) -> DataFrame:
    """row, kind (0 by lines, 1 by paragraphs), sentence (its place) and text of each sentence."""
    joined = F.regexp_replace("text", LINE_MARK, " ")
    by_line = files.select("row", F.lit(0).alias("kind"), F.posexplode(F.split("text", SENTENCE_END, -1)).alias("sentence", "text"))
    return by_line.unionByName(files.select("row", F.lit(1).alias("kind"), F.posexplode(F.split(joined, PARAGRAPH_END, -1)).alias("sentence", "text")))


def comments(files: DataFrame) -> DataFrame:
    """row, kind (2), sentence (its place) and text of each comment and whole text."""
    return files.select("row", F.lit(2).alias("kind"), F.posexplode(blocks(F.col("text"))).alias("sentence", "text"))


def blocks(text: Column) -> Column:
    """A whole text and its comments, those of several lines and runs of comment lines, without marks; equal ones once."""
    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, LINE_MARK, " "), "\\x01", " ")

    # Each piece is a line that is no comment, and the comment lines after it.
    pieces = F.split(F.regexp_replace(F.regexp_replace(text, "\\x01", " "), LINE_MARK, "\x01"), r"\n(?!\x01)", -1)
    runs = F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^[^\x01\n][^\n]*+", "")), lambda x: F.contains(x, F.lit("\x01")))

    def opened(opens: str, closes: str | None) -> Column:
        parts = F.split(text, opens, -1)
        parts = F.slice(parts, 2, F.size(parts))
        return F.transform(parts, lambda x: F.substring_index(x, closes, 1)) if closes else parts

    long = [opened(*ends) for ends in LONG_COMMENTS]
    return F.array_distinct(F.transform(F.concat(F.array(text), runs, *long), bare))


def finds(items: DataFrame, named: tuple[tuple[str, str], ...], params: LicenseParams) -> DataFrame:
    """row, kind, sentence, license, score, words, short (not by a header or a text): the best of the templates ``named`` for each item that is close to any."""
    table = templates(items.sparkSession, named)
    terms = bounds(items.sparkSession, named, params)(items, F.lit(False)).withColumn("terms", _terms(F.col("text")))
    item = ["row", "kind", "sentence"]
    counts = terms.select(*item, F.size("terms").alias("words"), F.explode("terms").alias("term")).groupBy(*item, "words", "term").agg(F.count("*").alias("tf"))
    counts = written(counts, "licenses-terms")
    rarest = log((1.0 + len(named)) / 1.0) + 1
    idf = table.select("term", "idf").distinct()
    weighed = counts.join(F.broadcast(idf), "term", "left").withColumn("raw", F.col("tf") * F.coalesce("idf", F.lit(rarest)))  # words of the templates
    norms = weighed.groupBy(*item).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    products = weighed.join(F.broadcast(table.select("notice", "license", "term", "weight")), "term").groupBy(*item, "words", "notice", "license").agg(F.sum(F.col("raw") * F.col("weight")).alias("product"))
    scored = products.join(norms, item).withColumn("score", F.round(F.col("product") / F.col("norm"), 6)).where(F.col("score") >= params.threshold)
    best = scored.groupBy(*item, "words").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("license").alias("license"), F.col("notice").alias("notice"))).alias("b"))
    return best.select(*item, F.col("b.license").alias("license"), (-F.col("b.neg")).alias("score"), "words", (F.col("b.notice") < len(NOTICES)).alias("short"))


def parents(directory: Column) -> Column:
    """A directory and its ancestors, the deepest first, to the root ("")."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def license_scan(files: DataFrame, path: Column, params: LicenseParams = LicenseParams(), key: str = "doc_id") -> DataFrame:
    """Per file: its key, path, license, score, origin and licensed_by.

    origin is ``header`` (a find of its own), ``file`` (it is a licence file),
    ``inherited`` (from the directory licensed_by) or ``none`` (license and
    score null). Among finds of equal score the name that sorts first counts; of
    a directory's licence files likewise the best score, then the name. A null
    path is a file of the root without a name, a null text has no find.
    Repeated rows each give a row; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = files.select(F.col(key).alias("key"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    # Finds depend on the text alone, so copies share theirs.
    listed = named.withColumn("row", F.md5("text")).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    everything = whole_templates()  # the notices are the first of them
    commented = F.col("text").rlike(LINE_MARK)
    for opens, _ in LONG_COMMENTS:
        commented = commented | F.col("text").rlike(opens)
    texts = []
    for few, parts in ((NOTICES, F.lit(True)), (everything, commented)):
        may = bounds(files.sparkSession, few, params)(listed.select("row", "text"), parts)
        texts.append(written(may.withColumn("all_words", F.size(_terms(F.col("text")))), "licenses-texts"))
    # Repeated rows multiply the counts of their sentences: a sentence has one direction, so its cosine stays.
    found = written(finds(lines_and_paragraphs(texts[0]), NOTICES, params).unionByName(finds(comments(texts[1]), everything, params)), "licenses-finds")
    # A header or text that is found counts before the sentences in it, such as "All rights reserved."
    words = [F.coalesce(how(F.when(F.col("kind") == k, F.col("words"))), F.lit(0)) for k, how in enumerate((F.sum, F.sum, F.max))]
    per_row = found.groupBy("row").agg(F.min(F.struct("short", (-F.col("score")).alias("neg"), F.col("license").alias("license"))).alias("b"), F.greatest(*words).alias("found_words"))
    own = per_row.join(texts[0].union(texts[1]).select("row", "all_words").distinct(), "row").select(F.col("row").alias("of"), F.col("b.license").alias("own"), (-F.col("b.neg")).alias("own_score"), "found_words", "all_words")
    name = F.regexp_extract("path", "[^/]*$", 0)
    # One text may be that of a third of the files: its finds are dealt to as many tasks as there are salts.
    own = own.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = listed.select("key", "path", "dir", "row", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    scanned = salted.join(own, (F.col("row") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left").withColumn("is_file", F.col("own").isNotNull() & (name.rlike(FILE_NAME) | (F.col("found_words") >= params.file_share * F.col("all_words"))))
    scanned = written(scanned.select("key", "path", "dir", "own", "own_score", "is_file"), "licenses-own")
    licensed = scanned.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("neg"), F.col("own").alias("license"))).alias("b")).select(F.col("dir").alias("licensed_by"), F.col("b.license").alias("given"), (-F.col("b.neg")).alias("given_score"))
    above = scanned.select("dir").distinct().select("dir", F.posexplode(parents(F.col("dir"))).alias("up", "licensed_by"))
    nearest = above.join(licensed, "licensed_by").groupBy("dir").agg(F.min(F.struct("up", "licensed_by", "given", "given_score")).alias("n"))
    nearest = written(nearest.select(F.col("dir").alias("of_dir"), "n.licensed_by", "n.given", "n.given_score"), "licenses-dirs")
    joined = scanned.join(nearest, F.col("dir") == F.col("of_dir"), "left")
    has = F.col("own").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(has, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select(F.col("key").alias(key), "path", F.coalesce("own", "given").alias("license"), F.when(has, F.col("own_score")).otherwise(F.col("given_score")).alias("score"), origin.alias("origin"), F.when(~has, F.col("licensed_by")).alias("licensed_by"))
