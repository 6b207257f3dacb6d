"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

DataFrame and SQL functions only.  A unit is a whole file, a block of lines between blank ones, or a line,
each without comment marks; it is compared with every template through their shared terms.  A file has the
licence of its best unit.  A file that as a whole is close to a template, or that is named as licence files
are and has a unit that is, is a licence file and speaks for its directory; files without a licence of their
own take that of the nearest ancestor directory that has one.  Directories are resolved once each, before
files join them, so a directory with a large part of all files costs one row.

A unit can only reach the least cosine with a template if it holds a cue of it: the terms beyond a template's
cues weigh too little together.  Cues are the terms that the texts themselves, counted first, have least
often; texts without any cue are left after the second scan.  Which terms are cues never changes a result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, named

# Licence names, and notices and texts as they stand in headers and licence files.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
)
_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free "
    "Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {} Public License for more details. You should have received a copy of the GNU {} Public License along with this program."
)
_GNU_TITLE = (
    "GNU {} PUBLIC LICENSE Version {} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of "
    "this license document, but changing it is not allowed."
)
_GNU_KINDS = (("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"))
TEXTS = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("BSD-2-Clause", _BSD_2 + _NO_WARRANTY),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _NO_WARRANTY),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License."
    )),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at http://mozilla.org/MPL/2.0/."
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )),
)

#: (licence, text) of all templates.
TEMPLATES = (
    *NOTICES,
    *((x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS),
    *TEXTS,
    *((x, _GNU.format(kind, version, kind, kind)) for x, kind, version in _GNU_KINDS),
    *((x, _GNU_TITLE.format(kind, version)) for x, kind, version in _GNU_KINDS),
)
LEAST_COSINE = 0.6
#: Templates at most; they, their terms and cues are broadcast.
MOST_TEMPLATES = 10_000
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
YEAR = "^(?:19|20)[0-9][0-9]$"
MARKS = "(?m)^[ \\t]*(?://+|/\\*+|\\*+/|\\*+|#+|--+|;+|<!--+|%+)[ \\t]*"
BLANK_LINES = "\\n(?:[ \\t\\r]*\\n)+"
LICENCE_FILE = "(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|copyright|notice)[^/]*$"


def templates_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "licence string, text string")


def _terms(text: Column) -> Column:
    """The terms of a text, years left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.rlike(YEAR))


def _weights(templates: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(term, idf), (template, licence, term, weight by length) and the idf of an unknown term."""
    own = templates.select(F.xxhash64("licence", "text").alias("template"), "licence", F.explode(_terms(F.col("text"))).alias("term"))
    tf = own.groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    n = templates.select("licence", "text").distinct().count()
    if n > MOST_TEMPLATES:
        raise ValueError(f"{n} templates; at most {MOST_TEMPLATES} are broadcast")
    idf = tf.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").withColumn("w", (F.log(F.col("tf")) + 1.0) * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(F.broadcast(norm), "template").select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("w"))
    return idf, w, log(1.0 + n) + 1.0


def cues(weights: DataFrame, seen: dict[str, int], least_cosine: float) -> list[str]:
    """Terms of which any unit near a template has one: without them the squares of the template's weights add
    up to less than the square of the least cosine.  Of each template the terms that are ``seen`` least often
    for their weight."""
    by: dict[int, list] = {}
    for r in weights.collect():
        by.setdefault(r.template, []).append((seen.get(r.term, 0) / r.w**2, r.term, r.w))
    out = set()
    for terms in by.values():
        left = sum(w * w for *_, w in terms)
        for _, term, w in sorted(terms):
            if left < 0.999 * least_cosine**2:
                break
            out.add(term)
            left -= w * w
    return sorted(out)


def directory(path: str) -> Column:
    """The directory of a path: all up to its last slash, "" without one."""
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def licence_scan(
    files: DataFrame,
    templates: DataFrame | None = None,
    path_col: str = "path",
    text_col: str = "text",
    id_col: str = "doc_id",
    least_cosine: float = LEAST_COSINE,
) -> DataFrame:
    """One row per input row: doc_id, path, licence, cosine (6 digits), how and declared_in.

    how: ``file`` (a licence file), ``header`` (a block or line is near a template), ``inherited`` (the licence
    of the nearest ancestor directory with a licence file, whose path is declared_in), or null where no licence
    is found.  A whole file goes before its parts, then the larger cosine; of equal cosines the first licence
    by name wins, of licence files of a directory that with the largest cosine, then the first path.  Null and
    empty texts have no units but inherit; a null path has the directory "".  Rows that repeat an id and path
    are one file: their units count together.  Texts are scanned whole, of any length; an empty table gives no
    rows; other columns, whatever their names, are not looked at.
    """
    spark = files.sparkSession
    idf, weight, unknown = _weights(templates_frame(spark) if templates is None else templates)
    idf, weight = cut(idf), cut(weight)
    rows = files.select(named(files, id_col).alias("doc_id"), F.coalesce(named(files, path_col), F.lit("")).alias("path"), named(files, text_col).alias("text"))
    file = F.xxhash64("doc_id", "path").alias("file")
    seen = rows.select(F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(idf), "term").groupBy("term").count()
    cue = F.array(*map(F.lit, cues(weight, {r["term"]: r["count"] for r in seen.collect()}, least_cosine))).cast("array<string>")
    noted = cut(rows.filter(F.arrays_overlap(_terms(F.col("text")), cue)).select(file, F.regexp_replace("text", MARKS, "").alias("text")))
    # blocks that are the whole text, and lines that are the blocks, would only repeat them
    blocks, lines = F.split("text", BLANK_LINES), F.split("text", "\n")
    none = F.array().cast("array<string>")
    parts = F.array(F.array("text"), F.when(F.size(blocks) > 1, blocks).otherwise(none), F.when(F.size(lines) > F.size(blocks), lines).otherwise(none))
    units = noted.select("file", F.posexplode(parts).alias("kind", "of")).select("file", "kind", F.posexplode("of").alias("unit", "text"))
    units = units.select("file", "kind", "unit", _terms(F.col("text")).alias("terms")).filter(F.arrays_overlap("terms", cue))
    tf = units.select("file", "kind", "unit", F.explode("terms").alias("term"))
    tf = tf.groupBy("file", "kind", "unit", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term", "left")
    tf = cut(tf.withColumn("u", (F.log(F.col("tf")) + 1.0) * F.coalesce("idf", F.lit(unknown))))
    drop(noted)
    key = ["file", "kind", "unit"]
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dot = tf.filter("idf is not null").join(F.broadcast(weight), "term").groupBy(*key, "template", "licence")
    dot = dot.agg(F.sum(F.col("u") * F.col("w")).alias("dot")).join(norm, key)
    near = dot.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= least_cosine)
    best = near.groupBy("file").agg(F.min(F.struct((F.col("kind") > 0).alias("part"), (-F.col("cosine")).alias("minus"), "licence")).alias("best"))
    best = cut(best.select("file", F.col("best.licence").alias("own"), (-F.col("best.minus")).alias("cosine"), (~F.col("best.part")).alias("whole")))
    known = rows.select("doc_id", "path", directory("path").alias("dir"), file).join(best, "file", "left")
    known = known.withColumn("speaks", F.col("own").isNotNull() & (F.col("whole") | F.col("path").rlike(LICENCE_FILE)))
    speaking = known.filter("speaks").groupBy(F.col("dir").alias("up")).agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "path", "own")).alias("says")
    ).select("up", F.col("says.own").alias("dir_licence"), F.col("says.path").alias("declared_in"))
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(steps, 1, k), "/")))
    dirs = rows.select(directory("path").alias("dir")).distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("up")).join(speaking, "up")
    dirs = dirs.groupBy("dir").agg(F.max(F.struct(F.length("up"), "dir_licence", "declared_in")).alias("near"))
    dirs = dirs.select("dir", "near.dir_licence", "near.declared_in")
    out = known.join(dirs, "dir", "left")
    how = F.when(F.col("own").isNotNull(), F.when(F.col("speaks"), "file").otherwise("header")).when(F.col("dir_licence").isNotNull(), "inherited")
    return out.select(
        "doc_id", "path", F.coalesce("own", "dir_licence").alias("licence"), "cosine", how.alias("how"),
        F.when(F.col("own").isNull(), F.col("declared_in")).alias("declared_in"),
    )
