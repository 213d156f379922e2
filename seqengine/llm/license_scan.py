"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Native Spark throughout. What is compared of a text that speaks of a licence: its blocks
(between empty lines, the lines of each joined, so a comment header is one block), the
sentences of its lines and of its blocks, and of a licence file (LICENSE, COPYING, NOTICE)
the whole. Comment marks are no words. Equal ones are scored once. Words are weighted by
tf * idf, with document frequencies over all that is compared in the corpus and over the
templates; the template (a whole licence text, its opening, a customary header or notice)
of the greatest cosine names the licence if it reaches the threshold. A licence file gives
its licence to its directory; a file without a licence of its own takes that of its nearest
ancestor directory, by joins on paths.

Rows and edge cases: null and empty texts have no licence of their own; a null path has no
directory and inherits nothing; equal scores go to the first licence name; several
licence files of a directory: the greatest cosine, then the first name; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

# Customary licence texts, openings, headers and notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_REST = (
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    " See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu_header(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
        f" You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


_GNU = [
    ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    ("GPL-2.0", "General Public License", "2", "June 1991"),
    ("GPL-3.0", "General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
]
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 Creative Commons Attribution ShareAlike"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", _ISC),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST + _AS_IS),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", _MPL + ". If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", _UNLICENSE),
    *((name, _gnu_header(title, version)) for name, title, version, _ in _GNU),
    *((name, f"GNU {title.upper()} Version {version}, {date} Copyright (C) Free Software Foundation, Inc. {_VERBATIM}") for name, title, version, date in _GNU),
]
#: What is compared has one of these; so have all templates.
SPEAKS = "licen[sc]|copyright|permission|redistribut|public domain|warrant|unencumbered"
_LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|notice)(?:[.-].*)?$"


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda w: w != "")


def _joined(text: Column) -> Column:
    """Its lines as one."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def notices(text: Column, is_file: Column) -> Column:
    """The distinct blocks and sentences of a text that speak of a licence, and the whole of a licence file."""
    speaks = lambda s: s.rlike(f"(?i)(?:{SPEAKS})")
    parts = lambda at: F.filter(F.transform(F.split(text, at), _joined), speaks)
    blocks = parts("\\n[ \\t\\r]*\\n")
    sentences = F.flatten(F.transform(F.concat(parts("\\n"), blocks), lambda s: F.split(F.regexp_replace(s, "([.;!?]) ", "$1\n"), "\n")))
    whole = F.when(is_file, F.array(_joined(text))).otherwise(F.array().cast("array<string>"))
    return F.when(speaks(text), F.array_distinct(F.concat(F.filter(sentences, speaks), blocks, whole))).otherwise(F.array().cast("array<string>"))


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(str(i)).alias("key"), F.lit(name).alias("license"), F.lit(text).alias("notice")) for i, (name, text) in enumerate(templates)))
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def _weights(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, word, weight, norm) for the words of each row (key, notice); idf has all of them."""
    words = rows.select("key", F.explode(_words(F.col("notice"))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = words.join(idf, "word").select("key", "word", (F.col("tf") * F.col("idf")).alias("weight"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norms, "key")


def score_notices(found: DataFrame, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """(key, license, score) of each notice (key, notice, n: how often) that reaches the threshold."""
    known = _templates(found.sparkSession, templates)
    everything = found.select("notice", "n").unionByName(known.select("notice", F.lit(1).cast("long").alias("n")))
    total = everything.agg(F.sum("n").alias("total")).first()["total"]
    frequencies = everything.select("n", F.explode(F.array_distinct(_words(F.col("notice")))).alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    idf = frequencies.select("word", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    theirs = _weights(known, idf).join(known.select("key", "license"), "key")
    theirs = theirs.select("word", F.col("key").alias("template"), "license", F.col("weight").alias("t_weight"), F.col("norm").alias("t_norm"))
    # the words of the templates, which come from the driver: to every task up to 4 MB of text
    theirs = F.broadcast(theirs) if sum(len(text) for _, text in templates) <= 4 << 20 else theirs
    dots = _weights(found, idf).join(theirs, "word").groupBy("key", "norm", "template", "license", "t_norm").agg(F.sum(F.col("weight") * F.col("t_weight")).alias("dot"))
    scored = dots.select("key", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"))
    return best.select("key", F.col("best.license").alias("license"), (-F.col("best.rank")).alias("score"))


def scan_licenses(files: DataFrame, threshold: float = 0.7, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of files (doc_id, path, text): doc_id, path, own_license, own_score, license, from_dir.

    from_dir: the directory that a licence is inherited from, null where it is the file's own.
    templates: (licence, text) of what to look for, instead of the customary ones.
    """
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace("path", "/[^/]*$", "")
    is_file = F.coalesce(name.rlike(_LICENCE_FILE), F.lit(False))
    files = files.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "path", is_file.alias("is_file"), folder.alias("dir"), notices(F.coalesce("text", F.lit("")), is_file).alias("notices"))
    files = materialize(files, "notices")
    said = files.select("uid", F.explode("notices").alias("notice")).withColumn("key", F.md5("notice"))
    units = materialize(said.groupBy("key").agg(F.min("notice").alias("notice"), F.count(F.lit(1)).alias("n")), "units")
    known = materialize(score_notices(units, threshold, templates or TEMPLATES), "scores")
    own = said.select("uid", "key").join(known, "key").groupBy("uid").agg(F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"))
    own = own.select("uid", F.col("best.license").alias("own_license"), (-F.col("best.rank")).alias("own_score"))
    files = materialize(files.drop("notices").join(own, "uid", "left"), "files")

    licensed = files.filter(F.col("own_license").isNotNull() & F.col("is_file"))
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("rank"), F.col("own_license").alias("license"))).alias("best"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"))
    dirs = files.select("dir").filter("dir is not null").distinct().withColumn("steps", F.size(F.split("dir", "/")))
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("depth")).withColumn("above", F.expr("substring_index(dir, '/', depth)"))
    nearest = chain.join(licensed, "above").groupBy(F.col("dir").alias("of")).agg(F.max(F.struct("depth", "above", "dir_license")).alias("near"))
    nearest = nearest.select(F.struct("of").alias("of"), F.col("near.above").alias("above"), F.col("near.dir_license").alias("dir_license"))
    out = files.join(nearest, F.struct("dir") == F.col("of"), "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("above")).alias("from_dir"))


def corpus_paths(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) laid out as a tree: 50 files a directory, 20 directories above; each fiftieth file is a LICENSE."""
    top, low = F.expr("doc_id div 1000"), F.expr("doc_id div 50")
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(F.lit("/corpus/"), top, F.lit("/LICENSE")))
    path = path.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("/corpus/"), top, F.lit("/"), low, F.lit("/LICENSE")))
    path = path.otherwise(F.concat(F.lit("/corpus/"), top, F.lit("/"), low, F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
