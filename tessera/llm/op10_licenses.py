"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's licence statements are sparse vectors over words (term frequency times inverse document frequency, the latter
counted over all documents), each compared with every template by cosine.  Units of three sizes are statements, if they
hold a licence cue: single lines; paragraphs of several lines (a header wrapped over comment lines, say); the whole text
of several paragraphs (a licence file).  The templates have the same sizes: one-line notices, header notices, licence texts.
A paragraph or text is only compared if half of its distinct words are words of the templates.  The best statement gives
the file's licence: a whole text before a paragraph before a line, then the highest cosine.  A file is a licence file and
speaks for its directory if its whole text, or a statement with at least `file_share` of its words, is one, or if it has a
statement and such a name (LICENSE, COPYING); a file without a statement of its own takes the licence of the nearest
ancestor directory that has one.

DataFrame operations only.  The templates are fixed text, so their words (a few hundred) and vectors are a bounded
broadcast.  Document frequencies aggregate before their shuffle.  The weights and the statements, which later steps read
several times, are cut off as shared tables.  Directories are resolved once each, then joined to files by directory with
a salt, so a directory that holds a third of all files is spread over tasks.

Defined cases: null and empty texts have no statements; a null path has no directory and inherits nothing; equal
cosines go to the first statement in the text, then to the first licence name; of several licence files in one directory the
highest cosine counts, then the first path, then the first licence name; rows are known by a hash of file, path and text, so
rows that repeat a file number (a null one too) are files of their own and equal rows have equal results; texts of any
length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import stored

LEAST = 0.6
LEAST_LARGE = 0.8  # of paragraphs and whole texts
FILE_SHARE = 0.25
SALTS = 16
CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|public domain"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_OPENING = "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)

#: One-line notices, header notices and texts of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide. CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", f'{_APACHE_NOTICE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("GPL-2.0", _GPL_NOTICE.format(2)),
    ("GPL-3.0", _GPL_NOTICE.format(3)),
    ("GPL-3.0", _GPL_NOTICE.format(3).partition(" This program is distributed")[0]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", _GPL_NOTICE.format(3).replace("program", "library").replace("General Public", "Lesser General Public")),
    ("MIT", _MIT_GRANT),
    ("MIT", f"MIT License. Copyright (c). {_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
)
_BREAK = r"[^\p{L}\p{N}]+"
_BLANK = r"\n([^\p{L}\p{N}\n]*\n)+"  # between paragraphs: lines without a letter or digit
_FILE_NAME = r"(?i)^(licen[cs]es?|copying|unlicense)([._-].*)?$"
VOCABULARY = sorted({w for _, text in TEMPLATES for w in re.split(r"[\W_]+", text.lower()) if w})


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAK), lambda x: x != "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, template_text string")
    return rows.select("template", "license", F.explode(_terms(F.col("template_text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("template_tf"))


def weights(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """term, idf of every template word: ln((n + 1) / (df + 1)) + 1 over all rows of texts (column text)."""
    vocabulary = _templates(spark).select("term").distinct()
    total = texts.agg(F.count(F.lit(1)).alias("n_docs"))
    found = (
        texts.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), _BREAK))).alias("term"))
        .join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    df = F.coalesce("df", F.lit(0))
    return (
        vocabulary.join(F.broadcast(found), "term", "left").crossJoin(F.broadcast(total))
        .select("term", (F.log((F.col("n_docs") + 1.0) / (df + 1.0)) + 1.0).alias("idf"))
    )


def units(files: DataFrame) -> DataFrame:
    """Statements to compare: of_row, n_words (of the file), kind (0 whole text, 1 paragraph, 2 line), place and terms."""
    unit = lambda kind, place, content: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), content.alias("content"))
    cued = files.where(F.col("text").rlike(CUE)).withColumn("parts", F.split("text", _BLANK))
    lines = F.transform(F.split("text", "\n"), lambda x, i: unit(2, i, x))
    paragraphs = F.transform("parts", lambda x, i: unit(1, i, x))
    whole = F.filter(F.array(unit(0, F.lit(0), F.col("text"))), lambda x: F.size("parts") > 1)
    each = cued.select("of_row", F.size(_terms(F.col("text"))).alias("n_words"), F.explode(F.concat(lines, paragraphs, whole)).alias("u")).select("of_row", "n_words", "u.*")
    said = each.where(F.col("content").rlike(CUE) & ((F.col("kind") != 1) | F.trim("content").contains("\n"))).withColumn("terms", _terms(F.col("content"))).drop("content")
    return said.where((F.col("kind") == 2) | (2 * F.size(F.array_intersect("terms", F.lit(VOCABULARY))) >= F.size(F.array_distinct("terms"))))


def statements(files: DataFrame) -> DataFrame:
    """Best licence statement of each file with one: of_row, license, cosine, is_file.  files: of_row, path, text."""
    spark = files.sparkSession
    idf, _ = stored(weights(files, spark), "licence-weights")
    model = _templates(spark).join(F.broadcast(idf), "term").withColumn("weight", F.col("template_tf") * F.col("idf"))
    norms = model.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("template_norm"))
    model = model.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("weight") / F.col("template_norm")).alias("share"))

    unit = ["of_row", "kind", "place"]
    tf = (
        units(files).select(*unit, "n_words", F.size("terms").alias("n_unit"), F.explode("terms").alias("term"))
        .groupBy(*unit, "n_words", "n_unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    # Words outside the templates weigh as the rarest template word: they make a statement less like any template.
    most = idf.agg(F.max("idf").alias("most"))
    weighed = tf.join(F.broadcast(idf), "term", "left").crossJoin(F.broadcast(most)).withColumn("weight", F.col("tf") * F.coalesce("idf", "most")).drop("idf", "most")
    norm = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighed.join(F.broadcast(model), "term").groupBy(*unit, "n_words", "n_unit", "template", "license").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    least = F.when(F.col("kind") < 2, LEAST_LARGE).otherwise(LEAST)
    scored = dots.join(norm, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    best = F.struct("kind", (-F.col("cosine")).alias("c"), "place", "license", "n_unit", "n_words")
    is_file = (F.col("b.kind") == 0) | (F.col("b.n_unit") >= FILE_SHARE * F.col("b.n_words"))
    return scored.groupBy("of_row").agg(F.min(best).alias("b")).select("of_row", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), is_file.alias("is_file"))


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, down to '' for the root."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame) -> DataFrame:
    """file, path, license, origin ('own', 'inherited' or 'none'), cosine and from_directory of every file.

    files: file (long), path (directories separated by '/'), text.
    """
    rows = files.select("file", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.xxhash64("file", F.lit(0), "path", F.lit(1), "text").alias("of_row"))
    own, _ = stored(statements(rows), "licence-statements")
    directory = F.regexp_replace(F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))), "^/+", "")
    placed = rows.select("of_row", "file", "path", directory.alias("directory")).join(own, "of_row", "left")
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(_FILE_NAME) & F.col("license").isNotNull()
    speaking = (
        placed.where((F.col("is_file") | named) & F.col("directory").isNotNull())
        .groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b"))
        .select(F.col("directory").alias("above"), F.col("b.license").alias("inherited"))
    )
    resolved = (
        placed.where(F.col("directory").isNotNull()).select("directory").distinct()
        .select("directory", F.explode(_ancestors(F.col("directory"))).alias("above")).distinct()
        .join(speaking, "above")
        .groupBy("directory").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "inherited")).alias("n"))
        .select("directory", F.col("n.above").alias("from_directory"), F.col("n.inherited").alias("inherited"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    )
    has = F.col("license").isNotNull()
    return (
        placed.withColumn("salt", F.pmod("of_row", F.lit(SALTS)).cast("int")).join(resolved, ["directory", "salt"], "left")
        .select(
            "file", "path", F.coalesce("license", "inherited").alias("license"),
            F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
            "cosine", F.when(~has, F.col("from_directory")).alias("from_directory"),
        )
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """The path that a document's file has here: its source, two directories by number, and its number; null without a number."""
    path = F.concat_ws("/", F.coalesce(source, F.lit("none")), F.floor(doc_id / 1000).cast("string"), F.floor(doc_id / 50).cast("string"), F.concat(doc_id.cast("string"), F.lit(".txt")))
    return F.when(doc_id.isNotNull(), path)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("doc_id").alias("file"), document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return scan(files).withColumnRenamed("file", "doc_id")


_SQL_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SQL_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_SQL_CUED = f"regexp_matches(content, '{CUE}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id || '.txt' AS name, coalesce(text, '') AS text,
  CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, 'none'), CAST(floor(doc_id / 1000) AS BIGINT), CAST(floor(doc_id / 50) AS BIGINT)) END AS directory FROM documents),
t0(template, license, template_text) AS (VALUES {_SQL_TEMPLATES}),
t AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_SQL_TERMS.format("template_text")}) AS term FROM t0) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM t),
df AS (SELECT term, count(DISTINCT r) AS df FROM (SELECT r, unnest({_SQL_TERMS.format("text")}) AS term FROM d) WHERE term IN (FROM vocabulary) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM d) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM vocabulary LEFT JOIN df USING (term)),
model AS (SELECT template, license, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS share FROM t JOIN idf USING (term)),
c AS (SELECT r, text, len({_SQL_TERMS.format("text")}) AS n_words, regexp_split_to_array(text, '{_BLANK}') AS parts FROM d WHERE regexp_matches(text, '{CUE}')),
u AS (SELECT r, n_words, 2 AS kind, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM c
  UNION ALL SELECT r, n_words, 1, unnest(parts), generate_subscripts(parts, 1) FROM c
  UNION ALL SELECT r, n_words, 0, text, 0 FROM c WHERE len(parts) > 1),
s AS (SELECT r, kind, place, n_words, {_SQL_TERMS.format("content")} AS terms FROM u WHERE {_SQL_CUED} AND (kind <> 1 OR contains(trim(content, ' '), chr(10)))),
w AS (SELECT r, kind, place, n_words, n_unit, term, n * coalesce(idf, (SELECT max(idf) FROM idf)) AS weight FROM
  (SELECT r, kind, place, n_words, n_unit, term, count(*) AS n FROM (SELECT r, kind, place, n_words, len(terms) AS n_unit, unnest(terms) AS term FROM s
    WHERE kind = 2 OR 2 * len(list_intersect(list_distinct(terms), (SELECT list(term) FROM vocabulary))) >= len(list_distinct(terms))) GROUP BY ALL) LEFT JOIN idf USING (term)),
norm AS (SELECT r, kind, place, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT r, kind, place, n_words, n_unit, template, license, sum(weight * share) AS dot FROM w JOIN model USING (term) GROUP BY ALL),
scored AS (SELECT dots.*, round(dot / norm, 9) AS cosine FROM dots JOIN norm USING (r, kind, place) WHERE round(dot / norm, 9) >= CASE WHEN kind < 2 THEN {LEAST_LARGE} ELSE {LEAST} END),
own AS (SELECT r, license, cosine, kind = 0 OR n_unit >= {FILE_SHARE} * n_words AS is_file FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY kind, cosine DESC, place, license) = 1),
speaking AS (SELECT directory, license FROM own JOIN d USING (r) WHERE is_file AND directory IS NOT NULL QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, directory || '/' || name, license) = 1),
above AS (SELECT d.directory, max(struct_pack(depth := length(s.directory), directory := s.directory, license := s.license)) AS n
  FROM (SELECT DISTINCT directory FROM d) d JOIN speaking s ON d.directory = s.directory OR starts_with(d.directory, s.directory || '/') GROUP BY d.directory)
SELECT doc_id, directory || '/' || name AS path, coalesce(own.license, n.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, own.cosine AS cosine,
  CASE WHEN own.license IS NULL THEN n.directory END AS from_directory
FROM d LEFT JOIN own USING (r) LEFT JOIN above USING (directory)
"""
