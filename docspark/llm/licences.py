"""Licence scans, with DataFrame operations only.

Lines and blocks of a file are compared with licence notices by the cosine of
sparse TF-IDF vectors, and licence files as a whole with whole licences. A file without a licence of its own takes that of the
licence file in the nearest directory above it, found by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import written

LEAST_COSINE = 0.6
# Notices as their licences word them, one licence may have several
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED'
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
    " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER"
    " CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
    " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
# Whole licence texts, which licence files are compared with as a whole
FULL_TEXTS = [
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        ' the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT'
        " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
        " EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
        " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
        " OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
        " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
        " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    (
        "BSD-3-Clause",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission." + _WARRANTY,
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the"
        " author or authors of this software dedicate any and all copyright interest in the software to the public domain."
        " We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
        ' this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR'
        " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
        " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE.",
    ),
]
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def template_vectors(templates: DataFrame, texts: DataFrame) -> tuple[DataFrame, Column]:
    """``(template, licence, term, weight, norm)`` and the weight of other terms.

    The idf of a template's term is ln((1 + N) / (1 + df)) + 1 over all N texts.
    Any other term counts as one that no text holds.
    """
    owned = templates.select("template", "licence", F.explode(terms_of(F.col("text"))).alias("term"))
    tf = owned.groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    vocabulary = tf.select("term").distinct()  # as many rows as the templates have words
    held = texts.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    df = held.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    idf = F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighted = tf.join(df, "term", "left").select("*", idf.alias("idf")).drop("df")
    vectors = weighted.withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    return vectors.withColumn("norm", norm), F.log(F.lit(1.0 + n)) + 1


def anchors(vectors: DataFrame, least: float) -> list[str]:
    """Terms without any of which no text reaches the cosine ``least``.

    From the lightest up, terms are left out as long as their part of the vector
    is shorter than ``least``: a text that shares only these stays below it.
    """
    lightest = Window.partitionBy("template").orderBy("weight", "term")
    square = F.col("weight") * F.col("weight")
    upto = F.sum(square).over(lightest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = vectors.withColumn("upto", upto).where(
        F.col("upto") >= F.lit(least * least * 0.999999) * F.col("norm") * F.col("norm")
    )
    return sorted(r["term"] for r in kept.select("term").distinct().collect())


def own_licences(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``(path, licence, score)`` of each path with a line or block like a template."""
    texts = files.where("text is not null").select("path", "text")
    vectors, other = template_vectors(templates, texts)
    vectors = written(vectors, "licence-vectors")
    terms = anchors(vectors, least)
    if not terms:
        return files.select("path").limit(0).select("path", F.lit("").alias("licence"), F.lit(0.0).alias("score"))
    anchor = F.lit(rf"(?i)(?<![a-z0-9])({'|'.join(terms)})(?![a-z0-9])")
    # a licence text wrapped over lines is one block; blocks end at blank lines
    flat = F.regexp_replace("text", "\\r", "")
    units = F.array_union(F.split(flat, "\n"), F.split(flat, "\n[ \t]*\n"))
    found = (
        texts.where(F.regexp_like("text", anchor))
        .select("path", F.explode(F.array_distinct(units)).alias("unit"))
        .where(F.regexp_like("unit", anchor))
        .select("path", "unit", F.explode(terms_of(F.col("unit"))).alias("term"))
        .groupBy("path", F.xxhash64("unit").alias("unit"), "term")
        .agg(F.count("*").alias("n"))
    )
    return _best(found, vectors, other, least)


def whole_files(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``(path, licence, score)`` of licence files that are like a whole licence text."""
    named = F.regexp_like(F.regexp_extract("path", "([^/]*)$", 1), F.lit(LICENCE_FILE))
    texts = files.where("text is not null").where(named).select("path", "text")
    vectors, other = template_vectors(templates, texts)
    vectors = written(vectors, "licence-texts")
    found = (
        texts.select("path", F.xxhash64("text").alias("unit"), F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("path", "unit", "term")
        .agg(F.count("*").alias("n"))
    )
    return _best(found, vectors, other, least)


def _best(found: DataFrame, vectors: DataFrame, other: Column, least: float) -> DataFrame:
    """The licence nearest to any unit of a path, from counts ``(path, unit, term, n)``."""
    weights = vectors.select("term", "idf").distinct()
    weighed = found.join(F.broadcast(weights), "term", "left").select(
        "path", "unit", "term", "n", (F.col("n") * F.coalesce("idf", other)).alias("w")
    )
    norms = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    held = vectors.select("template", "licence", "term", "weight", "norm")
    dots = (
        weighed.join(F.broadcast(held), "term")
        .groupBy("path", "unit", "template", "licence", "norm")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    score = F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)
    return (
        dots.join(norms, ["path", "unit"])
        .withColumn("score", score)
        .where(F.col("score") >= least)
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
        .select("path", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"))
    )


def parent(path: Column) -> Column:
    """The directory of a path without a slash at its end; "" for a file at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """A directory and those above it, with their depth; the top is ""."""
    parts = F.split(folder, "/")
    depth = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), depth),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("above")),
    )


def scan(
    files: DataFrame,
    templates: DataFrame | None = None,
    least: float = LEAST_COSINE,
    full_texts: DataFrame | None = None,
) -> DataFrame:
    """``files`` with ``own_licence``, ``score``, ``licence`` and ``licence_from``.

    ``licence`` is a file's own one, else that of the nearest directory above (its
    own directory first) with a licence file that has one; ``licence_from`` names
    that directory. Of several licence files in a directory the best score wins,
    then the smallest licence name; of several rows with one path each counts. A
    null path has neither own nor inherited licence, a null or empty text no own
    one, an empty table gives an empty result. Columns of these four names in
    ``files`` are replaced. Paths are inherited per directory, not per file.

    ``templates`` are notices, compared with lines and blocks of every file, ``full_texts``
    whole licences, compared with licence files as a whole; where both are found the
    better score counts. Both are a caller's lists, of some thousand words.
    """
    spark = files.sparkSession
    templates = templates or default_templates(spark)
    full_texts = full_texts or _templates(spark, FULL_TEXTS)
    added = ("own_licence", "score", "licence", "licence_from", "_folder")
    rest = [c for c in files.columns if c not in added]
    placed = files.where("path is not null")
    either = own_licences(placed, templates, least).unionByName(whole_files(placed, full_texts, least))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    own = either.groupBy("path").agg(best).select("path", "best.licence", (-F.col("best.minus")).alias("score"))
    own = written(own, "licences")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    given = (
        own.where(F.regexp_like(name, F.lit(LICENCE_FILE)))
        .groupBy(parent(F.col("path")).alias("above"))
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence"))["licence"].alias("given"))
    )
    folders = files.where("path is not null").select(parent(F.col("path")).alias("_folder")).distinct()
    inherited = (
        folders.select("_folder", F.explode(ancestors(F.col("_folder"))).alias("a"))
        .select("_folder", "a.depth", "a.above")
        .join(given, "above")
        .groupBy("_folder")
        .agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    )
    known = own.select("path", F.col("licence").alias("own_licence"), "score")
    return (
        files.select(*rest)
        .withColumn("_folder", parent(F.col("path")))
        .join(known, "path", "left")
        .join(inherited, "_folder", "left")
        .select(
            *rest,
            "own_licence",
            "score",
            F.coalesce("own_licence", "near.given").alias("licence"),
            F.when(F.col("own_licence").isNull(), F.col("near.above")).alias("licence_from"),
        )
    )


def default_templates(spark: SparkSession) -> DataFrame:
    return _templates(spark, TEMPLATES)


def _templates(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, licence, text) for i, (licence, text) in enumerate(texts)]
    return spark.createDataFrame(rows, "template int, licence string, text string")
