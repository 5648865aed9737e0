"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Only DataFrame functions. A text becomes shingles of SHINGLE words; those that no template has can match nothing and are
dropped by a join with the templates' shingles. For each scale (a power of two) windows of that many words overlap by half,
so that a template of n shingles lies whole in a window of 2n to 4n words. BANDS minwise values of each window, one row to a
band, retrieve every template of that scale with which the window shares one. A template present with containment c >= 0.8
has a Jaccard similarity of at least c n / (4n + n), 0.16, with its window even if all other words of it are shingles of
other templates, and is then missed with probability 0.84 ** BANDS = 1.4e-5; with other text around, which drops out, the
similarity is near c and the chance below 1e-40. Containment is then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.shared import BROADCAST_ROWS, cut, drop, small

SHINGLE, BANDS, CONTAINMENT = 3, 64, 0.8
#: Notices of widely used licenses and one whole text, by their public identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "Zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: What stands between words, for Java's and for RE2's patterns.
GAP = r"[^\p{L}\p{N}]+"


def words(text: str) -> str:
    """An expression for the lower-cased words of a column: runs of letters and digits."""
    return f"filter(split(lower(coalesce(cast({text} as string), '')), '{GAP.replace(chr(92), chr(92) * 2)}'), w -> w <> '')"


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, n, scale, h): a row for each distinct shingle of each template; templates under SHINGLE words raise."""
    table = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    w = table.selectExpr("license", f"{words('text')} as w")
    checked = w.withColumn("w", F.when(F.size("w") >= SHINGLE, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("too short a template: "), "license"))))
    sets = checked.select("license", F.expr(f"array_distinct({_shingled()})").alias("h")).withColumn("n", F.size("h"))
    scale = F.pow(F.lit(2), F.ceil(F.log2(F.col("n").cast("double"))) + 1).cast("int")
    return sets.select("license", "n", scale.alias("scale"), F.explode("h").alias("h"))


def _shingled() -> str:
    parts = ", ".join(f"get(w, i + {k})" for k in range(SHINGLE))
    return f"transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({parts}))"


def matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, first_word, containment): for each document and license the first window's start and the best share of
    the template's shingles that one window holds.

    Null, empty and shorter texts and rows with a null doc_id hold none; rows that share a doc_id are one document. Templates
    under SHINGLE words raise. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    known = template_shingles(spark, TEMPLATES if templates is None else templates)
    rows = known.count()
    shingles = small(known.select("h", "scale").distinct(), rows)
    w = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", f"{words('text')} as w").where(f"size(w) >= {SHINGLE}")
    hits = w.select("doc_id", F.posexplode(F.expr(_shingled())).alias("at", "h")).join(shingles, "h")
    # A place lies in two windows of its scale: they start at multiples of half of it.
    half = F.expr("scale div 2")
    window = F.explode(F.array(F.floor(F.col("at") / half), F.floor(F.col("at") / half) - 1))
    placed = hits.select("doc_id", "scale", "h", "at", window.alias("window"))
    bands = [F.min(F.xxhash64("h", F.lit(k))).alias(f"b{k}") for k in range(BANDS)]
    # Written, so that texts are split into words once: only windows with shingles of templates are left here.
    windows = cut(placed.groupBy("doc_id", "scale", "window").agg(F.collect_set("h").alias("set"), F.min("at").alias("at"), *bands), "windows")
    band = lambda: F.posexplode(F.array(*(f"b{k}" for k in range(BANDS)))).alias("band", "value")
    keys = known.groupBy("license", "scale").agg(F.collect_set("h").alias("template"), *bands).select("license", "scale", band())
    found = windows.select("doc_id", "scale", "window", band()).join(small(keys, rows * BANDS if rows < BROADCAST_ROWS else rows), ["scale", "band", "value"])
    candidates = found.select("doc_id", "scale", "window", "license").distinct()
    full = known.groupBy("license").agg(F.collect_set("h").alias("template"))
    sure = candidates.join(windows.select("doc_id", "scale", "window", "at", "set"), ["doc_id", "scale", "window"]).join(small(full, rows), "license")
    share = F.size(F.array_intersect("set", "template")) / F.size("template")
    out = cut(sure.withColumn("share", share).where(F.col("share") >= containment).groupBy("doc_id", "license").agg(F.min("at").alias("first_word"), F.max("share").alias("containment")), "licenses")
    drop(windows)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_licenses (long) and licenses, their sorted names joined by commas.

    Null, empty and shorter texts hold none. Rows with a null doc_id are not searched and hold none; rows that share a doc_id
    share what any of them holds. Other columns are not read. An empty table gives no rows.
    """
    found = matches(docs, templates, containment).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    told = ids.where("doc_id is not null").join(small(found), "doc_id", "left")
    out = told.unionByName(ids.where("doc_id is null"), allowMissingColumns=True)  # nulls would meet in one task of the join
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))
