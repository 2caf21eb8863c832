"""License scans, in DataFrame functions only.

Words are compared as shingles of five. A text is cut into overlapping windows as long as a
license template, every window and template gets its smallest hash under each of several
hash functions, and bands of them are the join keys that retrieve templates. Exact shingle
containment then decides.

Bands: with `BANDS` bands of one row each, a window of Jaccard similarity J to a template is
retrieved with probability 1 - (1 - J) ^ BANDS. Windows are a quarter longer than the template
and start every quarter of it, so one of them has the whole passage. If that holds 0.8 of the
template's shingles, J is at least 0.8 / 1.45 = 0.55, and 16 bands miss it with a chance of 3e-6.
One row per band means that a shared smallest hash is a shared shingle: documents that share
no shingle with any template can be set aside before windows are cut, and lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE_WORDS = 5
BANDS = 16
MIN_CONTAINMENT = 0.8
_PRIME = 2_147_483_647

# Notices as projects write them and the opening paragraphs of the licenses themselves.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, template) rows of the given texts, or of TEMPLATES."""
    rows = [(name, text) for name, texts in (TEMPLATES if templates is None else templates).items() for text in texts]
    return spark.createDataFrame(rows, "license string, template string")


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once; put into a lambda as it is, it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and of all other non-ASCII characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """The hash of every run of `size` words; of all words if there are fewer, none without words."""
    def runs(ws: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(ws) - (size - 1))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ws, i, F.lit(size)))))

    return _bound(words, runs)


def _smallest(own: Column, bands: int) -> Column:
    """The smallest value of each of several hash functions over shingles: a * h + b modulo a prime."""
    small = F.transform(own, lambda h: F.pmod(h, F.lit(_PRIME)))
    made = []
    for k in range(bands):
        a, b = (48_271 * (k + 1) ** 5 + 11) % _PRIME, (69_621 * (k + 3) ** 3) % _PRIME
        made.append(F.array_min(F.transform(small, lambda h: F.pmod(h * F.lit(a) + F.lit(b), F.lit(_PRIME)))))
    return F.array(*made)


def _cut(n: int):
    return lambda start: F.struct(start.alias("start"), F.lit(n).alias("n"))


def scan(documents: DataFrame, templates: DataFrame, text: str = "text", doc_id: str = "doc_id",
         size: int = SHINGLE_WORDS, bands: int = BANDS, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, start and n_shingles: where licenses stand in documents.

    A row per document and license, for the template and window with the largest containment
    (share of the template's different shingles that the window has), ties to the first window
    and the longest template. Whole texts are cut into windows for each length of template. Null and empty texts, texts and templates without words,
    and empty tables give no rows; equal rows of a document count once. Templates are one small
    table, of no more than some thousand rows.
    """
    known = templates.select("license", "template", shingles(words(F.col("template")), size).alias("own")).where(
        F.size("own") > 0).withColumns({"n": F.size("own"), "tag": F.xxhash64("license", "template")})
    facts = known.agg(F.collect_set("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("all")).first()
    lengths = sorted(facts["n"])
    if not lengths:
        return documents.sparkSession.createDataFrame(
            [], documents.select(F.col(f"`{doc_id}`").alias("doc_id")).schema.add("license", "string").add(
                "containment", "double").add("start", "long").add("n_shingles", "long"))
    every = F.array(*[F.lit(h) for h in facts["all"]])
    found = documents.select(F.col(f"`{doc_id}`").alias("doc_id"),
                             shingles(words(F.col(f"`{text}`")), size).alias("own"))
    some = found.where(F.arrays_overlap("own", every)).distinct()
    # A window of n shingles every n // 4, the last one at the end of the text.
    cuts = []
    for n in lengths:
        last = F.greatest(F.lit(0), F.size("own") - n)
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(max(1, n // 4))), F.array(last)))
        cuts.append(F.transform(starts, _cut(n)))
    windows = some.select("doc_id", "own", F.xxhash64("own").alias("key"), F.explode(F.concat(*cuts)).alias("w")).select(
        "doc_id", "key", F.col("w.start").alias("start"), F.col("w.n").alias("n"),
        F.slice("own", F.col("w.start") + 1, F.col("w.n") + F.floor(F.col("w.n") / 4).cast("int")).alias("own"))
    near = windows.where(F.arrays_overlap("own", every))
    keyed = near.select("*", F.posexplode(_smallest(F.col("own"), bands)).alias("band", "low"))
    wanted = known.select("license", "tag", "n", F.col("own").alias("whole"),
                          F.posexplode(_smallest(F.col("own"), bands)).alias("band", "low"))
    pairs = keyed.join(wanted, ["n", "band", "low"]).dropDuplicates(["doc_id", "key", "start", "n", "tag"])
    share = F.size(F.array_intersect("own", "whole")) / F.size(F.array_distinct("whole"))
    hits = pairs.withColumn("containment", share).where(F.col("containment") >= min_containment)
    best = F.max_by(F.struct("containment", "start", "n"), F.struct("containment", -F.col("start"), "n")).alias("best")
    return hits.groupBy("doc_id", "license").agg(best).select(
        "doc_id", "license", "best.containment", F.col("best.start").cast("long").alias("start"),
        F.col("best.n").cast("long").alias("n_shingles"))
