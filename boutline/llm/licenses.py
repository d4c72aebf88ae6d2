"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates of like length form a class: m shingles of five words with L <= m < 2 L, L a
power of two. A text is cut into windows of 2 L - 1 + L/2 shingles, one every L/2, so
some window holds a whole copy of a template and their Jaccard similarity is at least
L / 2.5 L = 0.4. Sixteen bands of one minimum then share a value with probability at least
1 - 0.6**16 > 0.9997. An edited copy with 75 % of the shingles of the shortest template of
a class has a similarity of about 0.27 only, and is retrieved with 1 - 0.73**16, about 0.994.
Of retrieved templates, those whose shingles lie in the window to at
least ``MIN_CONTAINED_PCT`` are matches, of those at one place the fullest. Only windows with a template shingle are hashed;
others share no value with any template. DataFrame functions only, no shuffle of texts.

Defined cases: null or empty texts match nothing; repeated rows and rows sharing a doc_id
are judged by id and text; a null doc_id is carried; templates of fewer than five words are
refused; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boutline.llm.common import grams, let
from boutline.plans.bounded import bounded
from boutline.session import cut_lineage

SHINGLE = 5
BANDS = 16
MIN_CONTAINED_PCT = 75

# Notices as their licenses word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def shingles(text: Column) -> Column:
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return let(tokens, lambda t: grams(t, SHINGLE))


def _minima(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(F.array_min(F.transform(window, lambda x: F.xxhash64(x, band))), band))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, contained_pct, first_word, n_windows), a row for each license that
    a document names; ``first_word`` is the place of the first shared shingle."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(enumerate(f"{a}\n{b}" for a, b in templates or TEMPLATES)), "template int, both string")
    known = known.select("template", F.substring_index("both", "\n", 1).alias("license"), F.array_distinct(shingles(F.expr("substr(both, instr(both, '\n') + 1)"))).alias("parts"))
    # as many rows as templates: their hashes become constants of the plan
    rows = known.collect()
    if any(not r["parts"] for r in rows):
        raise ValueError("a template has fewer than five words")
    classes = {r["template"]: 1 << (len(r["parts"]).bit_length() - 1) for r in rows}
    hashes = {c: sorted({h for r in rows if classes[r["template"]] == c for h in r["parts"]}) for c in sorted(set(classes.values()))}
    bands = known.select("template", "license", "parts", F.explode(_minima(F.col("parts"))).alias("value"))

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    every = sorted({h for x in hashes.values() for h in x})
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2"), let(shingles(text), lambda h: F.when(F.exists(h, lambda x: x.isin(every)), h)).alias("h"))
    some = cut_lineage(keyed.filter("h is not null").dropDuplicates(["k1", "k2"]))

    found = None
    for size, own in hashes.items():
        step = max(1, size // 2)
        width = 1 if size == 1 else 2 * size - 1 + step
        at = F.filter(F.transform("h", _place(own)), lambda p: p.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, _covering(width, step))))
        windows = some.select("doc_id", "k1", "k2", "h", F.explode(starts).alias("i")).select("doc_id", "k1", "k2", (F.col("i") * step).alias("start"), F.slice("h", F.col("i") * step + 1, width).alias("window"))
        banded = windows.select("doc_id", "k1", "k2", "start", "window", F.explode(_minima(F.col("window"))).alias("value"))
        ours = [t for t, c in classes.items() if c == size]
        hit = banded.join(bounded(bands.filter(F.col("template").isin(ours))), "value").dropDuplicates(["k1", "k2", "start", "template"])
        part = hit.select("doc_id", "k1", "k2", "license", "start", "parts", "window", F.size(F.array_intersect("window", "parts")).alias("n")).filter(100 * F.col("n") >= MIN_CONTAINED_PCT * F.size("parts"))
        place = F.array_min(F.filter(F.transform("window", lambda x, i: F.when(F.array_contains("parts", x), i)), lambda i: i.isNotNull()))
        part = part.select("doc_id", "k1", "k2", "license", (100 * F.col("n") / F.size("parts")).alias("pct"), (F.col("start") + place).cast("long").alias("word"))
        found = part if found is None else found.unionByName(part)
    # of licenses whose wording differs in a word or two, the one nearest to the text
    found = found.withColumn("top", F.max("pct").over(W.partitionBy("k1", "k2", "word"))).filter("pct = top")
    out = found.groupBy("k1", "k2", "license").agg(F.first("doc_id").alias("doc_id"), F.round(F.max("pct"), 6).alias("contained_pct"), F.min("word").alias("first_word"), F.countDistinct("word").alias("n_windows"))
    return out.select("doc_id", "license", "contained_pct", "first_word", "n_windows")


def _place(own: list[int]):
    """The place of a shingle that is one of ``own``, else null."""
    return lambda x, i: F.when(x.isin(own), i)


def _covering(width: int, step: int):
    """Indices of the windows that hold the shingle at a place."""
    return lambda p: F.sequence(F.greatest(F.ceil((p - (width - 1)) / step).cast("int"), F.lit(0)), F.floor(p / step).cast("int"))
