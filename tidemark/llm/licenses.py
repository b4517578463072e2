"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

DataFrame functions only. A text is lower-cased (A-Z), cut into words and seen as the row of its
5-word shingles. A template of s distinct shingles is sought in windows of s + s // 2 shingles (one more
where s is 1) at every (s // 2)-th place, so any s neighbouring shingles lie in one of them. A window that holds a
template at containment c has Jaccard similarity of at least c / (1.5 + 1 - c); BANDS bands of one minimum
hash each then meet with probability 1 - (1 - 0.47)**16 > 0.9999 at c = 0.8. Windows and templates
that meet in a band are verified by the exact share of the template's shingles in the window.

Windows without any template shingle have containment 0 and get no bands; that is the only thing
left out. The templates are a fixed list, so what each task receives does not grow with the data,
and rows are shuffled only after verification.

Result: one row per document and license: doc_id, license, containment (the highest), start_word
(of the first window that reaches it). Many notices share most of their words, so of licenses whose windows overlap in a
document only the one with the highest containment is given, or of equal ones that with the longest template.

Covered are those of TEMPLATES: MIT, Apache-2.0, GPL-2.0 and 3.0, LGPL-2.1 and 3.0, AGPL-3.0, BSD-2-Clause and 3-Clause, ISC,
MPL-2.0, EPL-2.0, Unlicense, CC0-1.0, CC-BY, CC-BY-SA and CC-BY-NC 4.0; others are a parameter.

Defined results: null and empty texts, and texts of fewer than five
words, match nothing; repeated rows of one doc_id count as one; a very long text is one row's array of shingles, 8 bytes a
word; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 16, 0.8

#: Public license notices and texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def step(s: int) -> int:
    return max(1, s // 2)


def words_of(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles_of(words: Column) -> Column:
    last = F.size(words) - (SHINGLE - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j - 1) for j in range(SHINGLE)]))


def bands_of(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def templates(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(template, license, shingles, s, bands) of each template; those of fewer than five words are left out."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "template int, license string, text string")
    rows = rows.select("template", "license", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("shingles"))
    return rows.select("*", F.size("shingles").alias("s"), bands_of(F.col("shingles")).alias("bands")).where("s > 0")


def scan(docs: DataFrame, known: list[tuple[str, str]] = TEMPLATES, *, containment: float = CONTAINMENT) -> DataFrame:
    """The licenses whose templates docs (doc_id, text) hold at the containment or more."""
    spark = docs.sparkSession
    found = templates(spark, known).collect()  # as many rows as the fixed list
    if not found:
        return spark.createDataFrame([], "doc_id long, license string, containment double, start_word long")
    wanted = sorted({h for r in found for h in r["shingles"]})
    sizes = sorted({r["s"] for r in found})
    rows = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", shingles_of(F.col("words")).alias("row"))
    hits = F.filter(F.transform("row", lambda h, i: F.when(h.isin(wanted), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    rows = rows.select("doc_id", "row", hits.alias("hits"))

    def windows(s: int) -> Column:
        t = step(s)
        covering = F.transform("hits", lambda p: F.sequence(F.greatest(F.lit(0), F.floor((p - (s + t)) / t).cast("int") + 1), F.floor(p / t).cast("int")))
        return F.transform(F.array_distinct(F.flatten(covering)), lambda k: F.struct(F.lit(s).alias("s"), (k * t).alias("start")))

    placed = rows.select("doc_id", "row", F.explode_outer(F.flatten(F.array(*map(windows, sizes)))).alias("w")).where("w is not null")
    length = F.col("w.s") + F.greatest(F.lit(1), F.floor(F.col("w.s") / 2).cast("int"))
    seen = placed.select("doc_id", F.col("w.s").alias("s"), F.col("w.start").alias("start"), F.array_distinct(F.slice("row", F.col("w.start") + 1, length)).alias("window"))
    known_bands = spark.createDataFrame([(r["s"], b, v, r["template"]) for r in found for b, v in enumerate(r["bands"])], "s int, band int, least long, template int")
    known_sets = spark.createDataFrame([(r["template"], r["license"], r["shingles"]) for r in found], "template int, license string, shingles array<long>")
    banded = seen.select("*", F.posexplode_outer(bands_of(F.col("window"))).alias("band", "least"))
    met = banded.join(F.broadcast(known_bands), ["s", "band", "least"]).join(F.broadcast(known_sets), "template")
    share = F.size(F.array_intersect("window", "shingles")) / F.col("s")
    sure = met.select("doc_id", "license", "start", "s", share.alias("share")).where(F.col("share") >= containment)
    best = sure.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("share")).alias("less"), (-F.col("s")).alias("size"), "start", "s", "license")).alias("best"))
    # a document has at most one for each license of the list
    best = best.groupBy("doc_id").agg(F.collect_list("best").alias("all"))
    end = lambda x: x["start"] + x["s"] + F.greatest(F.lit(1), F.floor(x["s"] / 2))
    better = lambda y, x: (y["start"] < end(x)) & (x["start"] < end(y)) & ((y["less"] < x["less"]) | (y["less"] == x["less"]) & (y["s"] > x["s"]))
    kept = best.select("doc_id", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: better(y, x)))).alias("best"))
    return kept.select("doc_id", "best.license", (-F.col("best.less")).alias("containment"), F.col("best.start").cast("long").alias("start_word"))


def oracle(known: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for scan: every window of every document against every template."""
    rows = ", ".join(f"({i}, '{k}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (k, t) in enumerate(known))
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))"
    return f"""
WITH t AS (SELECT i, license, list_distinct({grams}) AS g FROM (SELECT i, license, {words} AS w FROM (VALUES {rows}) AS v(i, license, text)) WHERE len(w) > 4),
d AS (SELECT doc_id, {grams} AS r FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 4),
x AS (SELECT DISTINCT len(g) AS s, greatest(1, len(g) // 2) AS p FROM t),
own AS (SELECT DISTINCT unnest(g) AS h FROM t),
near AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(r) AS h FROM d) JOIN own USING (h)),
win AS (SELECT doc_id, s, k * p AS start, r[k * p + 1 : k * p + s + p] AS win FROM (SELECT doc_id, r, s, p, unnest(range(0, (len(r) - 1) // p + 1)) AS k FROM d JOIN near USING (doc_id), x)),
m AS (SELECT doc_id, license, start, s, len(list_intersect(list_distinct(win), g)) / CAST(s AS DOUBLE) AS share FROM win JOIN t ON len(t.g) = win.s),
b AS (SELECT doc_id, license, max(share) AS share, arg_min(start, (-share, -s, start)) AS start, arg_min(s, (-share, -s, start)) AS s FROM m WHERE share >= {containment} GROUP BY 1, 2),
e AS (SELECT *, start + s + greatest(1, s // 2) AS stop FROM b)
SELECT doc_id, license, share AS containment, CAST(start AS BIGINT) AS start_word FROM e AS x
WHERE NOT EXISTS (SELECT 1 FROM e AS y WHERE y.doc_id = x.doc_id AND y.start < x.stop AND x.start < y.stop AND (y.share > x.share OR y.share = x.share AND y.s > x.s))"""
