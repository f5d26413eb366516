"""Licence scans (operator 2); DataFrame functions only.

A document's segments (lines, paragraphs and the whole text) are normalised to words and compared with licence
templates by the Dice coefficient of their sets of word bigrams. A coefficient of t or more needs set sizes within
t / (2 - t) and (2 - t) / t of each other, so each template meets only segments of sizes within its bounds: that is an
equi join of a segment's size with the sizes a template admits, a table that the templates alone fix.

Defined cases: null and empty texts and segments of one word match nothing; a licence found in several segments counts
once with its best coefficient; ties go to the name that sorts first; repeated rows are separate rows of the result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, notices and texts of public licences.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Letters of a segment whose distinct words are counted before those of the whole.
_START = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(name, sorted distinct bigrams) of each template."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            w = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def _bounds(size: int, percent: int) -> range:
    """The sizes with which a coefficient of percent / 100 is possible."""
    return range(-(-size * percent // (200 - percent)), size * (200 - percent) // percent + 1)


def _admitted(spark: SparkSession, templates: list[tuple[str, list[str]]], percent: int) -> DataFrame:
    rows = [(name, grams, len(grams), n) for name, grams in templates for n in _bounds(len(grams), percent)]
    return spark.createDataFrame(rows, "license string, template array<string>, n_template int, n int")


def license_matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_licenses, license_ids (sorted, comma-joined), best_license, best_score (null if none)."""
    known = template_rows(templates)
    admitted = _admitted(docs.sparkSession, known, percent)
    least, most = min(min(_bounds(len(g), percent)) for _, g in known), max(max(_bounds(len(g), percent)) for _, g in known)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER).alias("body"))
    # Every letter is normalised once, line by line; paragraphs and the whole text are made of the normalised lines.
    raw = base.select("id", "th", F.split("body", "\n").alias("raw")).withColumn("lines", F.transform("raw", lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))))
    filled = lambda c: F.array_join(F.filter(c, lambda x: x != ""), " ")
    marked = filled(F.zip_with("raw", "lines", lambda x, n: F.when(F.btrim(x, F.lit(" \t\r")) == "", "\n").otherwise(n)))
    parts = F.array_distinct(F.concat("lines", F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), F.array(filled(F.col("lines")))))
    lines = raw.select("id", "th", F.explode_outer(parts).alias("line"))
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))  # bigrams, repeated ones too
    # n distinct bigrams have at most n + 1 distinct words; the start of a segment may end in part of one.
    start = F.size(F.array_distinct(F.split(F.substring("line", 1, _START), " "))) <= most + 2
    short = lines.where((count >= least) & ((count <= most) | start)).select("id", "th", F.split("line", " ").alias("w"))
    short = short.where(F.size(F.array_distinct("w")) <= most + 1)
    grams = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    short = short.select("id", "th", grams.alias("grams")).withColumn("n", F.size("grams"))
    both = short.join(F.broadcast(admitted), "n")  # a table that the templates fix
    common = F.size(F.array_intersect("grams", "template"))
    hits = both.select("id", "th", "license", common.alias("c"), (F.col("n") + F.col("n_template")).alias("s")).where(200 * F.col("c") >= percent * F.col("s"))
    hits = hits.groupBy("id", "th", "license").agg(F.max(2 * F.col("c") / F.col("s")).alias("score"))
    best = hits.groupBy("id", "th").agg(F.count("*").alias("n_licenses"), F.concat_ws(",", F.sort_array(F.collect_list("license"))).alias("license_ids"), F.min(F.struct((-F.col("score")).alias("x"), "license")).alias("b"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    out = rows.join(best, rows["id"].eqNullSafe(best["id"]) & rows["th"].eqNullSafe(best["th"]), "left")
    return out.select(rows["id"].alias(id_col), F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"), F.coalesce("license_ids", F.lit("")).alias("license_ids"), F.col("b.license").alias("best_license"), F.round(-F.col("b.x"), 6).alias("best_score"))


def op2(spark, sf_dir) -> DataFrame:
    from .common import table

    return license_matches(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ",\n".join("('" + name + "', [" + ", ".join(f"'{g}'" for g in grams) + "])" for name, grams in template_rows())
    return rf"""
WITH t(license, template) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents),
l AS (SELECT r, trim(regexp_replace(unnest(list_concat(string_split(body, chr(10)), regexp_split_to_array(body, '\n[ \t\r]*\n'), [body])), '[^a-z0-9]+', ' ', 'g')) AS line FROM d),
w AS (SELECT r, string_split(line, ' ') AS w FROM l),
g AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) >= 2),
s AS (SELECT r, license, len(list_intersect(grams, template)) AS c, len(grams) + len(template) AS s FROM g, t),
h AS (SELECT r, license, max(2.0 * c / s) AS score FROM s WHERE 200 * c >= 80 * s GROUP BY r, license),
b AS (SELECT r, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS license_ids, arg_min(license, (-score, license)) AS best_license, max(score) AS best_score FROM h GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(license_ids, '') AS license_ids, best_license, round(best_score, 6) AS best_score
FROM d LEFT JOIN b USING (r)
"""


SQL = _sql()
