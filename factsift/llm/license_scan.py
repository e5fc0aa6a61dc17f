"""License notices by MinHash bands over overlapping windows (operator 9).

DataFrame and SQL functions only. Texts are cut into lower-case words of a-z
and 0-9, and every ``STRIDE`` words a window of ``STRIDE`` five-word shingles
starts, so any five words lie whole in some window. Each window has ``BANDS``
one-row MinHash bands; a band equal to one of a template's windows retrieves
the template. The templates are fixed, so their band table (and its broadcast)
has a fixed size. A retrieved template matches a text when the text holds at
least ``CONTAINMENT`` of the template's shingles, counted exactly.

Bands: the least similar case is a template of one shingle in a window of
``STRIDE``, similarity 1 / STRIDE a band; ``BANDS`` is chosen so that it is
missed with a probability below ``MISS``. Longer templates share more shingles
or fill a window, which is then equal to one of the template's.

Windows stream from the scan through the broadcast join; only retrieved
(text, template) pairs are shuffled, combined by text first. Null, empty and
short texts (under five words) hold no license; null and repeated doc_ids are
rows like others, each with its own result; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factsift.llm import common

SHINGLE = 5
STRIDE = 4
MISS = 1e-4
BANDS = math.ceil(math.log(MISS) / math.log(1 - 1 / STRIDE))
CONTAINMENT = 0.8

# ---- fixed values: license notices (license, text); only those of one family are
# held to be one notice where they match the same words (the license up to its first digit or "-") ---------------------------------
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingle_at(words: Column, i: Column) -> Column:
    """The hash of the five words from ``i``; null if there aren't as many."""
    return F.when(i + SHINGLE <= F.size(words), F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def shingles(words: Column) -> Column:
    n = F.size(words) - SHINGLE
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: shingle_at(words, i))))


def _windows(rows: DataFrame, stride: int, start: Column) -> DataFrame:
    """``rows`` (with ``words``) by window and band: ``band`` is the least hash of
    the window's shingles by that band's function."""
    last = F.size("words") - SHINGLE
    at = rows.select("*", F.explode(F.when(last >= 0, F.sequence(start, last, F.lit(stride)))).alias("at"))
    window = F.struct(*[F.when(F.col("at") + j >= 0, shingle_at(F.col("words"), F.col("at") + j)).alias(f"h{j}") for j in range(STRIDE)])
    # generators pass their output on as it is, so nothing below hashes words again
    at = at.select(*rows.columns, F.explode(F.array(window)).alias("w")).select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"))
    h = [f"w.h{j}" for j in range(STRIDE)]
    band = F.least(*[F.xxhash64(F.coalesce(h[j], *(h[:j] + h[j + 1:])), F.col("b")) for j in range(STRIDE)])
    return at.select(*rows.columns, band.alias("band"))


def templates(spark: SparkSession) -> DataFrame:
    """``template, license, words``, from literals."""
    rows = ", ".join(f"({i}, '{license}', '{' '.join(template_words(text))}')" for i, (license, text) in enumerate(TEMPLATES))
    return spark.sql(f"SELECT template, license, split(words, ' ') AS words FROM VALUES {rows} AS t(template, license, words)")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, template, license, family, matched, containment`` of every match."""
    known = templates(docs.sparkSession)
    # windows of a template at every word, also those that overlap its start
    band_table = _windows(known.select("template", "words"), 1, F.lit(1 - STRIDE)).select("template", "band").distinct()
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       words_of(F.coalesce(text, F.lit(""))).alias("words"))
    retrieved = (_windows(rows, STRIDE, F.lit(0)).join(F.broadcast(band_table), "band")
                 .groupBy("doc_id", "text_key", "template").agg(F.first("words").alias("words")))
    needles = known.select("template", "license", shingles(F.col("words")).alias("needle"))
    matched = F.array_intersect("needle", shingles(F.col("words"))).alias("matched")
    return (retrieved.join(F.broadcast(needles), "template")
            .select("doc_id", "text_key", "template", "license", "needle", matched)
            .select("doc_id", "text_key", "template", "license", family(F.col("license")).alias("family"), "matched",
                    (F.size("matched") / F.size("needle")).alias("containment"))
            .where(F.col("containment") >= CONTAINMENT))


def family(license: Column) -> Column:
    return F.substring_index(license, "-", 1)


def best(found: DataFrame) -> DataFrame:
    """A text's matches without those that a more contained one of the family
    explains: all shingles they match are matched by it, so at the same places
    (notices that differ in a version contain most of each other)."""
    # as many as there are templates at most
    family = Window.partitionBy("doc_id", "text_key", "family")
    explained = F.exists("others", lambda o: (o["containment"] > F.col("containment"))
                         & (F.size(F.array_except("matched", o["matched"])) == 0))
    return (found.withColumn("others", F.collect_list(F.struct("containment", "matched")).over(family))
            .where(~explained).drop("others", "matched"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_licenses, licenses`` (names in order, comma-joined), ``containment`` (the best)."""
    found = (best(scan(docs)).groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("containment").alias("containment"))
             .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "names", "containment"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return (rows.join(found, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
            .select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
                    F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
                    F.round(F.coalesce("containment", F.lit(0.0)), 6).alias("containment")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the licenses of every document."""
    return report(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{' '.join(template_words(text))}')" for i, (name, text) in enumerate(TEMPLATES))

    def cut(words: str) -> str:
        return (f"list_distinct([array_to_string({words}[i:i + {SHINGLE - 1}], ' ') "
                f"for i in range(1, greatest(len({words}) - {SHINGLE - 2}, 1))])")

    return f"""
WITH t(template, license, words) AS (VALUES {rows}),
needles AS (SELECT template, license, unnest({cut("string_split(words, ' ')")}) AS shingle FROM t),
sizes AS (SELECT template, count(*) AS n FROM needles GROUP BY template),
d AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') if x <> ''] AS words FROM documents),
s AS (SELECT doc_id, unnest({cut("words")}) AS shingle FROM d),
hits AS (SELECT doc_id, template, license, count(*) AS k, list(shingle) AS matched FROM s JOIN needles USING (shingle) GROUP BY ALL),
all_good AS (SELECT doc_id, license, split_part(license, '-', 1) AS family, k / n AS containment, matched
             FROM hits JOIN sizes USING (template) WHERE k >= {CONTAINMENT} * n),
good AS (SELECT * FROM all_good a WHERE NOT EXISTS (
             SELECT 1 FROM all_good o WHERE o.doc_id = a.doc_id AND o.family = a.family AND o.containment > a.containment
                                        AND list_has_all(o.matched, a.matched))),
per AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
               round(max(containment), 6) AS containment FROM good GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(containment, 0.0) AS containment
FROM documents LEFT JOIN per USING (doc_id)
"""


SQL = _sql()
