"""Licence scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance.

Headers are the sentences of a text that speak of a licence (``LIKELY``); all sentences of all
whole texts are looked at. A header and each template are sparse vectors of words weighted by
term frequency and inverse document frequency; the frequencies of the template words are counted
over all texts, a word of no template counts as one that no text has. The licence of a document
is the template of largest cosine, from ``MIN_COSINE`` on (ties: the first name).

A file is a licence file if its name says so or at least half of its characters are headers. Its
licence holds for its directory. A document without a header inherits the licence of the nearest
directory above it that has one: the ancestors of each directory are joined with the directories
of licence files, and the longest path wins. That join has one row per directory and ancestor, not
per document; only the last join, on the directory, has a row per document.

Null and empty texts have no header. Rows without doc_id can only inherit; rows that share a
doc_id share their headers. Documents without a path have the directory ''.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.sources.staging import stage

# Phrases of public licences by SPDX name.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Copyright. All rights reserved"),
)
LIKELY = r"(?i:licen[cs]e|spdx|copyright|rights reserved|public domain|creative commons|permission is hereby|redistribution and use)"
SENTENCE_END = r"\n|[.!?;]\s+"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.]|$)"
MIN_COSINE, MIN_SHARE = 0.5, 0.5
WORD_GAP = r"[^a-z0-9]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, text.lower()) if w]


def _vocabulary() -> list[str]:
    return sorted({w for _, text in TEMPLATES for w in template_words(text)})


def _summed(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def word_frequencies(texts: DataFrame) -> DataFrame:
    """term, docs for the words of the templates, over all texts; the null term counts texts."""
    wanted = F.array(*map(F.lit, _vocabulary()))
    found = F.array_intersect(_words(F.col("text")), wanted)
    return texts.select(F.explode(F.concat(found, F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(
        F.count("*").alias("docs"))


def headers(texts: DataFrame) -> DataFrame:
    """doc_id, part (number of the sentence), header, of all sentences that speak of a licence."""
    sentences = F.transform(F.split("text", SENTENCE_END, -1), lambda s, i: F.struct(i.alias("part"), s.alias("header")))
    return texts.where(F.rlike("text", F.lit(LIKELY))).select(
        "doc_id", F.explode(F.filter(sentences, lambda s: F.rlike(s["header"], F.lit(LIKELY)))).alias("s")).select(
        "doc_id", "s.part", "s.header")


def scored_headers(texts: DataFrame) -> DataFrame:
    """doc_id, licence, cosine, header: the best header of each document that has one."""
    counts = {r["term"]: r["docs"] for r in word_frequencies(texts).collect()}  # one row per template word
    total = counts.pop(None, 0)
    vocabulary = _vocabulary()
    idf = F.array(*[F.log(F.lit((total + 1) / (counts.get(w, 0) + 1))) + 1 for w in vocabulary])
    unknown = F.log(F.lit(float(total + 1))) + 1
    names = F.array(*map(F.lit, vocabulary))
    found = headers(texts).where("doc_id IS NOT NULL")
    words = found.select("doc_id", "part", "header", F.explode(_words(F.col("header"))).alias("term"))
    weighed = words.groupBy("doc_id", "part", "header", "term").count().withColumn("at", F.array_position(names, F.col("term"))).withColumn(
        "weight", F.col("count") * F.when(F.col("at") > 0, F.element_at(idf, F.greatest("at", F.lit(1)).cast("int"))).otherwise(unknown))
    vectors = weighed.groupBy("doc_id", "part", "header").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.map_from_entries(F.collect_list(F.when(F.col("at") > 0, F.struct("term", "weight")))).alias("weights"))
    scores = []
    for licence, text in TEMPLATES:
        terms = template_words(text)
        weights = {w: terms.count(w) * F.element_at(idf, vocabulary.index(w) + 1) for w in sorted(set(terms))}
        norm = F.sqrt(_summed([x * x for x in weights.values()]))
        dot = _summed([x * F.coalesce(F.try_element_at("weights", F.lit(w)), F.lit(0.0)) for w, x in weights.items()])
        scores.append(F.struct(F.round(dot / (norm * F.col("norm")), 9).alias("cosine"), F.lit(licence).alias("licence")))
    best = F.array_sort(F.array(*scores), lambda a, b: F.when(a["cosine"] != b["cosine"], F.signum(b["cosine"] - a["cosine"]).cast("int")).when(
        a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0))[0]
    rated = vectors.select("doc_id", "part", "header", best.alias("best")).where(F.col("best.cosine") >= MIN_COSINE)
    # The largest cosine, then the first name, then the first sentence of it.
    order = F.struct(-F.col("best.cosine"), F.col("best.licence"), "part")
    return rated.groupBy("doc_id").agg(
        F.min_by("best", order).alias("best"), F.min_by("header", order).alias("header"),
        F.sum(F.length("header")).alias("header_chars")).select(
        "doc_id", "best.licence", "best.cosine", "header", "header_chars")


def _ancestors(folder: Column) -> Column:
    """A directory and all above it, '' last."""
    steps = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, path, text): doc_id, licence, cosine (0 if inherited),
    origin (header, inherited or none), licence_dir (where it is inherited from)."""
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.array_join(F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda s: s != ""), "/").alias("folder"),
        F.regexp_extract(path, "[^/]*$", 0).alias("name"))
    own = stage(scored_headers(given), "headers")
    places = given.select("doc_id", "folder", "name", F.length("text").alias("chars"))
    files = places.join(own, "doc_id").where(
        F.rlike("name", F.lit(FILE_NAME)) | (F.col("header_chars") >= MIN_SHARE * F.col("chars")))
    by_folder = files.groupBy("folder").agg(F.min_by("licence", F.struct(-F.col("cosine"), "licence", "doc_id")).alias("licence"))
    above = places.select("folder").distinct().select("folder", F.explode(_ancestors(F.col("folder"))).alias("licence_dir"))
    nearest = (
        above.join(by_folder.withColumnRenamed("folder", "licence_dir"), "licence_dir").groupBy("folder").agg(
            F.max_by(F.struct("licence", "licence_dir"), F.length("licence_dir")).alias("above")))
    return places.select("doc_id", "folder").join(own.drop("header", "header_chars"), "doc_id", "left").join(nearest, "folder", "left").select(
        "doc_id", F.coalesce("licence", "above.licence").alias("licence"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.when(F.col("licence").isNotNull(), "header").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("above.licence_dir")).alias("licence_dir"))
