"""Licences of files: TF-IDF cosine of their sentences with templates, and inheritance from the nearest folder."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.llm.common import cut, text_of

# Sentences by which public licences are named or begin.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted"),
    ("proprietary", "All rights reserved"),
)
THRESHOLD = 0.7
FILE_SHARE = 0.5  # a file is a licence file if so much of its words is in sentences of licences
_BREAKS = r"(?:[^\p{L}0-9.+-]|[.](?![0-9])|(?<![\p{L}0-9])[.+-]+)+"
_SENTENCES = r"\n|(?<=[.!?])\s+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAKS), lambda w: w != "")


def _templates(spark: SparkSession) -> list[tuple[int, str, Counter]]:
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(t).alias("t")) for i, (name, t) in enumerate(TEMPLATES))))
    got = spark.range(1).select(rows.alias("x")).select("x.i", "x.name", words_of(F.col("x.t")).alias("words")).collect()
    return [(r.i, r.name, Counter(r.words)) for r in sorted(got)]


def _anchors(vectors: dict[int, dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a sentence must hold one to reach the threshold with any template.

    Without them, its cosine with a template is at most the length of the template's other terms (Cauchy and Schwarz).
    Terms are taken from the rarest on, for those templates that still reach the threshold without.
    """
    taken: set[str] = set()
    for term in sorted(idf, key=lambda x: (-idf[x], x)):
        rest = [v for v in vectors.values() if math.sqrt(sum(w * w for t, w in v.items() if t not in taken)) >= threshold * 0.999]
        if not rest:
            break
        if any(term in v for v in rest):
            taken.add(term)
    return sorted(taken)


def sentence_licences(files: DataFrame, threshold: float, key: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``key, words`` of all files, and ``key, licence, score, words`` of each sentence that reaches
    the threshold with a template, with the licence of the best one, of equals the first by name.

    Weights are term frequency times ln((files + 1) / (files with the term + 1)) + 1, counted over all files for
    the terms of templates; other terms of a sentence count with the mean of these.
    """
    spark = files.sparkSession
    templates = _templates(spark)
    vocabulary = sorted({t for _, _, c in templates for t in c})
    literal = F.array(*map(F.lit, vocabulary))
    split = files.select(key, words_of(F.col("text")).alias("w"))
    terms = cut(split.select(key, F.size("w").alias("words"), F.array_intersect("w", literal).alias("terms")), "license-terms")
    n = terms.count()
    counted = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = {r.term: r.n for r in counted.collect()}  # no more rows than the templates have terms
    idf = {t: math.log((n + 1) / (known.get(t, 0) + 1)) + 1 for t in vocabulary}
    vectors = {}
    for i, _, counts in templates:
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        vectors[i] = {t: c * idf[t] / length for t, c in counts.items()}
    needed = _anchors(vectors, idf, threshold)
    anchors = F.array(*map(F.lit, needed)).cast("array<string>")
    other = sum(idf.values()) / len(idf)

    weights = F.create_map(*(F.lit(x) for t in vocabulary for x in (t, idf[t])))
    entries = [F.struct(F.lit(t).alias("term"), F.lit(name).alias("licence"), F.lit(i).alias("template"), F.lit(vectors[i][t]).alias("weight"), F.lit(idf[t]).alias("idf"))
               for i, name, c in templates for t in sorted(c)]
    table = spark.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")

    marked = files.filter(F.lower("text").rlike("|".join(re.escape(a) for a in needed) or "(?!)"))
    sentences = marked.select(key, F.posexplode(F.split("text", _SENTENCES)).alias("at", "sentence"))
    sentences = sentences.select(key, F.xxhash64("at", "sentence").alias("pos"), words_of(F.col("sentence")).alias("w")).filter(F.arrays_overlap("w", anchors))
    sentences = sentences.withColumn("n_words", F.size("w"))
    counts = sentences.select(key, "pos", "n_words", F.explode("w").alias("term")).groupBy(key, "pos", "n_words", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    lengths = counts.groupBy(key, "pos", "n_words").agg(
        F.sqrt(F.sum((F.col("tf") * F.coalesce(weights[F.col("term")], F.lit(other))) ** 2)).alias("length")
    )
    dots = counts.join(table, "term").groupBy(key, "pos", "template", "licence").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot")
    )
    scored = dots.join(lengths, [key, "pos"]).select(
        key, "pos", "n_words", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score")
    )
    best = F.min(F.struct((-F.col("score")).alias("less"), "licence"))
    found = scored.filter(F.col("score") >= threshold).groupBy(key, "pos", "n_words").agg(best.alias("best"))
    found = found.select(key, F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"), F.col("n_words").alias("words"))
    return terms.select(key, "words"), cut(found, "license-sentences")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, with their depths; the root has depth 0 and the empty name."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")),
    )


def scan(files: DataFrame, threshold: float = THRESHOLD, path: str = "path", text: str = "text") -> DataFrame:
    """``path, licence, score, via, folder`` for each path of ``files``.

    ``via`` is ``file`` if half of the words are in sentences of licences, else ``header`` if any is; then the
    licence is that of the best sentence, of equals the first by name. Other files inherit (``via`` is
    ``folder``) from the licence files of the nearest folder above them, its own first: the best score there, of equals
    the first path. Else licence, score and folder are null and ``via`` is ``none``. Rows of one path are one file, with
    the words of all; a null path is a file without a folder that inherits nothing; null and empty texts
    have no sentences.
    """
    rows = files.select(F.col(path).cast("string").alias("path"), text_of(text).alias("text"))
    words, found = sentence_licences(rows, threshold, "path")
    best = F.min(F.struct((-F.col("score")).alias("less"), "licence"))
    own = found.groupBy("path").agg(best.alias("best"), F.sum("words").alias("in_licences"))
    sizes = words.groupBy("path").agg(F.sum("words").alias("words"))
    sized = sizes.join(own, "path", "left").select(
        "path",
        F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("").alias("folder"),
        F.col("best.licence").alias("licence"),
        (-F.col("best.less")).alias("score"),
        (F.col("in_licences") >= F.col("words") * FILE_SHARE).alias("is_file"),
    )
    sized = cut(sized, "licensed-files")
    first = F.min(F.struct((-F.col("score")).alias("less"), "path", "licence"))
    given = sized.filter("is_file").groupBy("folder").agg(first.alias("first"))
    given = cut(given.select(F.col("folder").alias("from_folder"), "first"), "licence-folders")
    above = sized.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
    nearest = (
        above.select("folder", F.col("a.depth").alias("depth"), F.col("a.folder").alias("from_folder"))
        .join(given, "from_folder")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "from_folder", "first")).alias("near"))
    )
    nearest = cut(nearest.select("folder", "near.from_folder", "near.first"), "nearest-licences")
    has_own = F.col("licence").isNotNull()
    inherits = ~has_own & F.col("path").isNotNull() & F.col("from_folder").isNotNull()
    return sized.join(nearest, "folder", "left").select(
        "path",
        F.when(has_own, F.col("licence")).when(inherits, F.col("first.licence")).alias("licence"),
        F.when(has_own, F.col("score")).when(inherits, -F.col("first.less")).alias("score"),
        F.when(has_own & F.col("is_file"), "file").when(has_own, "header").when(inherits, "folder").otherwise("none").alias("via"),
        F.when(inherits, F.col("from_folder")).alias("folder"),
    )
