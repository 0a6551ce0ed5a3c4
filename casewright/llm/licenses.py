"""License scans, from built-in functions only.

Passages of a text (sentences of its lines, sentences and whole of its paragraphs with comment marks
removed and wrapped lines joined, and all of a licence file) are compared with templates by sparse TF-IDF
cosine: different passages are tokenised once, joined with the template weights term by term, and keep
their best template. A document is under the license of its best passage; one without any inherits the
license of the licence file in its nearest ancestor directory, found by joining the distinct directories'
ancestor paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let
from ..operators.scratch import Scratch
from .literals import literal_rows

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
# Passages by which licenses are granted or named.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0", "GNU Affero General Public License Version 3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", _BSD),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright under CC0"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0", "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MIT": (
        "Released under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"),
    "Proprietary": ("All rights reserved",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: A line that stands beside any license says little; it counts only where nothing else is found.
WEAK = frozenset({"Proprietary"})
#: Clauses that turn a license into a narrower one win over the license they are added to.
NARROWER = frozenset({"BSD-3-Clause"})
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.6
#: Parts over which the files of one passage are dealt.
PARTS = 32
SPACE = r"[\x20\x09-\x0D]"
#: The start of a line with its indentation and comment mark.
MARK = r"(\A|\n)[\x20\x09\x0B-\x0D]*(?:[#;%*/!|]+|<!--|--+)?[\x20\x09\x0B-\x0D]*"
#: Words of no weight, and words that stand for a template only where no other would.
STOP = frozenset("a above all an and any are as at be can do either following for from has have in including into is it its may met not of or other set so that the this to use used was which who whom with without you your".split())
_EVERYDAY = frozenset("1.0 2 2.0 29 3 3.0 4.0 1991 2004 2007 by code copy distribute except extent file files form forms free general holder january june later law name names neither nor option person persons possible prior program public publish published source specific subject terms under v version work written".split())


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP]


def template_weights(templates: Mapping[str, Sequence[str]]) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """((template, term, unit weight) rows, inverse document frequency by term, that of unknown terms).

    Templates are numbered within their license, as ``MIT#0``.
    """
    counts = {f"{name}#{k}": Counter(terms_of(x)) for name, variants in templates.items() for k, x in enumerate(variants)}
    present = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(present.items())}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(counts)) + 1


def cues(templates: Mapping[str, Sequence[str]], threshold: float = THRESHOLD) -> list[str]:
    """Terms of which every passage that reaches the threshold holds one at least.

    A cosine is at most the norm of the template's weights on the passage's terms. For each template so
    many of its terms are cues, everyday words last, that the others' norm stays below the threshold.
    """
    chosen: set[str] = set()
    rows = template_weights(templates)[0]
    for template in dict.fromkeys(t for t, _, _ in rows):
        weights = {term: w * w for t, term, w in rows if t == template}
        rest = sum(w for term, w in weights.items() if term not in chosen)
        for term in sorted(weights, key=lambda x: (x in _EVERYDAY, -weights[x], x)):
            if rest < 0.99 * threshold**2:
                break
            if term not in chosen:
                chosen.add(term)
                rest -= weights[term]
    return sorted(chosen)


def pieces(text: Column) -> Column:
    """The runs of letters and digits of a text; a term begins with one and may hold more."""
    return F.split(F.lower(text), "[^a-z0-9]+", -1)


def may_match(templates: Mapping[str, Sequence[str]], threshold: float = THRESHOLD):
    """A test of passages that fails only for those whose cosine to every template is below the threshold.

    The square of a cosine is at most the share that a passage's known terms have in its squared norm:
    ``known`` terms weigh at most ``(known * largest idf) ** 2``, ``others`` different ones at least
    ``others * unknown idf ** 2``.
    """
    _, idf, unknown = template_weights(templates)
    known = sorted({x for t in idf for x in t.split(".")})
    passed = sorted({*known, *STOP, ""})
    ratio = threshold**2 / (1 - threshold**2) * unknown**2 / max(idf.values()) ** 2 * 0.99

    def test(passage: Column) -> Column:
        def of(words: Column) -> Column:
            n = F.size(F.filter(words, lambda x: x.isin(*known)))
            others = F.size(F.array_distinct(F.filter(words, lambda x: ~x.isin(*passed) & x.rlike("[a-z]"))))
            return (n > 0) & (n * n >= others * F.lit(ratio))

        return let(pieces(passage), of)

    return test


def _trimmed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def passages(text: Column, name: Column, test) -> Column:
    """The different passages of a text that pass ``test``, white space made single."""
    sentences = lambda xs: F.flatten(F.transform(xs, lambda x: F.split(x, rf"(?<=[.!?]){SPACE}+", -1)))
    plain = F.regexp_replace(text, MARK, "$1")
    paragraphs = F.transform(F.split(plain, rf"\n{SPACE}*\n", -1), _trimmed)
    whole = F.when(name.rlike(LICENSE_FILE), F.array(_trimmed(plain))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.transform(sentences(F.split(text, "\n", -1)), _trimmed), sentences(paragraphs), paragraphs, whole)
    return F.filter(F.array_distinct(every), test)


def best_templates(spark: SparkSession, found: DataFrame, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(passage, rank, license, score) of the best template for every different passage of ``found``.

    Passages travel as their digests. Narrower licenses rank above, weak ones below the others.
    """
    rows, idf, unknown = template_weights(templates)
    weights = literal_rows(spark, "template string, term string, weight double", rows)
    known = literal_rows(spark, "term string, idf double", sorted(idf.items()))
    terms = found.groupBy("passage").agg(F.any_value("words").alias("words")).select("passage", F.explode(F.regexp_extract_all(F.lower("words"), F.lit(TERM), F.lit(0))).alias("term")).where(~F.col("term").isin(*sorted(STOP)))
    tf = terms.groupBy("passage", "term").agg(F.count("*").alias("tf"))
    # both tables have one row a term of the fixed templates
    tf = tf.join(F.broadcast(known), "term", "left").select("passage", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("x"))
    norms = tf.groupBy("passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy("passage", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "passage").select("passage", F.split("template", "#")[0].alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= THRESHOLD)
    rank = F.when(F.col("license").isin(*WEAK), 0).when(F.col("license").isin(*NARROWER), 2).otherwise(1)
    return scored.groupBy("passage").agg(F.max(F.struct(rank.alias("rank"), "score", "license")).alias("b")).select("passage", "b.rank", "b.license", "b.score")


def scan(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", templates: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row (file_id, path, license, score, origin) per input row.

    ``origin`` is ``own`` if a passage of the text reaches the threshold, ``inherited`` if the licence
    file (``LICENSE``, ``COPYING`` and the like) of the nearest directory above does, else ``none`` with
    null license and score. Narrower licenses win over those they narrow, any over ``All rights
    reserved``; then the score decides, ties go to the alphabetically last license; a directory with
    several licence files takes the best one. Null texts and paths count as empty; an empty path has no
    directory but the root. Texts are scanned whole, however long. A null id stays null, repeated rows
    stay repeated, other columns are ignored, an empty table gives no rows.
    """
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    key = ["file_id", "path", "print"]
    held = F.array(*(F.lit(x) for x in sorted({x.split(".")[0] for x in cues(templates)})))
    rows = files.select(F.col(file_id).alias("file_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text")).withColumn("name", F.regexp_extract("path", r"[^/]*$", 0))
    every = rows.groupBy(*key, "name").agg(F.count("*").alias("times"))
    found = rows.where(F.arrays_overlap(pieces(F.col("text")), held)).select(*key, F.explode(passages(F.col("text"), F.col("name"), may_match(templates))).alias("words")).select(*key, "words", F.md5("words").alias("passage"))
    found = Scratch(spark, "licenses").keep(found, "passages")  # few, and read three times
    best = best_templates(spark, found.select("passage", "words"), templates)
    # a passage may stand in very many files: its rows are dealt over parts, its one best template is copied to them
    dealt = found.select(*key, "passage", F.pmod(F.xxhash64(*key), F.lit(PARTS)).alias("part"))
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    own = dealt.join(best, ["passage", "part"]).groupBy(*key).agg(F.max(F.struct("rank", "score", "license")).alias("own"))
    every = every.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    null_safe = [every[k].eqNullSafe(own[k]) for k in key]
    marked = every.join(own, null_safe, "left").select(*(every[k] for k in key), every["times"], every["dir"], every["name"], own["own"])

    granted = marked.where(F.col("own").isNotNull() & F.col("name").rlike(LICENSE_FILE)).groupBy(F.col("dir").alias("above")).agg(F.max("own").alias("given"))
    dirs = marked.select("dir").distinct()
    labels = F.split("dir", "/", -1)
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "/")))
    lineage = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "above")).join(granted, "above")
    nearest = lineage.groupBy("dir").agg(F.max_by("given", "depth").alias("given"))
    out = marked.join(nearest, "dir", "left").withColumn("hit", F.coalesce("own", "given"))
    return out.select(
        "file_id", "path", F.col("hit.license").alias("license"), F.col("hit.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
