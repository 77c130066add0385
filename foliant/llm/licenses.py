"""Operator 1: licence scan, a trained paragraph classifier in DataFrame operations.

A paragraph ends at a blank line, at a line break after a sentence, and before a line that begins as a licence
declaration does; lines wrapped inside a sentence are one paragraph. A softmax regression over sparse word 1-3-grams,
trained here on templates and seeded variations of them among other words, gives a paragraph's probability for each
licence family and for none. Its temperature is calibrated on variations it was not trained on; a paragraph under
LEAST_PROBABILITY is unknown. A predicted family counts only if a template of that family confirms it: at least
CONFIRM of the template's 2-grams stand in the paragraph, or, for a paragraph of three 2-grams or more, of the
paragraph's in the template.

A regular expression finds the paragraphs that are worth a look, without loss: it asks for an anchor word or one of the
templates' 2-grams, from which one per template is left out where the rest still has to occur in every paragraph that
the template can confirm (gate_grams). Documents without such a place get their row without further work. The weights
and templates are literals of fixed size and are broadcast.

Result per row of docs: doc_id, families (sorted, comma-joined), n_licences (confirmed paragraphs), n_unknown
(paragraphs with an anchor word, predicted as a licence and confirmed by no template of it), probability (highest of a
confirmed paragraph).

Defined results: null and empty texts have no paragraphs; repeated rows get a row each; long texts are scanned
whole; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common

# Sentences by which licences are commonly declared.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Licensed under CC0 1.0.", "This work is dedicated to the public domain under the CC0 licence."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 2."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without the permission of the copyright holder.", "Copyright. All rights reserved.", "This software is proprietary and confidential; unauthorised copying is prohibited under copyright."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
}
#: Paragraphs that mention such words and declare no licence.
OTHERS = [
    "she lost her driving license on the way to the public library", "the committee will license new taxi drivers next spring", "a licence to fish is sold in the village", "copyright law was the subject of the lecture", "permission to enter was granted by the guard",
    "the public was free to use the garden under the terms of the gift", "he gave a copy of the letter to any person who asked", "version 3 of the program was released in may", "the general asked for a copy of the form", "apache is the name of several peoples",
    "the license plate was covered in mud", "poetic licence is a freedom of writers", "the file is part of the work", "distribution of food and water went on", "commons are land that all may use", "the domain was public", "under the bridge the water is cold",
]
NONE = "none"
FAMILIES = (NONE, *sorted(TEMPLATES))
#: Words that mention a licence; a paragraph without any may be confirmed, but is no unknown licence.
ANCHORS = ("license", "licensed", "licenses", "licence", "licences", "spdx", "copyright", "gnu", "gpl", "bsd", "cc0", "mozilla", "unlicense", "unencumbered", "permission", "redistribution", "proprietary")
#: 2-grams of the templates that prose has often, most often first.
PROSE_GRAMS = ("of the", "to the", "that the", "by the", "with the", "in the", "of this", "to this", "and or", "this is")
LEAST_PROBABILITY = 0.6
CONFIRM = 0.6
#: An n-gram has a weight if this many training paragraphs have it.
LEAST_SEEN = 4
SPLIT = "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def grams_of(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)}


def paragraph_break() -> str:
    """Where a paragraph ends, for Java's and Python's regular expressions."""
    openings = "|".join(sorted({text.split()[0].rstrip(".,").split("-")[0] for texts in TEMPLATES.values() for text in texts if text[0].isupper()}))
    return rf"\n[ \t\r]*\n|(?<=[.!?:])[ \t\r]*\n|\n(?=[ \t/*#>-]*(?:{openings})(?![A-Za-z]))"


def needed(n: int) -> int:
    """How many of n 2-grams confirm."""
    return int(np.ceil(CONFIRM * n - 1e-9))


def gate_grams() -> set[str]:
    """2-grams of the templates of which every paragraph that a template can confirm has at least one.

    A paragraph that holds needed(n) of a template's n 2-grams has one of any n - needed(n) + 1 of them; one that is
    confirmed by its own 2-grams has two of the template's at least. So one 2-gram of each template may be left out,
    if n - needed(n) >= 1; those are left out that prose has most."""
    own = [{g for g in grams_of(words_of(text), 2) if " " in g} for texts in TEMPLATES.values() for text in texts]
    free: set[str] = set()
    for gram in PROSE_GRAMS:
        if all(gram not in grams or (len(grams) > needed(len(grams)) and not free & grams) for grams in own):
            free.add(gram)
    return set().union(*own) - free


def gate() -> str:
    """A regular expression over lower-cased text: an anchor word or a 2-gram of gate_grams."""
    tree: dict[str, dict[str, set[str]]] = {}
    for gram in gate_grams():
        first, second = gram.split(" ")
        tree.setdefault(first[0], {}).setdefault(first, set()).add(second)
    for word in ANCHORS:
        tree.setdefault(word[0], {}).setdefault(word, set())
    letters = []
    for letter in sorted(tree):
        words = []
        for first, seconds in sorted(tree[letter].items()):
            words.append(first[1:] if first in ANCHORS else rf"{first[1:]}[^a-z0-9]+(?:{'|'.join(sorted(seconds))})")
        letters.append(f"{letter}(?:{'|'.join(words)})")
    return rf"(?<![a-z0-9])(?:{'|'.join(letters)})(?![a-z0-9])"


def variations(seed: int, each: int) -> list[tuple[list[str], int]]:
    """Templates with words lost and others around them, and paragraphs that are none."""
    rng = random.Random(seed)
    filler = words_of(" ".join(OTHERS)) + ["the", "of", "and", "in", "text", "page", "author", "year"]
    out = []
    for label, family in enumerate(FAMILIES):
        for text in OTHERS if family == NONE else TEMPLATES[family]:
            for k in range(each):
                words = words_of(text)
                if k:
                    # every third stands inside a longer paragraph
                    most = 40 if k % 3 == 0 else 6
                    words = [w for w in words if rng.random() > 0.06]
                    words = [rng.choice(filler) for _ in range(rng.randint(0, most))] + words + [rng.choice(filler) for _ in range(rng.randint(0, most))]
                    if family == NONE:
                        rng.shuffle(words)
                out.append((words, label))
    return out


@functools.cache
def trained(epochs: int = 300, rate: float = 0.3, shrink: float = 1e-4) -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of each n-gram per family, biases, and the calibrated inverse temperature."""
    train, held = variations(1, 12), variations(2, 6)
    often = Counter(g for words, _ in train for g in grams_of(words))
    names = {g: k for k, g in enumerate(sorted(g for g, n in often.items() if n >= LEAST_SEEN))}

    def matrix(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(names)), np.float32)
        for k, (words, _) in enumerate(rows):
            x[k, [names[g] for g in grams_of(words) if g in names]] = 1
        return x

    x, y = matrix(train), np.eye(len(FAMILIES), dtype=np.float32)[[f for _, f in train]]
    w, b = np.zeros((len(names), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    for _ in range(epochs):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * (x.T @ (p - y) / len(y) + shrink * w)
        b -= rate * (p - y).mean(0)
    w, b = np.where(np.abs(w) > 0.01, w, 0).astype(float).round(4), b.astype(float)
    z, truth = matrix(held) @ w + b, [f for _, f in held]
    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    scale = min((0.5 + 0.1 * k for k in range(60)), key=loss)
    return {g: w[k].tolist() for g, k in names.items() if w[k].any()}, b.round(4).tolist(), round(scale, 2)


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of constants, without any Python behind it."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("_r")).select("_r.*")


def held_out_errors(seed: int = 3, each: int = 8) -> dict[str, float]:
    """Share of wrongly predicted variations of each family, none of them trained or calibrated on."""
    weights, biases, _ = trained()
    wrong: dict[str, list[bool]] = {}
    for words, label in variations(seed, each):
        z = np.array(biases) + sum((np.array(weights[g]) for g in grams_of(words) if g in weights), np.zeros(len(FAMILIES)))
        wrong.setdefault(FAMILIES[label], []).append(int(z.argmax()) != label)
    return {f: float(np.mean(v)) for f, v in wrong.items()}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def bigrams(words: Column) -> Column:
    return longer(words, words)


def longer(grams: Column, words: Column) -> Column:
    """Each gram with the word after it; slices are taken of whole arrays, since one per gram would copy the array."""
    n = F.size("words") - F.size(grams) + 1
    most = F.greatest(F.size(grams) - 1, F.lit(0))
    return F.zip_with(F.slice(grams, 1, most), F.slice(words, n + 1, most), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    weights, biases, scale = trained()
    # templates by 2-gram; weights by n-gram: constants, so both are broadcast
    shared: dict[str, list[int]] = {}
    sizes, families_of = [], []
    for family in FAMILIES[1:]:
        for text in TEMPLATES[family]:
            own = {g for g in grams_of(words_of(text), 2) if " " in g}
            for g in own:
                shared.setdefault(g, []).append(len(sizes))
            sizes.append(len(own))
            families_of.append(FAMILIES.index(family))
    anchors, pattern = F.array(*map(F.lit, ANCHORS)), gate()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no")).withColumn("worth", F.coalesce(F.lower("text").rlike(pattern), F.lit(False)))
    plain = rows.filter(~F.col("worth")).select("doc_id", F.lit("").alias("families"), F.lit(0).cast("long").alias("n_licences"), F.lit(0).cast("long").alias("n_unknown"), F.lit(0.0).alias("probability"))
    lines = rows.filter("worth").select("doc_id", "row_no", F.posexplode(F.split("text", paragraph_break())).alias("line", "paragraph"))
    # a place that only the whole text shows, across two paragraphs, still leaves the document its row
    worth = F.lower("paragraph").rlike(pattern)
    lines = lines.withColumn("worth", worth).filter(F.col("worth") | (F.col("line") == 0))
    # the generator keeps the optimiser from splitting the paragraph anew for every n-gram
    words = F.when(F.col("worth"), tokens(F.col("paragraph"))).otherwise(F.array().cast("array<string>"))
    lines = lines.select("doc_id", "row_no", "line", F.explode(F.array(words)).alias("words"))
    lines = lines.withColumn("anchored", F.arrays_overlap("words", anchors))
    lines = lines.withColumn("two", bigrams(F.col("words"))).select("*", F.explode(F.array(longer(F.col("two"), F.col("words")))).alias("three"))
    grams = F.array_distinct(F.concat("words", "two", "three"))
    spread = lines.select("doc_id", "row_no", "line", "anchored", F.size(F.array_distinct("two")).alias("n2"), F.explode_outer(grams).alias("gram"))
    table = literal(spark, [{"gram": g, "w": weights.get(g, [0.0] * len(FAMILIES)), "t": shared.get(g, [])} for g in sorted(weights.keys() | shared.keys())], "gram: string, w: array<double>, t: array<int>")
    known = spread.join(F.broadcast(table), "gram", "left").filter("w is not null or line = 0")
    # sums per paragraph: scores per family and shared 2-grams per template
    sums = [F.coalesce(F.sum(F.element_at("w", k + 1)), F.lit(0.0)).alias(f"s{k}") for k in range(len(FAMILIES))]
    hits = [F.count_if(F.array_contains("t", k)).alias(f"t{k}") for k in range(len(sizes))]
    per_line = known.groupBy("row_no", "line").agg(F.first("doc_id").alias("doc_id"), F.first("n2").alias("n2"), F.first("anchored").alias("anchored"), *sums, *hits)
    scores = F.array(*[(F.col(f"s{k}") + biases[k]) * scale for k in range(len(FAMILIES))])
    per_line = per_line.select("row_no", "doc_id", "n2", "anchored", scores.alias("z"), F.array(*[F.greatest(F.col(f"t{k}") / F.lit(float(max(1, sizes[k]))), F.when(F.col("n2") >= 3, F.col(f"t{k}") / F.col("n2")).otherwise(0.0)) for k in range(len(sizes))]).alias("fit"))
    per_line = per_line.withColumn("top", F.array_max("z")).withColumn("label", (F.array_position("z", F.col("top")) - 1).cast("int")).withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top"))))
    best = F.array_max(F.transform(F.array(*[F.struct(F.lit(f).alias("f"), F.col("fit")[k].alias("c")) for k, f in enumerate(families_of)]), lambda t: F.when(t["f"] == F.col("label"), t["c"]).otherwise(0.0)))
    per_line = per_line.withColumn("confirmed", (F.col("label") > 0) & (F.col("p") >= LEAST_PROBABILITY) & (best >= CONFIRM))
    names = F.array(*map(F.lit, FAMILIES))
    judged = per_line.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), names[F.col("label")]))), ",").alias("families"),
        F.count_if("confirmed").alias("n_licences"),
        F.count_if(~F.col("confirmed") & (F.col("label") > 0) & F.col("anchored")).alias("n_unknown"),
        F.coalesce(F.max(F.when(F.col("confirmed"), F.col("p"))), F.lit(0.0)).alias("probability"),
    )
    return plain.unionByName(judged.drop("row_no"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_licenses": op1_licenses}
SQL: dict[str, str] = {}
