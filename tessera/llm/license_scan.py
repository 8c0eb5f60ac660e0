"""Licence scans: a trained paragraph classifier, confirmed by templates.

Lines, and then what is left of the paragraphs between blank lines, are classified
by multinomial logistic regression over the presence of words and word pairs: a
line that is confirmed alone is a notice of its own, and the others of its
paragraph are joined, as notices are often wrapped.  A class "none" stands for other text; its
examples are paragraphs of the corpus.  Probabilities are tempered on examples
that the training has not seen, of its families and of others, and a paragraph
that looks like a licence but belongs to no family with enough probability, or
that no template of its family confirms, or that does not name the family with
its version, clauses and terms, is "unknown".

The main path is DataFrame functions alone: whole texts are split, gated and
scored row by row, without a shuffle, a join or Python.  Training runs on a
bounded table on the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_sample

#: Notices of the licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright notice. All rights reserved. No part of this work may be reproduced without written permission."],
}
#: Names of the families and the openings that notices put before them.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0", "the Apache License 2.0"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the BSD License", "a BSD license"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "GPL v3", "the GNU GPL 3"],
    "mit": ["the MIT License", "an MIT license", "the MIT License (MIT)"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0"],
    "proprietary": ["a proprietary license, all rights reserved"],
}
OPENINGS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under {}.", "This project is available under {}."]
#: What of a family's words, in this order, tells it from others (of the words between single spaces).
_V2, _V3 = r"(version |v )?v?2( 0)?\b(?! [0-9]\b)", r"(version |v )?v?3( 0)?\b(?! [0-9]\b)"
MARKS = {
    "apache-2.0": rf"\bapache (license )?{_V2}",
    "bsd-3-clause": r"\bbsd (license )?3 clause\b(?! clear)|\b(3|three) clause bsd\b|\b(new|revised|modified) bsd license\b",
    "cc-by-4.0": r"\b(cc by|commons attribution) (version )?v?4 0\b",
    "cc-by-nc-4.0": r"\b(cc by nc|commons attribution non ?commercial) (version )?v?4 0\b",
    "cc-by-sa-4.0": r"\b(cc by sa|commons attribution share ?alike) (version )?v?4 0\b",
    "gpl-3.0": rf"\bgnu general public license (as published by the free software foundation )?(either )?{_V3}|(?<!lesser )(?<!library )(?<!affero )\bgpl {_V3}|\bgplv3\b",
    "mit": r"\bmit license\b|\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b",
    "mpl-2.0": rf"\b(mozilla public license|mpl) {_V2}",
    "proprietary": r"\ball rights reserved\b|\bno part of this work may be reproduced\b",
}
#: The opening of all BSD licences, and what of the rest of the text has three clauses: the third, and not the one on advertising.
BSD_OPENING, BSD_THIRD, BSD_FOURTH = r"\bredistribution and use in source and binary forms\b", "neither[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of", "all[^a-z0-9]+advertising[^a-z0-9]+materials"
#: Notices of families that are not in the training; none of them should come out as sure.
OUTSIDE = [
    "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the GNU Affero General Public License, version 3.", "Released under the BSD 2-Clause License.",
    "Licensed under CC BY 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla Public License, version 1.1.", "Released under the ISC License.",
    "This project is available under the Eclipse Public License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Released under the zlib License.", "Licensed under the Artistic License 2.0.", "Released under the Unlicense.",
]
NONE, UNKNOWN = "none", "unknown"
#: Paragraphs of the corpus that stand for "none" in training, at most about; confidence and template share asked for.
NEGATIVES, LEAST_PROBABILITY, LEAST_SHARE = 2_000, 0.5, 0.6
_SPLIT = "[^a-z0-9]+"
#: Between paragraphs: lines without a letter or digit, so a comment's empty lines too.
_BLANK = r"\n[^\p{L}\p{N}]*\n"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    """classes, "none" first; weights by n-gram, a number a class; triggers: words without one of which "none" wins."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    triggers: list[str]


def fit(negatives: list[str], rounds: int = 400) -> Model:
    """Full-batch gradient descent on the notices above against ``negatives``, a bounded list."""
    examples = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    examples += [(f, o.format(n)) for f, ns in NAMES.items() for n, o in product(ns, OPENINGS)]
    positive = len(examples)
    examples += [(NONE, t) for t in negatives] + [(NONE, t) for t in ("", "Permission was a word in this line.", "The version of the work", "See the terms.", "free of charge")]
    grams = [grams_of(words_of(t)) for _, t in examples]
    vocabulary = sorted(set().union(*grams[:positive]))
    at = {g: i for i, g in enumerate(vocabulary)}
    classes = [NONE, *sorted(TEMPLATES)]
    x = np.zeros((len(examples), len(vocabulary)))
    for i, g in enumerate(grams):
        x[i, [at[w] for w in g if w in at]] = 1
    y = np.array([classes.index(c) for c, _ in examples])
    weight = np.where(y == 0, 0.5 * positive / max(1, len(examples) - positive), 1.0)
    weight /= weight.sum()
    target = np.eye(len(classes))[y]
    fitted = np.ones(len(examples), dtype=bool)
    fitted[len(TEMPLATES) * 2 : positive : 7] = False  # set the temperature on these
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    a, t, s = x[fitted], target[fitted], weight[fitted, None]
    for _ in range(rounds):
        z = a @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - t) * s
        mw, mb = 0.9 * mw + a.T @ g + 2e-5 * w, 0.9 * mb + g.sum(axis=0)
        w, b = w - 4.0 * mw, b - 4.0 * mb
    z = x[~fitted] @ w + b
    others = np.array([[float(g in held_by) for g in vocabulary] for held_by in (grams_of(words_of(t)) for t in OUTSIDE)]) @ w + b
    others = others[others.argmax(axis=1) > 0]  # a family is the nearest, and the surer it is the worse

    def loss(k: float) -> float:
        known = np.logaddexp.reduce(z / k, axis=1) - (z / k)[np.arange(len(z)), y[~fitted]]
        surest = np.exp(others.max(axis=1) / k - np.logaddexp.reduce(others / k, axis=1))
        return float((known.sum() - np.log(np.maximum(1 - surest, 1e-9)).sum()) / (len(z) + len(others)))

    temperature = float(min(np.geomspace(0.5, 4, 25), key=loss))
    # The gate: a paragraph of the n-grams outside `held` alone cannot bring a family above "none".
    held: set[str] = set()
    for c in range(1, len(classes)):
        lead = w[:, c] - w[:, 0]
        room = b[0] - b[c]
        for i in np.argsort(lead):
            if lead[i] > 0:
                room -= lead[i]
                if room <= 0:
                    held.add(vocabulary[i])
    # A pair of words is there only if its rarer word is: the longer one stands for it.
    triggers = sorted({max(g.split(), key=lambda v: (len(v), v)) for g in held})
    return Model(classes, {g: [round(float(v), 6) for v in w[i]] for g, i in at.items()}, [round(float(v), 6) for v in b], round(temperature, 6), triggers)


def negatives_of(docs: DataFrame, most: int = NEGATIVES) -> list[str]:
    """Paragraphs of a bounded hash sample of documents that name no licence."""
    lines = hash_sample(docs.where("text IS NOT NULL").select("doc_id", "text"), "doc_id", most // 4).select(F.explode(F.split("text", "\n")).alias("p"))
    plain = lines.where(~F.lower("p").rlike("licen[sc]|copyright|permission|rights reserved|creative commons")).where("length(p) <= 4000")
    return sorted(r.p for r in plain.orderBy(F.xxhash64("p"), "p").limit(most).collect())


def _words(p: Column) -> Column:
    return F.filter(F.split(F.lower(p), _SPLIT), lambda w: w != "")


def _text(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs (lines that are not blank), and ``found``: for each line or joined paragraph that is not "none" its place, family, probability, share of the template.

    A paragraph's unconfirmed lines are joined, and if they are confirmed so they
    are one entry at the place of the first; else each line keeps its own verdict.
    """
    triggers = _text(model.triggers)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_paragraphs", F.size(F.filter(F.split("text", "\n"), lambda p: F.length(F.trim(p)) > 0)).cast("long"))
    parts = F.transform(F.split("text", _BLANK), lambda p, i: F.transform(F.split(p, "\n"), lambda q, k: F.struct(F.struct(i.alias("part"), k.alias("line")).alias("place"), _words(q).alias("words"))))
    gated = F.transform(parts, lambda ls: F.transform(ls, lambda p: F.struct(p["place"].alias("place"), p["words"].alias("words"), F.arrays_overlap(p["words"], triggers).alias("gated"))))
    rows = rows.withColumn("lines", F.filter(gated, lambda ls: F.exists(ls, lambda p: p["gated"])))

    def grams(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("CAST(array() AS array<string>)"))
        return F.array_intersect(_text(list(model.weights)), F.concat(words, pairs))

    table = F.map_from_arrays(_text(list(model.weights)), F.array(*[F.array(*[F.lit(v) for v in w]) for w in model.weights.values()]))
    bias = F.array(*[F.lit(v) for v in model.bias])
    templates = F.map_from_arrays(_text(list(TEMPLATES)), F.array(*[F.array(*[_text(sorted(set(words_of(t)))) for t in ts]) for ts in TEMPLATES.values()]))

    def logits(words: Column) -> Column:
        total = F.aggregate(grams(words), bias, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        return F.transform(total, lambda v: v / model.temperature)

    def odds(z: Column) -> Column:
        top = F.array_max(z)
        return F.struct(F.array_position(z, top).alias("best"), (1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))).alias("probability"))

    def marked(family: Column, words: Column) -> Column:
        line = F.concat_ws(" ", words)
        named = F.lit(False)
        for f, mark in MARKS.items():
            named = F.when(family == f, line.rlike(mark)).otherwise(named)
        three = line.rlike(BSD_OPENING) & F.lower("text").rlike(BSD_THIRD) & ~F.lower("text").rlike(BSD_FOURTH)
        return F.when(named, True).when(family == "bsd-3-clause", three).otherwise(False)

    def verdict(o: Column, words: Column) -> Column:
        family = F.element_at(_text(model.classes), o["best"].cast("int"))
        share = F.coalesce(F.array_max(F.transform(F.element_at(templates, family), lambda t: F.size(F.array_intersect(t, words)) / F.size(t))), F.lit(0.0))
        sure = (o["probability"] >= LEAST_PROBABILITY) & (share >= LEAST_SHARE) & marked(family, words)
        return F.struct(family.alias("closest"), o["probability"].alias("probability"), share.alias("share"), sure.alias("sure"))

    # Each step is a column of its own, as a lambda's expressions are worked out wherever they are named.
    steps = [
        lambda p: F.struct(p["place"].alias("place"), p["words"].alias("words"), F.when(p["gated"], logits(p["words"])).alias("v")),
        lambda p: F.struct(p["place"].alias("place"), p["words"].alias("words"), F.when(p["v"].isNotNull(), odds(p["v"])).alias("v")),
        lambda p: F.struct(p["place"].alias("place"), p["words"].alias("words"), F.when(p["v"]["best"] > 1, verdict(p["v"], p["words"])).alias("v")),
    ]
    sure = lambda p: F.coalesce(p["v"]["sure"], F.lit(False))
    named = lambda p: F.struct(p["place"].alias("place"), F.when(p["v"]["sure"], p["v"]["closest"]).otherwise(UNKNOWN).alias("family"), p["v"]["closest"].alias("closest"), p["v"]["probability"].alias("probability"), p["v"]["share"].alias("share"))
    for step in steps:
        rows = rows.withColumn("lines", F.transform("lines", lambda ls: F.transform(ls, step)))  # noqa: B023
    rows = rows.withColumn("lines", F.transform("lines", lambda ls: F.struct(F.filter(ls, sure).alias("alone"), F.filter(ls, lambda p: ~sure(p)).alias("rest"))))
    rows = rows.withColumn("joined", F.transform("lines", lambda s: F.struct(F.get(s["rest"], F.lit(0))["place"].alias("place"), F.flatten(F.transform(s["rest"], lambda p: p["words"])).alias("words"), (F.size(s["rest"]) > 1).alias("gated"))))
    for step in steps:
        rows = rows.withColumn("joined", F.transform("joined", step))
    best = lambda s, j: F.concat(s["alone"], F.when(sure(j), F.array(j)).otherwise(F.filter(s["rest"], lambda p: p["v"].isNotNull())))
    rows = rows.withColumn("kept", F.flatten(F.zip_with("lines", "joined", best)))
    return rows.select("doc_id", "n_paragraphs", F.transform("kept", named).alias("found"))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, license, families, n_license, n_unknown, n_paragraphs, probability.

    ``license`` is the surest confirmed family (the first paragraph's at a
    tie), else "unknown" if a paragraph looks like a licence, else "none".
    ``docs`` needs doc_id and text; other columns are not read.  A null or empty
    text has no paragraph and is "none".  Texts are read whole, repeated rows
    come out as often as they come in, no rows give no rows.
    """
    found = paragraphs(docs, model)
    known = F.filter("found", lambda p: p["family"] != UNKNOWN)
    rows = found.withColumn("known", known)
    best = F.element_at(F.array_sort(F.transform("known", lambda p: F.struct((-p["probability"]).alias("less"), p["place"].alias("place"), p["family"].alias("family")))), 1)
    rows = rows.withColumn("best", F.when(F.size("known") > 0, best))
    return rows.select(
        "doc_id",
        F.coalesce(F.col("best.family"), F.when(F.size("found") > 0, UNKNOWN), F.lit(NONE)).alias("license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("known", lambda p: p["family"]))), ",").alias("families"),
        F.size("known").cast("long").alias("n_license"),
        (F.size("found") - F.size("known")).cast("long").alias("n_unknown"),
        "n_paragraphs",
        F.round(F.coalesce(-F.col("best.less"), F.lit(0.0)), 6).alias("probability"),
    )


def classify(text: str, model: Model, document: str | None = None) -> tuple[str, float, float]:
    """The plain form of one paragraph's verdict, for tests: family, probability, share; ``document`` is the text that it stands in."""
    words = words_of(text)
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams_of(words) if g in model.weights), np.zeros(len(model.bias)))
    z = z / model.temperature
    best = int(z.argmax())
    p = 1 / sum(math.exp(v - z[best]) for v in z)
    if best == 0:
        return NONE, p, 0.0
    share = max(len({*words} & {*words_of(t)}) / len({*words_of(t)}) for t in TEMPLATES[model.classes[best]])
    line, whole = " ".join(words), (text if document is None else document).lower()
    marked = re.search(MARKS[model.classes[best]], line) or (model.classes[best] == "bsd-3-clause" and re.search(BSD_OPENING, line) and re.search(BSD_THIRD, whole) and not re.search(BSD_FOURTH, whole))
    return (model.classes[best] if p >= LEAST_PROBABILITY and share >= LEAST_SHARE and marked else UNKNOWN), p, share


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(negatives_of(docs)))
