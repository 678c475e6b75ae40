"""Licence scans by a trained paragraph classifier; DataFrame operations only on the data.

Paragraphs (lines, with the words around them that a wrapped notice may have there) are told apart by a multinomial logistic
regression over sparse word n-grams (1 to 3 words).  It is trained on the driver from altered copies of notice texts against a
bounded sample of the corpus's own paragraphs, without those that overlap a notice, and of sentences about licences that grant
none; those two are the class ``unknown``.  A temperature, fitted on notices that the model in question was not trained on,
calibrates the probabilities.  A family is reported only where its probability reaches the threshold and the paragraph,
compared with the family's notice texts, contains enough of one; a paragraph that is about a licence but is not confirmed is
``unknown``.

On the data, n-grams look up their row of weights by hashing into a folded literal array that has no collision among known
n-grams.  Only paragraphs that hold an anchor are scored.  Anchors are words chosen from the notices, the rarest in the sample
first, until the n-grams of each notice that hold none of them are fewer than the overlap asks for: what holds no anchor
could not be confirmed, whatever the sample was.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import common

# Customary notice sentences of licence families.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution-NonCommercial license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
    ],
}
# Sentences about licences that grant none.
OTHERS = [
    "All rights reserved.",
    "Copyright 2020 by the authors.",
    "The driver lost his license after the accident.",
    "A license is required to fish in this lake.",
    "The software is sold under a commercial license agreement.",
    "Permission to build the house was granted by the council.",
    "The new version of the work was released to the public.",
    "You may not use this site without a license.",
    "The terms of the contract are subject to the law.",
]
UNKNOWN = "unknown"
_WORD = "[a-z0-9]+"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _altered(w: list[str], filler: list[str], rng: random.Random) -> list[str]:
    """A copy with some words lost, within some ordinary words."""
    kept = [x for x in w if rng.random() > 0.08] or w
    around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 4, 12, 30, 60)))] if filler else []
    cut = rng.randint(0, len(around))
    return around[:cut] + kept + around[cut:]


def share(found: set[str], notice: set[str]) -> float:
    """How much of a notice's n-grams a paragraph holds."""
    return len(found & notice) / len(notice)


def anchors(notices: list[set[str]], known: Counter, overlap: float) -> list[str]:
    """Words such that of each notice's n-grams less than ``overlap`` hold none of them; words rare in ``known`` come first."""
    chosen: set[str] = set()
    free = [{g: set(g.split()) for g in n} for n in notices]
    while True:
        open_ = [f for f, n in zip(free, notices) if len(f) >= overlap * len(n)]
        if not open_:
            return sorted(chosen)
        gain = Counter(x for f in open_ for own in f.values() for x in own)
        best = min(gain, key=lambda x: (-gain[x] / (known[x] + 0.5), x))
        chosen.add(best)
        free = [{g: own for g, own in f.items() if best not in own} for f in free]


class Model:
    """Classes, n-gram weights and anchors; all that is fitted outside Spark, on bounded samples."""

    def __init__(self, ordinary: list[str], overlap: float = 0.5, copies: int = 12, folds: int = 4, seed: int = 5):
        rng = random.Random(seed)
        self.classes = [UNKNOWN, *NOTICES]
        sure = [(c, k, words(t)) for c, texts in enumerate(NOTICES.values(), 1) for k, t in enumerate(texts)]
        notices = [set(grams(w)) for _, _, w in sure]
        self.vocabulary = sorted(set().union(*notices))
        plain = [w for p in ordinary if (w := words(p))]
        # a paragraph that holds a good part of a notice is no example of an ordinary one
        plain = [w for w in plain if (g := set(grams(w))) and max(share(g, n) for n in notices) < overlap / 2]
        filler = [x for w in plain for x in w]
        rows = [(c, k % folds, _altered(w, filler, rng)) for c, k, w in sure for _ in range(copies)]
        rows += [(0, k % folds, _altered(words(t), filler, rng)) for k, t in enumerate(OTHERS) for _ in range(copies)]
        rows += [(0, k % folds, w) for k, w in enumerate(plain)]
        at = {g: k for k, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(at) + 1), np.float32)
        x[:, -1] = 1
        for k, (_, _, w) in enumerate(rows):
            x[k, [at[g] for g in grams(w) if g in at]] = 1
        y = np.eye(len(self.classes), dtype=np.float32)[[c for c, _, _ in rows]]
        fold = np.array([f for _, f, _ in rows])
        # what a notice's own fold says of it, its texts being left out, shows how sure the model may be
        late = np.concatenate([x[fold == f] @ _fitted(x[fold != f], y[fold != f]) for f in range(folds)])
        truth = np.concatenate([y[fold == f] for f in range(folds)])
        loss = lambda t: -float((np.log(_softmax(late / t) + 1e-9) * truth).sum())
        self.temperature = min(np.geomspace(0.25, 4, 33).tolist(), key=loss)
        self.weights = _fitted(x, y) / self.temperature
        self.anchors = anchors(notices, Counter(x for w in plain for x in set(w)), overlap)


def _fitted(x: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 2e-4) -> np.ndarray:
    """Weights by gradient descent with momentum; every class weighs the same, and equal rows are one."""
    both, many = np.unique(np.c_[x, y], axis=0, return_counts=True)
    x, y = both[:, : x.shape[1]], both[:, x.shape[1] :] * many[:, None]
    weights, speed = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros((x.shape[1], y.shape[1]), np.float32)
    size = y.sum(axis=0)
    y = y / np.maximum(size, 1) / max(1, (size > 0).sum())
    each = y.sum(axis=1, keepdims=True)
    for _ in range(steps):
        gradient = x.T @ (each * _softmax(x @ weights) - y) + decay * weights
        speed = 0.9 * speed - 0.5 * gradient
        weights += speed
    return weights


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _literal(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _index(docs: DataFrame, vocabulary: list[str]) -> tuple[Column, int]:
    """Literal array: hash place → row of the n-gram (from 1), 0 where there is none; its size has no collision."""
    spark = docs.sparkSession
    found = spark.range(1).select(F.explode(F.array(*map(F.lit, vocabulary))).alias("g")).select("g", F.xxhash64("g").alias("h")).collect()
    hashes = {r["g"]: r["h"] for r in found}
    size = 1 << 16
    while len({h % size for h in hashes.values()}) < len(vocabulary):
        size += 2 * len(vocabulary) + 1
    row = [0] * size
    for k, g in enumerate(vocabulary):
        row[hashes[g] % size] = k + 1
    return _literal(row, "int"), size


def train(docs: DataFrame, overlap: float = 0.5, max_docs: int = 400, max_paragraphs: int = 1600) -> Model:
    """From the notice texts, and at most ``max_paragraphs`` lines (those of the smallest hashes) of at most ``max_docs``
    documents (the smallest hashes of doc_id), in which lines of notices do not count."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_docs)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = texts.select(F.explode(F.split("t", "[\\r\\n]+")).alias("p")).where("p <> ''")
    return Model(sorted(r["p"] for r in lines.orderBy(F.xxhash64("p"), "p").limit(max_paragraphs).collect()), overlap)


#: A paragraph is scored by parts of so many words, each with as many words around it on either side (from its own line, and from
#: WRAP lines before and after, as notices are wrapped).
PART, WRAP = 32, 4


def scan(docs: DataFrame, threshold: float = 0.5, overlap: float = 0.5, max_docs: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, license (most probable confirmed family, else ``unknown`` where a paragraph is
    about a licence, else null), confidence (its probability), n_paragraphs (paragraphs about a licence) and found (an array of
    (paragraph from 0, family, probability, overlap) of their parts).

    Paragraphs are lines.  Null and empty texts find nothing; ties go to the earlier paragraph; repeated rows come out
    repeated; null doc_ids stay null; other columns are not read; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = train(docs, overlap, max_docs)
    index, size = _index(docs, model.vocabulary)
    n = len(model.classes)
    flat = _literal([f"{v:.5f}" for v in model.weights[:-1].ravel().tolist()], "double")
    bias = _literal([f"{v:.5f}" for v in model.weights[-1].tolist()], "double")
    hints = F.array(*map(F.lit, model.anchors))
    # what cannot be told by a whole word may be told by its letters: texts without those are not split at all
    hint = "(?i)" + "|".join(model.anchors)
    df = docs.withColumn("_w", F.when(F.col("text").rlike(hint), F.transform(F.split("text", "[\\r\\n]+"), lambda p: F.regexp_extract_all(F.lower(p), F.lit(_WORD), F.lit(0)))))
    df = df.withColumn("_w", F.coalesce("_w", F.array().cast("array<array<string>>"))).drop("text")
    lines = F.filter(F.transform("_w", lambda w, k: F.struct(k.alias("k"), w.alias("w"))), lambda s: F.arrays_overlap(s["w"], hints))

    def around(s: Column) -> Column:
        before = F.flatten(F.slice("_w", F.greatest(s["k"] - WRAP, F.lit(0)) + 1, F.least(s["k"], F.lit(WRAP))))
        before = F.slice(before, F.greatest(F.size(before) - PART, F.lit(0)) + 1, PART)
        after = F.slice(F.flatten(F.slice("_w", s["k"] + 2, WRAP)), 1, PART)
        return F.struct(s["k"].alias("k"), F.size(before).alias("skip"), s["w"].alias("w"), F.concat(before, s["w"], after).alias("all"))

    def parts(s: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["w"]) - 1) / PART).cast("int")), lambda j: j * PART)
        places = F.filter(places, lambda j: F.arrays_overlap(F.slice(s["w"], j + 1, PART), hints))
        return F.transform(places, lambda j: F.struct(s["k"].alias("k"), F.slice(s["all"], F.greatest(s["skip"] + j - PART, F.lit(0)) + 1, 3 * PART).alias("w")))

    df = df.withColumn("_p", F.transform(lines, around)).drop("_w")
    df = df.withColumn("_p", F.flatten(F.transform("_p", parts)))

    def ngrams(w: Column) -> Column:
        pair = F.transform(w, lambda x, k: F.concat_ws(" ", x, F.get(w, k + 1)))
        three = F.transform(w, lambda x, k: F.concat_ws(" ", x, F.get(w, k + 1), F.get(w, k + 2)))
        rest = lambda a, n: F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))
        return F.array_distinct(F.concat(w, rest(pair, 1), rest(three, 2)))

    df = df.withColumn("_p", F.transform("_p", lambda s: s.withField("g", F.filter(ngrams(s["w"]), lambda g: g.isin(model.vocabulary))).dropFields("w")))
    df = df.withColumn("_p", F.transform("_p", lambda s: s.withField("rows", F.transform(s["g"], lambda g: F.element_at(index, (F.pmod(F.xxhash64(g), F.lit(size)) + 1).cast("int"))))))

    def scores(rows: Column) -> Column:
        add = lambda z, r: F.transform(z, lambda v, c: v + F.element_at(flat, (r - 1) * n + c + 1))
        return F.aggregate(rows, bias, add)

    df = df.withColumn("_p", F.transform("_p", lambda s: s.withField("z", scores(s["rows"]))))
    df = df.withColumn("_p", F.transform("_p", lambda s: s.withField("e", F.transform(s["z"], lambda v: F.exp(v - F.array_max(s["z"]))))))
    df = df.withColumn("_p", F.transform("_p", lambda s: s.withField("e", F.transform(s["e"], lambda v: v / F.aggregate(s["e"], F.lit(0.0), lambda a, b: a + b)))))
    shares = []
    for texts in NOTICES.values():
        notices = [sorted(set(grams(words(t)))) for t in texts]
        shares.append(lambda g, notices=notices: F.greatest(*(F.size(F.array_intersect(g, F.array(*map(F.lit, x)))) / F.lit(float(len(x))) for x in notices)))
    names = F.array(*map(F.lit, list(NOTICES)))

    def judge(s: Column) -> Column:
        families = F.slice(s["e"], 2, n - 1)
        top = F.array_max(families)
        return F.struct(s["k"].alias("paragraph"), F.element_at(names, F.array_position(families, top).cast("int")).alias("family"), top.alias("probability"), F.array(*(f(s["g"]) for f in shares)).alias("shares"), (1 - F.element_at(s["e"], 1)).alias("about"))

    df = df.withColumn("_p", F.filter(F.transform("_p", judge), lambda s: s["about"] >= threshold))

    def confirm(s: Column) -> Column:
        share = F.element_at(s["shares"], F.array_position(names, s["family"]).cast("int"))
        sure = (s["probability"] >= threshold) & (share >= overlap)
        return F.struct(s["paragraph"].alias("paragraph"), F.when(sure, s["family"]).otherwise(UNKNOWN).alias("family"), F.round(F.when(sure, s["probability"]).otherwise(s["about"]), 6).alias("probability"), F.round(share, 6).alias("overlap"))

    df = df.withColumn("found", F.transform("_p", confirm))
    ranked = F.array_max(F.transform("found", lambda s: F.struct((s["family"] != UNKNOWN).alias("sure"), s["probability"].alias("p"), (-s["paragraph"]).alias("k"), s["family"].alias("family"))))
    count = F.size(F.array_distinct(F.transform("found", lambda s: s["paragraph"]))).cast("long")
    return df.withColumn("_best", ranked).select("doc_id", F.col("_best")["family"].alias("license"), F.col("_best")["p"].alias("confidence"), count.alias("n_paragraphs"), "found")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
