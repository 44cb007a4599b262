"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by comparison with templates.

A paragraph is a run of non-empty lines, so statements broken over lines stay whole. Word pairs that statements are made of
and plain paragraphs are not mark where a statement may lie; windows of words around them are classified by a sparse
word n-gram logistic regression over licence families and the unknown class. A prediction is confirmed where the window
holds enough of one of the family's templates, enough of what that template has and no other family, and no
other family's template fits better.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Statements of each family, as projects write them; "#" stands for any number.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version #.# (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version #.#.",
        "This project is released under the Apache #.# license.",
        "SPDX-License-Identifier: Apache-#.#",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD #-Clause License.",
        "SPDX-License-Identifier: BSD-#-Clause",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License",
        "This work is licensed under the GNU General Public License, version #.",
        "Released under the GNU GPL v#.",
        "SPDX-License-Identifier: GPL-#.#-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version #.#.",
        "SPDX-License-Identifier: LGPL-#.#-only",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version # of the License",
        "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version #.",
        "SPDX-License-Identifier: AGPL-#.#-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. #.#. If a copy of the MPL was not distributed with this file, you can obtain one at",
        "Licensed under the Mozilla Public License #.#.",
        "SPDX-License-Identifier: MPL-#.#",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial #.# International License.",
        "Licensed under CC BY-NC #.#.",
        "Content is available under CC BY-NC-SA #.#.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike #.# International License.",
        "Licensed under CC BY-SA #.#.",
        "Text is available under CC BY-SA #.#.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution #.# International License.",
        "Licensed under CC BY #.#.",
        "This article is distributed under CC BY #.#.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 #.# Universal.",
        "Dedicated to the public domain under CC0 #.#.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: What licences of each family are called, and of others, which are unknown here.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License Version #.#", "Apache License #.#", "Apache-#.# license", "Apache Software License"),
    "mit": ("MIT License", "MIT licence", "terms of the MIT license", "Expat MIT license"),
    "bsd": ("BSD License", "BSD #-Clause License", "BSD-style license", "New BSD license"),
    "gpl": ("GNU General Public License", "GNU General Public License version #", "GNU GPL v#", "GPL version #", "GPLv# license"),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL v#", "LGPL version #.#"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License version #", "GNU AGPL v#", "AGPL version #"),
    "mpl": ("Mozilla Public License", "Mozilla Public License version #.#", "MPL #.#"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial #.# license", "CC BY-NC #.#", "CC BY-NC-SA #.# license", "Creative Commons Attribution-NonCommercial-ShareAlike license"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike #.# license", "CC BY-SA #.#", "CC BY-SA license"),
    "cc-by": ("Creative Commons Attribution #.# license", "CC BY #.#", "CC BY license", "Creative Commons Attribution license"),
    "public-domain": ("public domain", "CC0 #.# Universal", "CC0 public domain dedication", "Unlicense"),
    "proprietary": ("proprietary license agreement", "proprietary license", "confidential and proprietary terms"),
    UNKNOWN: (
        "Eclipse Public License v#.#", "ISC License", "zlib license", "Boost Software License version #.#", "Common Development and Distribution License", "European Union Public Licence v#.#",
        "Artistic License #.#", "PostgreSQL License", "Microsoft Public License", "Open Software License version #.#", "SIL Open Font License version #.#", "Python Software Foundation License",
        "Open Data Commons License", "GNU Free Documentation License version #.#", "Academic Free License version #.#", "Creative Commons license", "public license", "general license", "house rules",
    ),
}
#: Ways to say that a licence applies; "@" stands for its name.
FRAMES = (
    "Licensed under the @.", "Released under the @.", "Licensed under @.", "Distributed under the terms of the @.", "This project is licensed under the @.", "This work is available under the @.",
    "The code in this directory is covered by the @.", "See the file COPYING for the @.", "You may use this text under the @.", "SPDX-License-Identifier: @", "License: @", "Published under the @, see LICENSE for details.",
)
#: Statements of licences outside the families, for the unknown class.
OTHERS = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License #.# which is available at",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version #.# or any later version published by the Free Software Foundation",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "The public may visit the house under the general terms of the season, and any person may obtain a copy of the programme free of charge.",
)
FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, UNKNOWN]
#: Windows a task learns from at once, rounds over a task's first ones and over each later block, and variants of a statement.
BLOCK, FIRST, LATER, VARIANTS = 4000, 30, 8, 12
#: Steps of probability in which scores of windows are counted, and groups in which tasks' models are added up.
STEPS, SUMS = 100_000, 16
#: Words of a window; words between marked pairs of one statement, and words taken in on both sides.
SPAN, GAP, ROUND = 120, 6, 3
#: Share of a template's word n-grams that confirms a prediction, share of those that are its family's own, false
#: alarms allowed on calibration windows, share of left-out families' statements that may pass the threshold, and most it may be.
CONFIRMED, OWN, ALARMS, STRANGERS, MOST = 0.5, 0.5, 0.0005, 0.35, 0.7
#: Share of plain windows that may hold a marked pair.
USUAL = 0.005
WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
NUMBER = re.compile(r"^v?\d+(?:-\d+)*$")
BLANK = re.compile(r"\n[ \t\r\f\v]*(?=\n)")


def words_of(text: str) -> list[str]:
    return ["#" if w[-1] <= "9" and NUMBER.match(w) else w for w in WORD.findall(text.lower().replace(".", " "))]


def grams(words: list[str]) -> list[str]:
    """Words and pairs of words; numbers alone say nothing."""
    return [w for w in words if w != "#"] + [f"{a} {b}" for a, b in zip(words, words[1:])]


def said(name: str) -> list[list[str]]:
    """Words of a name in each frame."""
    return [words_of(frame.replace("@", name).replace("#", "1")) for frame in FRAMES]


def templates() -> list[tuple[str, frozenset[str], frozenset[str]]]:
    """(family, n-grams, those no other family's templates and names have) of each template."""
    plain = {f: [words_of(t.replace("#", "1")) for t in TEMPLATES[f]] + [w for name in NAMES[f] for w in said(name)[:6]] for f in FAMILIES}
    held = {f: set().union(*(grams(w) for w in plain[f])) for f in FAMILIES}
    others = set().union(*(grams(words_of(t.replace("#", "1"))) for t in OTHERS), *(grams(w) for name in NAMES[UNKNOWN] for w in said(name)))
    found = set()
    for f in FAMILIES:
        foreign = others.union(*(held[g] for g in FAMILIES if g != f))
        for w in plain[f]:
            own = frozenset(grams(w)) - foreign
            if own:
                found.add((f, frozenset(grams(w)), own))
    return sorted(found, key=lambda t: (t[0], sorted(t[1])))


def vocabulary() -> list[str]:
    """The n-grams of statements of the families: all that the classifier looks at."""
    said_ = [w for f in FAMILIES for name in NAMES[f] for w in said(name)]
    return sorted({g for f in FAMILIES for t in TEMPLATES[f] for g in grams(words_of(t.replace("#", "1")))} | {g for w in said_ for g in grams(w)})


class Vectors:
    """Rows of a matrix for windows of words: which n-grams of the vocabulary they hold."""

    def __init__(self) -> None:
        self.vocabulary = vocabulary()
        self.words = {g: i for i, g in enumerate(self.vocabulary) if " " not in g}
        self.pairs: dict[str, dict[str, int]] = {}
        for i, g in enumerate(self.vocabulary):
            if " " in g:
                first, second = g.split(" ")
                self.pairs.setdefault(first, {})[second] = i
        known = [t for _, t, _ in templates()]
        self.shared = np.array([[" " in g and g in t for t in known] for g in self.vocabulary], np.float32)
        self.limits = np.array([min(4, len(t) / 4) for t in known], np.float32)

    def held(self, windows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(windows), len(self.vocabulary)), np.float32)
        word, first = self.words.get, self.pairs.get
        for i, words in enumerate(windows):
            known = set(map(word, words))
            known.discard(None)
            known.update(after[b] for a, b in zip(words, words[1:]) if (after := first(a)) and b in after)
            x[i, list(known)] = 1
        return x

    def plain(self, x: np.ndarray) -> np.ndarray:
        """Of each row, whether it shares under four word pairs, and under half of them, with every template."""
        return (x @ self.shared < self.limits).all(1)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def examples(rng: random.Random, neighbours: list[list[str]]) -> list[tuple[list[str], str]]:
    """Training statements: templates and framed names, with words lost, cut short, or between ordinary words."""
    found = []
    for family in CLASSES:
        whole = [words_of(t.replace("#", "1")) for t in (OTHERS if family == UNKNOWN else TEMPLATES[family])]
        for words in [w for w in whole for _ in range(VARIANTS)] + [w for name in NAMES[family] for w in said(name) for _ in range(2)]:
            kept = [w for w in words if rng.random() > 0.05] if len(words) > 8 else list(words)
            if len(kept) > 24 and rng.random() < 0.7:
                at = rng.randrange(len(kept) - 16)
                kept = kept[at : at + rng.randint(16, len(kept))]
            if neighbours and rng.random() < 0.5:
                other = rng.choice(neighbours)
                at = rng.randrange(len(other) + 1)
                kept = other[max(0, at - 20) : at] + kept + other[at : at + 20]
            found.append((kept, family))
    return found


#: The families each model never sees: three that tell what strangers reach, and one for each half of the texts.
LEFT_OUT = [frozenset(FAMILIES[third::3]) for third in range(3)] + [frozenset(), frozenset()]


class Learner:
    """Softmax regressions over the classes, one for each of LEFT_OUT, by proximal gradient steps; weights under the lasso are zero."""

    def __init__(self, vectors: Vectors, weights: np.ndarray | None = None):
        self.vectors = vectors
        shape = (len(LEFT_OUT), len(vectors.vocabulary) + 1, len(CLASSES))  # the last row is the constant
        self.weights = np.zeros(shape, np.float32) if weights is None else weights.reshape(shape).copy()
        self.past = np.zeros(shape, np.float32)

    def train(self, models: list[int], windows: np.ndarray, words: list[list[str]], rng: random.Random, rounds: int, step: float = 4.0, lasso: float = 1e-4) -> None:
        """Further steps of these models over windows of the unknown class and statements, some of these between the windows' words."""
        said_ = examples(rng, words)
        x = np.vstack([scaled(windows), scaled(self.vectors.held([w for w, _ in said_]))])
        y = np.zeros((len(x), len(CLASSES)), np.float32)
        y[: len(windows), -1] = 1
        y[np.arange(len(windows), len(x)), [CLASSES.index(f) for _, f in said_]] = 1
        weigh = np.zeros((len(models), len(x), 1), np.float32)
        for k, m in enumerate(models):  # each class a model sees counts alike
            seen = np.array([f not in LEFT_OUT[m] for f in CLASSES])
            weigh[k] = ((y * seen / np.maximum(y.sum(0), 1)).sum(1) / seen.sum())[:, None]
        for _ in range(rounds):
            w, b = self.weights[models, :-1], self.weights[models, -1:]
            z = (x @ np.concatenate(w, 1)).reshape(len(x), len(models), -1).swapaxes(0, 1) + b
            p = np.exp(z - z.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            error = weigh * (y - p)
            slope = (x.T @ np.concatenate(error, 1)).reshape(w.shape[1], len(models), -1).swapaxes(0, 1)
            self.past[models, :-1] = 0.9 * self.past[models, :-1] + slope
            w = w + step * self.past[models, :-1]
            self.weights[models, :-1] = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
            self.weights[models, -1:] = b + 0.5 * step * error.sum(1, keepdims=True)


def family_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The most probable family's probability in each row; without an n-gram of statements it is 0."""
    z = scaled(x) @ weights[:-1] + weights[-1]
    p = np.exp(z - z.max(1, keepdims=True))
    return np.where(x.any(1), p[:, :-1].max(1) / p.sum(1), 0.0)


class Classifier:
    """Sparse word n-gram logistic regression over the families and the unknown class."""

    def __init__(self) -> None:
        self.rows: dict[str, np.ndarray] = {}  # gram -> weights by class
        self.bias = np.zeros(len(CLASSES))
        self.least = 0.5
        self.templates = templates()
        self.pairs: frozenset[tuple[str, str]] = frozenset()
        self.first: frozenset[str] = frozenset()

    def take(self, words: list[str], weights: np.ndarray) -> None:
        """Learned weights, the constant last; n-grams without any are left out."""
        self.rows = {g: w.astype(float) for g, w in zip(words, weights) if w.any()}
        self.bias = weights[-1].astype(float)

    def scores(self, features: set[str]) -> np.ndarray:
        """Probability of each class; without an n-gram of statements the window is unknown."""
        known = sum(g in self.rows for g in features)
        z = self.bias + (np.sum([self.rows[g] for g in sorted(features) if g in self.rows], axis=0) / np.sqrt(known) if known else 0.0)
        p = np.exp(z - z.max())
        return p / p.sum() if known else np.eye(len(CLASSES))[-1]

    def mark(self, usual: dict[str, int], n_windows: int) -> None:
        """The word pairs that show where a statement may lie: those of templates and names that few plain windows have."""
        said_ = [words_of(t.replace("#", "1")) for f in FAMILIES for t in TEMPLATES[f]] + [w for f in FAMILIES for name in NAMES[f] for w in said(name)]
        self.pairs = frozenset(p for words in said_ for p in zip(words, words[1:]) if usual.get(" ".join(p), 0) <= USUAL * n_windows)
        self.first = frozenset(a for a, _ in self.pairs)

    def calibrate(self, passing: dict[int, int], n_windows: int, strangers: list[float]) -> None:
        """The least probability of a family: few plain windows and few statements of families not learned pass it.

        `passing` counts plain windows by their score in steps of 1 / STEPS, rounded down; those under 0.5 need not be there.
        """
        floors, above = [0.5], 0
        for score in sorted(passing, reverse=True):
            above += passing[score]
            if above > ALARMS * n_windows:
                floors.append((score + 1) / STEPS)
                break
        if strangers:
            floors.append(sorted(strangers, reverse=True)[int(STRANGERS * len(strangers))])
        self.least = min(MOST, max(floors))

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """Where statements may lie: runs of marked pairs, and windows of SPAN words, half overlapping, over runs that lie close."""
        first, pairs = self.first, self.pairs
        hits = [i for i, w in enumerate(words[:-1]) if w in first and (w, words[i + 1]) in pairs]
        found, last = [], len(words)
        for gap in (GAP, SPAN // 2):
            start = None
            for i, following in zip(hits, [*hits[1:], None]):
                start = i if start is None else start
                if following is None or following - i > gap:
                    a, b = max(0, start - ROUND), min(last, i + 2 + ROUND)
                    found += [(k, min(b, k + SPAN)) for k in range(a, max(a + 1, b - SPAN // 2), SPAN // 2)]
                    start = None
        return sorted(set(found))

    def fits(self, features: set[str]) -> dict[str, float]:
        """For each family the best share of a template's n-grams, of templates whose family's own n-grams are there too."""
        best: dict[str, float] = {}
        for family, t, own in self.templates:
            share = len(t & features) / len(t)
            if share > best.get(family, 0.0) and len(own & features) >= OWN * len(own):
                best[family] = share
        return best

    def statements(self, paragraph: str) -> list[tuple[str, float, float, bool]]:
        """(family, probability, share of its best template, confirmed) of each window that is not unknown."""
        words = words_of(paragraph)
        found = []
        for a, b in self.windows(words):
            features = set(grams(words[a:b]))
            p = self.scores(features)
            k = int(p[:-1].argmax())
            if p[k] >= self.least:
                fit = self.fits(features)
                share = fit.get(FAMILIES[k], 0.0)
                found.append((FAMILIES[k], float(p[k]), share, share >= CONFIRMED and share >= max(fit.values())))
        return found


def paragraphs(text: str) -> list[str]:
    return BLANK.split(text)


def plain_windows(batches: Iterator[pd.DataFrame], vectors: Vectors) -> Iterator[tuple[int, np.ndarray, list[list[str]]]]:
    """(half, rows, words) of about BLOCK windows at a time: all texts' windows of SPAN words, but for those that share four word
    pairs, or half of them, with a template, being no examples of the unknown class. Equal texts fall into the same half."""
    waiting: list[list[list[str]]] = [[], []]

    def block(half: int) -> tuple[int, np.ndarray, list[list[str]]]:
        words, waiting[half] = waiting[half], []
        x = vectors.held(words)
        kept = vectors.plain(x)
        return half, x[kept], [w for w, k in zip(words, kept) if k]

    for pdf in batches:
        for text in pdf["_text"]:
            words = words_of(text or "")
            half = zlib.crc32((text or "").encode()) & 1
            for at in range(0, len(words), SPAN):
                waiting[half].append(words[at : at + SPAN])
                if len(waiting[half]) >= BLOCK:
                    yield block(half)
    for half in (0, 1):
        if waiting[half]:
            yield block(half)


def fit(docs: DataFrame, id_col: str, text_col: str, seed: int = 11) -> Classifier:
    """A classifier from statements and all windows of all texts.

    The models start from the statements alone. Each task takes them further over its own windows, block by block, and
    the tasks' models are averaged by the number of their windows; so are those of the two halves of the texts, which make the
    classifier. Pairs are marked by their counts over all windows. Every window is scored by the model that has not seen its half,
    which shows the false alarms; models that never saw a third of the families give the probabilities that strangers reach.
    """
    vectors = Vectors()
    start = Learner(vectors)
    start.train(list(range(len(LEFT_OUT))), np.zeros((0, len(vectors.vocabulary)), np.float32), [], random.Random(seed), 150)
    begin, n_models = start.weights, len(LEFT_OUT)
    texts = docs.select(F.col(text_col).alias("_text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        vectors = Vectors()
        learner, rng = Learner(vectors, begin), random.Random(1000 * seed + task)
        seen, usual, first = np.zeros(2, int), np.zeros(len(vectors.vocabulary)), [True, True]
        for half, x, words in plain_windows(batches, vectors):
            if len(x):
                usual += x.sum(0)
                seen[half] += len(x)
                learner.train([0, 1, 2, 3 + half], x, words, rng, FIRST if first[half] else LATER)
                first[half] = False
        if seen.any():
            counts = np.array([seen.sum()] * 3 + [*seen])
            yield pd.DataFrame({"task": [task], "counts": [counts], "usual": [usual], "weights": [(learner.weights * counts[:, None, None]).astype("<f8").tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        weights = sum(np.frombuffer(w, "<f8") for w in pdf["weights"])
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "counts": [sum(pdf["counts"])], "usual": [sum(pdf["usual"])], "weights": [weights.tobytes()]})

    schema = "task int, counts array<long>, usual array<double>, weights binary"
    rows = texts.mapInPandas(learn, schema).groupBy(F.pmod("task", F.lit(SUMS))).applyInPandas(add, schema).collect()
    rows.sort(key=lambda r: r["task"])
    counts = sum((np.array(r["counts"]) for r in rows), np.zeros(n_models, int))
    usual = sum((np.array(r["usual"]) for r in rows), np.zeros(len(vectors.vocabulary)))
    summed = sum((np.frombuffer(r["weights"], "<f8") for r in rows), np.zeros(begin.size)).reshape(begin.shape)
    weights = np.where(counts[:, None, None] > 0, summed / np.maximum(counts, 1)[:, None, None], begin)
    halves, n_windows = weights[3:].astype(np.float32), int(counts[3:].sum())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passing: Counter = Counter()
        for half, x, _ in plain_windows(batches, Vectors()):
            steps = np.floor(family_scores(x, halves[1 - half]) * STEPS).astype(int)
            passing.update(steps[steps >= STEPS // 2].tolist())
        yield pd.DataFrame({"score": [*passing], "n": [*passing.values()]}, dtype="int64")

    passing = {r["score"]: r["n"] for r in texts.mapInPandas(score, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()} if n_windows else {}
    strangers: list[float] = []
    rng = random.Random(seed)
    for m in range(3):
        foreign = [w for w, f in examples(rng, []) if f in LEFT_OUT[m]]
        strangers += family_scores(vectors.held(foreign), weights[m]).tolist()
    model = Classifier()
    model.take(vectors.vocabulary, (weights[3:] * counts[3:, None, None]).sum(0) / n_windows if n_windows else weights[3])
    model.mark({g: int(n) for g, n in zip(vectors.vocabulary, usual)}, n_windows)
    model.calibrate(passing, n_windows, strangers)
    return model


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence, predicted, probability, similarity, n_paragraphs, families) for each row of docs.

    Paragraphs are runs of non-empty lines of the whole text. predicted is the family of the document's most probable
    window (confirmed ones first, of equal ones the first), "unknown" where the classifier finds none; similarity is the
    share of its best template's n-grams in that window. licence is the prediction where a template confirms it, else
    "unknown". n_paragraphs counts paragraphs with a confirmed statement, families lists all their families in order of name,
    so of several licences in one paragraph or line none is lost.
    Null and empty texts are unknown with probability 0. Rows that repeat an id each get a row. An empty table gives no
    rows; null ids are kept; other columns are not read.
    """
    model = fit(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["_text"]:
                found = [s for p in paragraphs(text or "") if (s := model.statements(p))]
                # a window its template confirms goes before one that it does not
                best = max((w for s in found for w in s), key=lambda w: (w[3], w[1]), default=(UNKNOWN, 0.0, 0.0, False))
                sure = {w[0] for s in found for w in s if w[3]}
                out.append((best[0] if best[3] else UNKNOWN, *best[:3], sum(any(w[3] for w in s) for s in found), sorted(sure)))
            frame = pd.DataFrame(out, columns=["licence", "predicted", "probability", "similarity", "n_paragraphs", "families"])
            frame["predicted"] = frame["predicted"].astype(object)
            frame["licence"] = frame["licence"].astype(object)
            frame.insert(0, "_id", pdf["_id"].to_numpy())
            yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "_id long, licence string, predicted string, probability double, similarity double, n_paragraphs long, families array<string>"
    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
