"""Licence scan: a trained paragraph classifier over sparse word n-grams, with an unknown class and a second look.

A multinomial logistic regression on word 1- to 3-grams names the licence family of a paragraph. It learns from variants of
template notices and, as the unknown class, from windows of a bounded sample of the documents' lines and from sentences
that speak of licences without giving one. Held-out variants set a temperature for its probabilities and the least
probability that counts as known. A named family is confirmed only if a template of it holds enough of the paragraph's
word pairs, or the other way round. A line is judged by overlapping windows, by its sentences and by runs of known words, so
no text is left out and a line may hold several licences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*")
SENTENCE = re.compile(r"(?<=[.;!?])\s+")
WINDOW, STEP = 60, 30
UNKNOWN = "unknown"

# What families are called, and customary notices of their own.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "mit": ["MIT License", "MIT license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2 or later", "GNU GPL v3"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL v3"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, Version 1.0"],
    "isc": ["ISC License", "ISC license"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
}
SPDX: dict[str, list[str]] = {
    "apache-2.0": ["Apache-2.0"], "mit": ["MIT"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"], "lgpl": ["LGPL-2.1-or-later"], "agpl": ["AGPL-3.0-or-later"], "mpl": ["MPL-2.0"],
    "epl": ["EPL-2.0"], "isc": ["ISC"], "boost": ["BSL-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "public-domain": ["CC0-1.0", "Unlicense"],
}
OWN: dict[str, list[str]] = {
    "apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "The author has placed this work in the public domain."],
}
FRAMES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}.", "This project is released under the {}."]
#: By family: its names in every frame, its identifiers, and its own notices.
TEMPLATES: dict[str, list[str]] = {f: [frame.format(n) for n in NAMES.get(f, ()) for frame in FRAMES] + [f"SPDX-License-Identifier: {x}" for x in SPDX[f]] + OWN.get(f, []) for f in SPDX}
# Sentences about licences that give none.
ASIDES = [
    "You need a driving license to rent a car in most countries.",
    "The team licensed the song for a film released in the spring.",
    "Students at the university work under the terms of their contract.",
    "A new version of the software was released this week.",
    "The foundation published a general report on public works.",
    "Please read the terms and conditions before you use this service.",
    "All rights reserved.",
    "The license fee is due in the first month of the year.",
    "Commons in the village are open to the public.",
    "The Apache helicopter was shown to the public in version two of the exhibit.",
    "He works at MIT and lives near the campus.",
    "Permission to land was granted by the tower.",
]


def grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def pairs(ws: list[str]) -> set[tuple[str, ...]]:
    return set(zip(ws, ws[1:])) or set(zip(ws))


class Classifier:
    """Weights by n-gram and class; the last class is unknown."""

    def __init__(self, families: list[str], index: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float, similar: float):
        self.families, self.index, self.weights, self.bias = families, index, weights, bias
        self.temperature, self.least, self.similar = temperature, least, similar
        self.words = {g for g in index if " " not in g}
        self.templates = {f: [pairs(WORD.findall(t.lower())) for t in TEMPLATES[f]] for f in families[:-1]}
        #: For each word pair of the templates the size of the smallest one that has it.
        self.smallest: dict[tuple[str, ...], int] = {}
        for t in sorted((t for ts in self.templates.values() for t in ts), key=len):
            for p in t:
                self.smallest.setdefault(p, len(t))

    def _found(self, ws: list[str]) -> list[int]:
        """The known n-grams of ws, each once; one of several words is made only where all of them are known."""
        out, index, words, two, one = set(), self.index, self.words, None, None
        for w in ws:
            if w not in words:
                two = one = None
                continue
            out.add(index[w])
            if one is not None:
                out.add(index.get(f"{one} {w}"))
                if two is not None:
                    out.add(index.get(f"{two} {one} {w}"))
            two, one = one, w
        out.discard(None)
        return list(out)

    def _hopeless(self, mine: set[tuple[str, ...]]) -> bool:
        """Whether too few word pairs are any template's for one to confirm a family."""
        sizes = [self.smallest[p] for p in mine if p in self.smallest]
        return not sizes or len(sizes) < self.similar * min(len(mine), min(sizes))

    def logits(self, ws: list[str]) -> np.ndarray:
        """Each known n-gram counts 1 over the root of all n-grams, so words that no notice has pull towards the unknown."""
        found = self._found(ws)
        scale = 1 / math.sqrt(max(1, 3 * len(ws) - 3))
        return self.bias + self.weights[found].sum(axis=0) * scale

    def probabilities(self, ws: list[str]) -> np.ndarray:
        z = self.logits(ws) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, ws: list[str]) -> tuple[str, float, float]:
        """(family or unknown, its calibrated probability, likeness to its best template); the probability isn't worked out, but
        given as 0, where no template could confirm a family."""
        mine = pairs(ws)
        if self._hopeless(mine):
            return UNKNOWN, 0.0, 0.0
        p = self.probabilities(ws)
        k = int(p.argmax())
        if k == len(self.families) - 1 or p[k] < self.least:
            return UNKNOWN, float(p[-1]), 0.0
        like = max(len(mine & t) / max(1, min(len(mine), len(t))) for t in self.templates[self.families[k]])
        return (self.families[k], float(p[k]), like) if like >= self.similar else (UNKNOWN, float(p[k]), like)

    def paragraphs(self, text: str | None) -> Iterator[tuple[int, str, float, float]]:
        """(paragraph number, family, probability, likeness) of each paragraph's confirmed licences, by family; of a family's places in
        a paragraph the one of the greatest probability, then likeness, counts."""
        for n, line in enumerate((text or "").split("\n")):
            ws = WORD.findall(line.lower())
            if sum(w in self.words for w in ws) < 2:
                continue  # at most one known word leaves every class but unknown below its threshold
            if len(ws) > 1 and not any(map(self.smallest.__contains__, zip(ws, ws[1:]))):
                continue  # no part of it can be confirmed
            best: dict[str, tuple[float, float]] = {}
            for part in self._parts(line, ws):
                family, p, like = self.judge(part)
                if family != UNKNOWN and (p, like) > best.get(family, (0.0, 0.0)):
                    best[family] = (p, like)
            for family in sorted(best):
                yield n, family, *best[family]

    def _parts(self, line: str, ws: list[str]) -> Iterator[list[str]]:
        """What is judged of a line: windows over all of it, and within longer ones runs and sentences of mostly known words."""
        for at in range(0, max(1, len(ws) - WINDOW + STEP), STEP):
            yield ws[at : at + WINDOW]
            if len(ws) > 12:
                yield from (ws[s : s + n] for s, n in self._near(ws, at) if n < len(ws))
        said = SENTENCE.split(line.lower())
        for sentence in map(WORD.findall, said if len(said) > 1 else ()):
            if 3 <= len(sentence) <= WINDOW and 2 * sum(w in self.words for w in sentence) >= len(sentence):
                yield sentence

    def _near(self, ws: list[str], at: int) -> Iterator[tuple[int, int]]:
        """Runs of a window in which most words are known, as notices within prose are."""
        stop, start, gap = min(len(ws), at + WINDOW), None, 0
        for i in range(at, stop + 1):
            known = i < stop and ws[i] in self.words
            if known:
                start, gap = i if start is None else start, 0
            elif start is not None:
                gap += 1
                if gap > 1 or i == stop:
                    n = i - gap + 1 - start
                    if n >= 3:
                        yield start, n
                    start = None


def variants(ws: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """ws itself and n variants: a word dropped, another put in, words before or behind."""
    fill = ["this", "file", "is", "the", "project", "see", "text", "for", "details", "copyright", "authors"]
    out = [ws]
    for _ in range(n):
        v = list(ws)
        if len(v) > 5 and rng.random() < 0.4:
            v.pop(int(rng.integers(len(v))))
        if rng.random() < 0.3:
            v.insert(int(rng.integers(len(v) + 1)), fill[int(rng.integers(len(fill)))])
        if rng.random() < 0.3:
            v = [fill[int(rng.integers(len(fill)))] for _ in range(int(rng.integers(1, 4)))] + v
        out.append(v)
    return out


class _Sums:
    """Sums of the rows of an array that have the same number, by one sort made beforehand."""

    def __init__(self, numbers: np.ndarray, n: int):
        self.order, self.shape = np.argsort(numbers, kind="stable"), n
        self.at = np.searchsorted(numbers[self.order], np.arange(n))
        self.some = np.bincount(numbers, minlength=n) > 0

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape, values.shape[1]))
        if self.some.any():
            out[self.some] = np.add.reduceat(values[self.order], self.at[self.some])
        return out


def fit(negatives: list[str], per_template: int = 6, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4, similar: float = 0.6, seed: int = 5) -> Classifier:
    """Trains on three quarters of the variants and negatives; the rest sets the temperature and the least probability, under
    which no held-out negative lies, and which is a half at least."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    known = set().union(*[pairs(WORD.findall(t.lower())) for ts in TEMPLATES.values() for t in ts])
    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(families[:-1]):
        for t in TEMPLATES[f]:
            rows += [(v, k) for v in variants(WORD.findall(t.lower()), rng, per_template)]
    for t in [*ASIDES, *negatives]:
        ws = WORD.findall(t.lower())
        if ws and len(pairs(ws) & known) < max(3, 0.3 * len(pairs(ws))):
            rows += [(v, len(families) - 1) for v in variants(ws, rng, 8 if t in ASIDES else 0)]
    held = rng.random(len(rows)) < 0.25
    seen: dict[str, int] = {}
    for (ws, k), h in zip(rows, held):
        if k < len(families) - 1 and not h:
            for g in grams(ws):
                seen.setdefault(g, len(seen))
    classes = len(families)
    lines, cols, vals = [], [], []
    for r, (ws, _) in enumerate(rows):
        found = [seen[g] for g in grams(ws) if g in seen]
        lines += [r] * len(found)
        cols += found
        vals += [1 / math.sqrt(max(1, 3 * len(ws) - 3))] * len(found)
    lines, cols, vals = np.array(lines, dtype=int), np.array(cols, dtype=int), np.array(vals)[:, None]
    by_row, by_gram = _Sums(lines, len(rows)), _Sums(cols, len(seen))
    y = np.array([k for _, k in rows])
    weight = np.where(held, 0.0, 1.0 / np.bincount(y[~held], minlength=classes).clip(1)[y])
    weight /= weight.sum()
    w, b = np.zeros((len(seen), classes)), np.zeros(classes)

    def logits() -> np.ndarray:
        return b + by_row(w[cols] * vals)

    step = np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), y] -= 1
        p *= weight[:, None]
        g = by_gram(p[lines] * vals) + decay * w / len(rows)
        step += g * g
        w -= rate * g / np.sqrt(step) * 0.1
        b -= rate * p.sum(axis=0)
    z = logits()[held]
    truth = y[held]

    def nll(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    temperature = min((0.25 * 1.1**k for k in range(40)), key=nll)
    p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    foreign = p[truth == classes - 1, :-1]
    least = min(0.9, max(0.5, float(foreign.max()) if len(foreign) else 0.5))
    return Classifier(families, seen, w, b, temperature, least, similar)


def _one_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line the window of least hash."""
    for b in batches:
        out = []
        for line in b.column("line").to_pylist():
            ws = WORD.findall(line.lower())
            windows = [" ".join(ws[at : at + WINDOW]) for at in range(0, max(1, len(ws) - WINDOW + STEP), STEP)]
            out.append(min((xxhash.xxh64_intdigest(w, 11) >> 1, w) for w in windows))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string())], ["h", "words"])


def train(docs: DataFrame, negative_lines: int = 2000) -> Classifier:
    """A classifier whose unknown class has seen one window of each of at most `negative_lines` different lines, drawn by their
    hash from the whole texts of all documents: what bounds the sample, and what the driver holds."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    total = texts.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    share = min(1.0, 3.0 * negative_lines / max(1, total))  # more than are needed, as lines repeat
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    drawn = lines.where((F.xxhash64("line").bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(share * (1 << 53)))) & (F.trim("line") != "")).distinct()
    some = drawn.mapInArrow(_one_window, "h long, words string").where("words <> ''").orderBy("h", "words").limit(negative_lines).collect()
    return fit(sorted({r.words for r in some}))


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_paragraphs and licences (paragraph, family, probability, likeness) of each row of docs (doc_id, text).

    Null and empty texts have one empty paragraph and no licence. Rows without doc_id and repeated rows are each scanned; other
    columns are ignored; an empty table gives no rows. Of families equally likely the first by name counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # grows with the templates alone
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [[dict(zip(("paragraph", "family", "probability", "likeness"), x)) for x in c.paragraphs(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array(found, kind)], ["doc_id", "n_paragraphs", "licences"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_paragraphs long, licences array<struct<paragraph:long,family:string,probability:double,likeness:double>>")
