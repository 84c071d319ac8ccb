"""Licence scans by a trained paragraph classifier.

Sparse word n-grams (one to three words) of a paragraph feed a multinomial logistic regression over
licence families and "none". It is trained on worn copies of the families' notices (words dropped,
corpus words put in) against paragraphs of a bounded sample of the corpus. The probability that a
family must reach is calibrated on held-out paragraphs of that sample; what looks like a licence
but does not reach it, or whose words do not follow the family's notice, is ``unknown``: each
prediction is confirmed by the longest common subsequence with a notice.

Every line of every text is read, and every paragraph (lines up to one without a word) with its lines
joined, since notices are wrapped; long ones in overlapping windows. One pass, without a shuffle of
texts.

Defined results: one row for each document and family found, with the number of passages that do not
overlap and the best probability and likeness; what is part of a confirmed notice is not unknown as
well; documents without a licence have none. Null and empty texts have
none; repeated rows count once; a null id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import small_batches, table
from platewise.llm.decontam import lcs, masks_of, words
from platewise.llm.toxicity import scaling

MAX_SAMPLE_DOCS = 400
COPIES = 40
WINDOW, STEP = 40, 20
CONFIRM = 0.75
SURE = 0.8
NONE = "none"

# Words without which nothing is an unknown licence.
CUES = frozenset(b"license licence licensed licenced licensing copyright copyrighted permission permitted granted redistribution redistribute warranty rights confidential proprietary".split())

# Notices by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "either version 3 of the License, or (at your option) any later version", "GNU GPL version 2 or later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1", "GNU LGPL version 3"],
    "agpl": ["licensed under the GNU Affero General Public License, version 3"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Released under the BSD 3-Clause License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "public-domain": ["This work has been dedicated to the public domain", "Released under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
SCHEMA = "doc_id bigint, family string, passages bigint, probability double, likeness double"


def grams(ws: list[bytes]) -> set[bytes]:
    return {b" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def windows(ws: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    if len(ws) <= WINDOW:
        yield 0, ws
    else:
        for i in range(0, len(ws) - STEP, STEP):
            yield i, ws[i : i + WINDOW]


def passages(lines: list[list[bytes]]) -> list[tuple[int, int, list[bytes]]]:
    """Passages of a paragraph as first word, last word and words: its lines, then windows across lines."""
    out, of_line = [], []
    for k, line in enumerate(lines):
        out += [(len(of_line) + i, len(of_line) + i + len(ws), ws) for i, ws in windows(line)]
        of_line += [k] * len(line)
    if len(lines) > 1:
        across = windows([w for line in lines for w in line])
        out += [(i, i + len(ws), ws) for i, ws in across if of_line[i] != of_line[i + len(ws) - 1]]
    return out


def paragraphs(text: str | None) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Passages of each paragraph; words have no comment marks, so a bare mark is an empty line."""
    lines: list[list[bytes]] = []
    for line in (text or "").split("\n"):
        ws = words(line)
        if ws:
            lines.append(ws)
        elif lines:
            yield passages(lines)
            lines = []
    if lines:
        yield passages(lines)


class Spans:
    """Words of a paragraph that are taken."""

    def __init__(self, n: int):
        self.taken = bytearray(n)

    def add(self, first: int, last: int) -> None:
        self.taken[first:last] = b"\1" * (last - first)

    def meet(self, first: int, last: int) -> bool:
        return self.taken.find(1, first, last) >= 0


class Classifier:
    """Families and "none" from word n-grams, with the probability that counts as sure."""

    def __init__(self, corpus: list[str], seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.families = [*NOTICES, NONE]
        self.notices = {f: [words(n) for n in ns] for f, ns in NOTICES.items()}
        known = sorted({g for ns in self.notices.values() for n in ns for g in grams(n)})
        self.index = {g: i for i, g in enumerate(known)}
        self.slope, self.shift = 1.0, 0.0
        self.words = frozenset(g for g in known if b" " not in g)
        # what follows a notice closely, or shares words with what does, is no example of "none"
        plain = []
        for part in (part for t in corpus for part in paragraphs(t)):
            close = Spans(max(b for _, b, _ in part))
            for a, b, p in part:
                if self.likeness(p)[1] >= CONFIRM:
                    close.add(a, b)
            plain += [p for a, b, p in part if not close.meet(a, b)]
        held = plain[::4]
        train = [p for i, p in enumerate(plain) if i % 4]
        filler = [w for p in train[:2000] for w in p] or [b"text"]
        xs, ys, kept_out = [], [], []
        for y, (f, ns) in enumerate(self.notices.items()):
            for n in ns:
                for i in range(COPIES):
                    kept = [w for w in n if rnd.random() > 0.1] or n
                    at, k = rnd.integers(0, len(filler)), rnd.integers(0, 12)
                    worn = kept + filler[at : at + k]
                    if i % 4 == 3:
                        kept_out.append((worn, f))
                    else:
                        xs.append(self.features(worn))
                        ys.append(y)
        # passages with the same features are one example with a weight
        rest: dict[tuple[int, ...], int] = {}
        for p in [*train, []]:
            x = self.features(p)
            rest[x] = rest.get(x, 0) + 1
        xs += list(rest)
        ys += [len(self.families) - 1] * len(rest)
        weight = np.array([1.0] * (len(xs) - len(rest)) + [min(v, 200.0) for v in rest.values()])
        self._train(xs, np.array(ys), weight)
        self._calibrate(kept_out + [(p, NONE) for p in held if len(self.words.intersection(p)) >= 2])

    def _calibrate(self, examples: list[tuple[list[bytes], str]]) -> None:
        """Slope and shift of the log odds of a family, from examples outside the training set."""
        self.slope, self.shift = 1.0, 0.0
        said = [(self.predict(ws), f) for ws, f in examples]
        z = np.array([math.log(max(p, 1e-9) / max(1 - p, 1e-9)) for (_, p, _), _ in said])
        right = np.array([name == f for (name, _, _), f in said], dtype=int)
        self.slope, self.shift = scaling(z, right) if len(said) else (1.0, 0.0)
        named = [(self._named(ws), f) for ws, f in examples]
        copies, plain = [x for x in named if x[1] != NONE], [x for x in named if x[1] == NONE]
        share = lambda xs, test: sum(map(test, xs)) / max(1, len(xs))
        self.report = {
            "right": share(copies, lambda x: x[0] == x[1]),
            "unknown": share(copies, lambda x: x[0] == "unknown"),
            "missed": share(copies, lambda x: x[0] == NONE),
            "false": share(plain, lambda x: x[0] != NONE),
        }

    def _named(self, ws: list[bytes]) -> str:
        """What a single passage is called."""
        family, p, any_ = self.predict(ws)
        if any_ < 0.5:
            return NONE
        if p >= SURE and self.likeness(ws, family)[1] >= CONFIRM:
            return family
        return NONE if CUES.isdisjoint(ws) else "unknown"

    def features(self, ws: list[bytes]) -> tuple[int, ...]:
        # parts of a known gram are known grams
        out = set()
        for i, w in enumerate(ws):
            for n in (2, 3, 4):
                k = self.index.get(w)
                if k is None:
                    break
                out.add(k)
                if n == 4 or i + n > len(ws):
                    break
                w = w + b" " + ws[i + n - 1]
        return tuple(sorted(out))

    def _train(self, xs, ys, weight, ridge: float = 1e-3, steps: int = 300, rate: float = 0.5) -> None:
        x = np.zeros((len(xs), len(self.index) + 1), np.float32)
        for i, f in enumerate(xs):
            x[i, list(f)] = 1
        x[:, -1] = 1
        goal = np.eye(len(self.families), dtype=np.float32)[ys]
        share = (weight / weight.sum()).astype(np.float32)[:, None]
        w, m, v = (np.zeros((x.shape[1], len(self.families)), np.float32) for _ in range(3))
        for t in range(1, steps + 1):  # Adam on the weighted cross entropy
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - goal) * share) + ridge * w / len(x)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w

    def predict(self, ws: list[bytes]) -> tuple[str, float, float]:
        """Best family, its calibrated probability, and the model's probability of any licence."""
        z = self.weights[-1] + self.weights[list(self.features(ws))].sum(0)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p[:-1].argmax())
        odds = math.log(max(float(p[best]), 1e-9) / max(1 - float(p[best]), 1e-9))
        sure = 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * odds + self.shift))))
        return self.families[best], sure, float(1 - p[-1])

    def likeness(self, ws: list[bytes], family: str | None = None) -> tuple[str, float]:
        """The notice that a passage follows most closely: family and share of its words in order."""
        best = (NONE, 0.0)
        if len(self.words.intersection(ws)) < 2:
            return best
        for f in [family] if family else self.notices:
            for n in self.notices[f]:
                s = lcs(masks_of(n), len(n), ws) / len(n)
                if s > best[1]:
                    best = (f, s)
        return best

    def scan(self, text: str | None) -> dict[str, tuple[int, float, float]]:
        """family → (passages, best probability, best likeness) of a text."""
        out: dict[str, tuple[int, float, float]] = {}

        def add(name: str, p: float, like: float, more: bool) -> None:
            n, bp, bl = out.get(name, (0, 0.0, 0.0))
            out[name] = (n + more, max(bp, p), max(bl, like))

        for part in paragraphs(text):
            size = max(b for _, b, _ in part)
            taken: dict[str, Spans] = {}
            sure, unsure = [], []
            for a, b, ws in part:
                if len(self.words.intersection(ws)) < 2:
                    continue  # no notice has fewer words
                family, p, any_ = self.predict(ws)
                if any_ < 0.5:
                    continue
                like = self.likeness(ws, family)[1]
                (sure if p >= SURE and like >= CONFIRM else unsure).append((a, b, ws, family, p, like))
            known = Spans(size)
            for a, b, _, family, p, like in sure:
                known.add(a, b)
                spans = taken.setdefault(family, Spans(size))
                add(family, p, like, not spans.meet(a, b))
                spans.add(a, b)
            sure.sort(key=lambda x: x[0])
            starts = [x[0] for x in sure]
            unknown = Spans(size)
            for a, b, ws, family, p, like in unsure:
                if CUES.isdisjoint(ws) or (family in taken and taken[family].meet(a, b)):
                    continue
                near = sure[bisect_left(starts, b - WINDOW) : bisect_right(starts, a)]
                if any(self._needs(x, a, b) for x in near):
                    continue
                rest = [w for w, k in zip(ws, known.taken[a:b]) if not k]
                if 0 < len(rest) < len(ws) and self.predict(rest)[2] < 0.5:
                    continue  # the confirmed part was what looked like a licence
                add("unknown", p, like, not unknown.meet(a, b))
                unknown.add(a, b)
        return out

    def _needs(self, passage: tuple, first: int, last: int) -> bool:
        """Whether words of a confirmed passage are part of what confirms it."""
        a, b, ws, family, _, like = passage
        return a <= first and last <= b and self.likeness(ws[: first - a] + ws[last - a :], family)[1] < like


def fit(docs: DataFrame, max_docs: int = MAX_SAMPLE_DOCS) -> Classifier:
    """Trained on the notices and on the texts of at most ``max_docs`` documents (least hash of id)."""
    sample = docs.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.join(F.broadcast(sample.distinct()), "doc_id").select("text")
    return Classifier([r.text for r in texts.orderBy("text").limit(2 * max_docs).collect()])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [(i, f, *v) for i, t in zip(pdf.doc_id.astype("Int64"), pdf.text) for f, v in m.scan(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "family", "passages", "probability", "likeness"]).astype({"doc_id": "Int64", "family": object})

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, SCHEMA)
    return found.groupBy("doc_id", "family").agg(*[F.max(c).alias(c) for c in ("passages", "probability", "likeness")])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs))
