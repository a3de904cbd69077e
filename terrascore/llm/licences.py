"""Find licence statements with a trained paragraph classifier, confirmed by templates.

Features are word 2- and 3-grams that occur in the templates; all others weigh nothing,
so that the model is sparse and a paragraph without any is unknown whatever its
length. A multinomial logistic regression over licence families and ``unknown`` is
trained in numpy: positives are cut-outs of the templates with words left out or
strange words around, negatives are paragraphs of the corpus (a bounded sample), templates whose family's
own words are replaced by strange ones if it is short, and mixed-up template words. Kept-back examples calibrate a
temperature and the probability below which a prediction is ``unknown``. A prediction
stands if enough of the statement's word pairs also occur in one template of the family.

In a paragraph, features that follow each other closely form one stretch, so that a
statement inside a long paragraph is found at its place. A stretch that holds most of the
word pairs of templates of several families, each at a place of its own, is that many
statements; those of one family that follow each other closely are one.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import batch_rows, slices, table, text_or_empty
from terrascore.llm.registry import query

#: Notices and key sentences of public licences, by family.
TEMPLATES = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
    ),
}
UNKNOWN = "unknown"
WORD = re.compile(r"[^\W_]+")
LENGTHS = (2, 3)  # words of an n-gram
GAP = 6  # words between features of one statement
#: Training: cut-outs of each template, corpus paragraphs (documents they come from, of at most so many code points), passes, rate, seed.
CUTS, PARAGRAPHS, DOCUMENTS, DOCUMENT_CHARS, EPOCHS, RATE, SEED = 40, 1500, 300, 20_000, 400, 6.0, 11
#: Parts of the negatives kept back that may be taken for a licence and of the positives that may be missed: the threshold lies
#: halfway between, or where the first is kept. Part of the word pairs of a statement or template (the shorter) that both must have.
MAY_ACCEPT, MAY_MISS, CONFIRM = 0.002, 0.02, 0.6
#: Words of a statement for each of its template, at most; words between two parts of one statement, at most.
LONGEST, APART = 2, 64
#: Training: versions of each template of at most so many words without its family's own words; part of the examples kept back.
STRIPPED, SHORT, KEPT_BACK = 20, 12, 0.25


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]  # word by word: lower case may be longer than the text


def ngrams(words: list[str]) -> Iterator[tuple[str, ...]]:
    for n in LENGTHS:
        yield from zip(*(words[i:] for i in range(n)), strict=False)


@dataclass
class Classifier:
    """Weights of n-grams for each family and ``unknown`` (the last), and what was calibrated."""

    families: list[str]
    feature: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.5
    template_pairs: dict[str, list[frozenset]] = field(default_factory=dict)

    def probabilities(self, statements: list[list[str]]) -> np.ndarray:
        logits = np.array([
            self.bias + self.weights[sorted({self.feature[g] for g in ngrams(w) if g in self.feature})].sum(axis=0)
            for w in statements
        ])
        return _softmax(logits / self.temperature)

    def predict(self, words: list[str]) -> tuple[str, float, bool]:
        """Family of a statement, its probability, and whether a template confirms it; ``unknown`` if too improbable."""
        p = self.probabilities([words])[0]
        best = int(p.argmax())
        if best == len(self.families) or p[best] < self.accept:
            return UNKNOWN, float(p[best]), False
        return self.families[best], float(p[best]), self.confirmed(words, self.families[best])

    def confirmed(self, words: list[str], family: str) -> bool:
        pairs = set(zip(words, words[1:], strict=False))
        # the shorter of the two counts: a statement may be a cut-out of a template, or have words around it
        return any(
            len(words) <= LONGEST * (len(t) + 1) and len(pairs & t) >= CONFIRM * min(len(pairs), len(t))
            for t in self.template_pairs[family] if t and pairs
        )

    def found(self, words: list[str]) -> tuple[list[tuple[int, int, str, float]], bool]:
        """Confirmed statements of a stretch, each with its first and last word, family and probability; whether none confirms a family."""
        family, p, confirmed = self.predict(words)
        whole = [(0, len(words) - 1, family, p)] if confirmed else []
        split: list[tuple[int, int, str, float]] = []
        for a, b, f, q in self.parts(words):
            if split and split[-1][2] == f and a - split[-1][1] <= APART:
                split[-1] = (split[-1][0], b, f, max(q, split[-1][3]))
            else:
                split.append((a, b, f, q))
        families = {f for _, _, f, _ in split}
        if not confirmed or len(families) > 1 and family in families:
            return split, family != UNKNOWN and not split
        return sorted(whole + split) if families - {family} else whole, False

    def parts(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """Places in order where most pairs of a template lie and its family is predicted; where some overlap, the one with most.

        One pass finds the pairs of all templates. A place is at most twice as long as its template, so that what
        overlaps and is looked at again is bounded as well.
        """
        pairs = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for t in self.holders.get(pair, ()):
                hits.setdefault(t, []).append(i)
        waiting = [run for t, at in hits.items() for run in self.runs(t, pairs, at)]
        heapq.heapify(waiting)
        taken: list[tuple[int, int, str, float]] = []
        while waiting:
            _, a, b, t = heapq.heappop(waiting)
            # those that end at or after its start and start at or before its end
            first, last = bisect_left(taken, a, key=lambda x: x[1]), bisect_right(taken, b, key=lambda x: x[0])
            over = taken[first:last]
            if over:  # what the others leave of it
                for lo, hi in zip([a, *(x[1] + 1 for x in over)], [*(x[0] - 1 for x in over), b], strict=True):
                    at = hits[t]
                    for run in self.runs(t, pairs, at[bisect_left(at, lo) : bisect_left(at, hi)]):
                        heapq.heappush(waiting, run)
                continue
            name, p, confirmed = self.predict(words[a : b + 1])
            if confirmed and name == self.templates[t][0]:
                taken.insert(first, (a, b, name, p))
        return taken

    def runs(self, t: int, pairs: list[tuple[str, str]], at: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """Runs that hold most pairs of a template, from the places of its pairs: less its gain, first and last word, template.

        A new pair of the template counts for a run, any other against it; a run ends where it gains most, and the next
        one is sought from there.
        """
        size, k = len(self.templates[t][1]), 0
        while len(at) - k >= CONFIRM * size:
            gain, seen, before = 0, set(), at[k] - 1
            best = (0, k, 0)
            for j in range(k, len(at)):
                gain -= at[j] - before - 1
                if gain <= 0 and seen or len(seen) == size:
                    break
                gain += -1 if pairs[at[j]] in seen else 1
                seen.add(pairs[at[j]])
                before = at[j]
                if gain > best[0]:
                    best = (gain, j, len(seen))
            if best[2] >= CONFIRM * size:
                yield -best[0], at[k], at[best[1]] + 1, t
            k = best[1] + 1

    def statements(self, paragraph: str) -> Iterator[tuple[int, int, list[str]]]:
        """Start, end and words of the statements in a paragraph: n-grams of the model that are close to each other."""
        words = words_of(paragraph)
        if self.pairs.isdisjoint(zip(words, words[1:], strict=False)):
            return
        places = [m.span() for m in WORD.finditer(paragraph)]
        start = end = None
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            if pair in self.pairs:
                if start is not None and i > end + GAP:
                    yield places[start][0], places[end][1], words[start : end + 1]
                    start = None
                start, end = i if start is None else start, i + 1
        yield places[start][0], places[end][1], words[start : end + 1]

    def __post_init__(self):
        self.pairs = {g for g in self.feature if len(g) == 2}
        self.templates = [(f, t) for f, all_of in self.template_pairs.items() for t in all_of if t]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, t) in enumerate(self.templates):
            for pair in t:
                self.holders.setdefault(pair, []).append(i)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(paragraphs: list[str], seed: int = SEED) -> Classifier:
    """A classifier from the templates and a sample of ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    texts = [(f, words_of(t)) for f in families for t in TEMPLATES[f]]
    feature = {g: i for i, g in enumerate(sorted({g for _, w in texts for g in ngrams(w)}))}
    strange = [w for p in paragraphs for w in words_of(p)] or ["und", "les", "of"]
    vocabulary = sorted({w for _, t in texts for w in t})

    def some(n: int, of: list[str]) -> list[str]:
        return [of[i] for i in rng.integers(0, len(of), n)]

    examples: list[tuple[list[str], int]] = []
    for family, words in texts:
        for cut in range(CUTS):
            size = len(words) if cut % 4 == 0 else int(rng.integers(min(4, len(words)), len(words) + 1))
            at = int(rng.integers(0, len(words) - size + 1))
            kept = [w for w in words[at : at + size] if size < 8 or rng.random() > 0.05]
            examples.append((some(int(rng.integers(0, 6)), strange) + kept + some(int(rng.integers(0, 6)), strange), families.index(family)))
    ordinary = len(examples)
    for p in paragraphs[:PARAGRAPHS]:
        examples.append((words_of(p), len(families)))
    stripped = len(examples)
    used_by = {w: {f for f, t in texts if w in t} for w in vocabulary}
    pairs_of = {f: [frozenset(zip(words, words[1:], strict=False)) for g, words in texts if g == f] for f in families}
    judge = Classifier(families, {}, np.zeros(0), np.zeros(0), template_pairs=pairs_of)
    # a short statement without what names its family is no licence that is known, unless it is another's
    for family, words in texts:
        own = [len(used_by[w]) == 1 for w in words]
        for _ in range(STRIPPED if len(words) <= SHORT and any(own) else 0):
            bare = [some(1, strange)[0] if x else w for x, w in zip(own, words, strict=True)]
            if not any(judge.confirmed(bare, f) for f in families if f != family):
                examples.append((some(int(rng.integers(0, 6)), strange) + bare + some(int(rng.integers(0, 6)), strange), len(families)))
    mixed = len(examples)
    for _ in range(ordinary):  # words of licences in no order are no licence
        examples.append((some(int(rng.integers(3, 15)), vocabulary + ["of", "the", "and", "is"] * 10), len(families)))
    x = np.zeros((len(examples), len(feature)), np.float32)
    for row, (words, _) in enumerate(examples):
        x[row, [feature[g] for g in ngrams(words) if g in feature]] = 1
    y = np.array([k for _, k in examples])
    order = rng.permutation(len(y))
    held, used = order[: int(len(y) * KEPT_BACK)], order[int(len(y) * KEPT_BACK) :]
    classes = len(families) + 1
    target = np.eye(classes, dtype=np.float32)[y]
    # every family weighs the same, and so do the three kinds of negatives
    kind = y + np.searchsorted([stripped, mixed], np.arange(len(y)), side="right")
    row_weight = (1 / (np.bincount(kind[used])[kind[used]] * (classes + 2))).astype(np.float32)[:, None]
    w, b = np.zeros((len(feature), classes), np.float32), np.zeros(classes, np.float32)
    for _ in range(EPOCHS):
        error = (_softmax(x[used] @ w + b) - target[used]) * row_weight
        w -= RATE * (x[used].T @ error + 1e-5 * w)
        b -= RATE * error.sum(axis=0)
    logits = x[held] @ w + b
    at = np.arange(len(held))
    losses = {t: -np.mean(np.log(np.maximum(_softmax(logits / t)[at, y[held]], 1e-12))) for t in np.geomspace(0.02, 5, 41)}
    temperature = min(losses, key=losses.get)
    p = _softmax(logits / temperature)
    # how probable the families are that templates confirm, in examples of none and of their own
    wrong, right = [0.0], [1.0]
    for i, q, best in zip(held, p, p[:, :-1].argmax(axis=1), strict=True):
        confirmed = judge.confirmed(examples[i][0], families[best])
        if y[i] == len(families):
            wrong.append(q[best] if confirmed else 0.0)
        elif confirmed and y[i] == best:
            right.append(q[best])
    least, most = np.quantile(wrong, 1 - MAY_ACCEPT), np.quantile(right, MAY_MISS)
    accept = float(least + most) / 2 if least < most else float(least)
    return Classifier(families, feature, w.astype(np.float64), b.astype(np.float64), float(temperature), accept, pairs_of)


def sample_paragraphs(rows: DataFrame, key: str, text: str) -> list[str]:
    """Paragraphs of a bounded sample of documents, drawn by a hash of the key; those that name a licence are left out."""
    steps = 1 << 30
    share = min(1.0, DOCUMENTS / max(1, rows.count()))
    body = F.col(f"`{text}`")
    drawn = rows.where(
        (F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(SEED)), F.lit(steps)) < int(share * steps))
        & (F.char_length(body) <= DOCUMENT_CHARS)
    ).select(F.xxhash64(F.col(f"`{key}`"), F.lit(SEED)).alias("h"), body.cast("string").alias("t")).collect()
    found = [p for r in sorted(drawn, key=lambda r: (r["h"], r["t"])) for p in r["t"].split("\n") if p.strip()]
    return [p for p in found if not re.search("licen[cs]|copyright|rights reserved|public domain", p.lower())][:PARAGRAPHS]


def scan_licences(rows: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or their columns ``keep``) with the licences that their texts state.

    ``licences``: the families, sorted, joined by commas (empty if none).
    ``n_statements``: confirmed statements. ``n_unknown``: those that the classifier finds and no template confirms. ``spans``: ``family:start:end`` of confirmed statements in code points, end exclusive,
    by start, joined by commas. ``score``: the largest probability among them, null if there are none.
    A null or empty text has none. Columns of ``rows`` with a result's name are replaced.
    """
    made = "licences string, n_statements long, n_unknown long, spans string, score double"
    names = [f.split(" ")[0] for f in made.split(", ")]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in names]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    batch_rows(rows.sparkSession)
    body = "__text_to_scan"
    source = rows.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, body):
            out = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                found, unknown, at = [], 0, 0
                for paragraph in value.split("\n"):
                    for start, end, words in model.statements(paragraph):
                        stated, strange = model.found(words)
                        places = [m.span() for m in WORD.finditer(paragraph, start, end)] if stated else []
                        found += [(at + places[a][0], at + places[b][1], family, p) for a, b, family, p in stated]
                        unknown += strange
                    at += len(paragraph) + 1
                out.append((
                    ",".join(sorted({f for _, _, f, _ in found})), len(found), unknown,
                    ",".join(f"{f}:{s}:{e}" for s, e, f, _ in found), max((p for *_, p in found), default=None),
                ))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, made]))


@query("op5_scan_licences")
def op5_scan_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, train(sample_paragraphs(docs, "doc_id", "text")), keep=["doc_id"])
