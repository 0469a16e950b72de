"""Operator 1, licence scans: a trained paragraph classifier.

A paragraph is a line of a text, or consecutive lines that a notice is wrapped
over (``wrapped``): lines are joined when the words at the break are in a template
too, or both hold three words of one; the first line's number stands for all.  Sparse word n-grams (1 to 3 words) feed a
multinomial logistic regression over licence families and the class "none".
It is trained in numpy on the driver: positives are the notice templates below,
varied (cut, with neighbouring words, with copyright lines); negatives are
paragraphs of a bounded sample of the corpus (``SAMPLE_DOCS`` documents of
smallest hash) that no template resembles.

Calibration, on a held-out fold: a temperature for the probabilities, and per
family the least probability that keeps the false alarm rate on negatives below
``FALSE_ALARMS``.  A paragraph that is more likely a notice than none, but whose
family stays below its threshold or is not confirmed, is class "unknown".

Confirmation: the share of a template's word n-grams that the paragraph holds
must reach ``CONFIRM`` for some template of the predicted family, or the paragraph
must be one of its short notices ("License: MIT").

Scanning is one pass without a shuffle.  Word n-grams are hashed for a whole
batch at once; a bitmap lookup finds those of the vocabulary.  Paragraphs with an
n-gram (1 to 3 words) that weighs more for some family than for none are classified,
all of a batch at once.

Defined cases: null and empty texts have no paragraphs and no notices; an empty
corpus trains on templates alone.  Repeated rows give repeated results.  Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import clean_text, enter, query, small_batches, table
from plantlens.llm.words import ALNUM, LOWER, Words, grams, segmented

SAMPLE_DOCS = 400
NGRAMS = (1, 2, 3)
CONFIRM = 0.6
FALSE_ALARMS = 0.001
EPOCHS, RATE, DECAY, SEED = 150, 0.5, 1e-4, 3
_BITS = 20

#: Short notices by licence family.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Released under the Apache 2.0 license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Licensed under the GNU GPL v3 or later.", "Licensed under the GNU General Public License v2."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL v3."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL v3."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Released under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "This is free and unencumbered software released into the public domain."),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this work may be reproduced without written permission of the publisher."),
}
#: Short names by licence family, as they stand in notices of the ``FORMS``.
NAMES = {
    "mit": ("MIT",), "apache": ("Apache-2.0", "Apache 2.0"),
    "gpl": ("GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-only", "GPL-2.0-or-later", "GPL v3"),
    "lgpl": ("LGPLv3", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"), "agpl": ("AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause"), "mpl": ("MPL-2.0", "MPL 2.0"), "isc": ("ISC",), "cc-by": ("CC-BY-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc0": ("CC0-1.0",),
}
FORMS = ("License: {}", "Licence: {}", "SPDX-License-Identifier: {}", "{} License")
#: Names that are also words or names of other things: a paragraph of nothing else is no notice.
AMBIGUOUS = ("MIT", "ISC")
FAMILIES = tuple(TEMPLATES)
NONE = len(FAMILIES)


def _words(text: str) -> Words:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Words(data, np.array([0, len(data)]), ALNUM)


def features(h: np.ndarray) -> np.ndarray:
    """Distinct n-gram hashes of a paragraph's word hashes."""
    return np.unique(np.concatenate([grams(h, n) for n in NGRAMS]))


@dataclass
class Model:
    vocabulary: np.ndarray   # n-gram hashes, ascending
    weight: np.ndarray       # (vocabulary, families + 1)
    bias: np.ndarray
    temperature: float
    least: np.ndarray        # probability a family needs
    templates: list[tuple[int, np.ndarray]]
    short: dict[bytes, int]  # the n-grams of short notices, and their family
    triples: np.ndarray      # the templates' three-word n-grams, ascending
    pairs: np.ndarray        # and two-word ones
    longest: int             # words of the longest template
    known: np.ndarray        # bitmap of the vocabulary
    speaks: np.ndarray       # of the vocabulary: weighs more for some family than for none

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        z = (self.weight[at[self.vocabulary[at] == found]].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def resemblance(self, found: np.ndarray, family: int) -> float:
        """The largest share of a template's n-grams that the paragraph holds."""
        return max(float(np.isin(t, found, assume_unique=True).mean()) for f, t in self.templates if f == family)

    def matched(self, h: np.ndarray, family: str) -> int:
        """The most n-grams that a paragraph shares with a template that confirms the family."""
        found, k = features(h), FAMILIES.index(family)
        shared = [int(np.isin(t, found, assume_unique=True).sum()) for f, t in self.templates if f == k]
        sizes = [len(t) for f, t in self.templates if f == k]
        return max([n for n, size in zip(shared, sizes) if n >= CONFIRM * size], default=len(found))

    def candidates(self, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The paragraphs (words edges[k] to edges[k + 1]) that may be notices: those with an
        n-gram that speaks for a licence, and not more likely none; all paragraphs at once."""
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        keys = []
        for n in NGRAMS:
            g = grams(h, n)
            at = np.flatnonzero(self.known[g >> np.uint64(64 - _BITS)])
            at = at[owner[at] == owner[at + n - 1]]
            v = np.minimum(np.searchsorted(self.vocabulary, g[at]), len(self.vocabulary) - 1)
            hit = self.vocabulary[v] == g[at]
            keys.append(owner[at[hit]] * len(self.vocabulary) + v[hit])
        k, v = np.divmod(np.concatenate(keys), len(self.vocabulary))
        hot = np.zeros(len(edges) - 1, bool)
        hot[k[self.speaks[v]]] = True
        k, v = np.divmod(np.unique((k * len(self.vocabulary) + v)[hot[k]]), len(self.vocabulary))
        if not len(k):
            return k
        first = np.flatnonzero(np.diff(k, prepend=-1))
        z = (np.add.reduceat(self.weight[v], first, axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return k[first][e[:, NONE] < 0.501 * e.sum(axis=1)]  # judge draws the line

    def judge(self, h: np.ndarray) -> tuple[str, float, float] | None:
        """(family or "unknown", probability, resemblance) of a paragraph, None if no notice."""
        found = features(h)
        p = self.probabilities(found)
        if p[NONE] >= 0.5:
            return None
        top = int(p[:NONE].argmax())
        like = 1.0 if self.short.get(found.tobytes()) == top else self.resemblance(found, top)
        sure = p[top] >= self.least[top] and like >= CONFIRM
        return FAMILIES[top] if sure else "unknown", float(p[top]), like


def _variants(words: list[str], rng: np.random.Generator, around: list[list[str]]) -> Iterator[list[str]]:
    """A template as it may stand in a paragraph."""
    yield words
    for _ in range(24):
        own = list(words)
        if len(own) > 6 and rng.random() < 0.4:
            own = [w for w in own if rng.random() > 0.08]
        if rng.random() < 0.3:
            own = ["copyright", str(rng.integers(1990, 2030)), *own]
        if around and rng.random() < 0.6:
            near = around[rng.integers(len(around))]
            at = rng.integers(0, max(len(near) - 12, 1))
            part = near[at:at + int(rng.integers(2, 13))]
            own = part + own if rng.random() < 0.5 else own + part
        yield own


def _hash_words(words: list[str]) -> np.ndarray:
    return _words(" ".join(words)).hashes()


def _split(text: str) -> list[str]:
    w = _words(text)
    return [b.decode() for b in w.byte_words(0, len(w))]


def train(paragraphs: list[str]) -> Model:
    """Fit on the templates and on corpus paragraphs as negatives."""
    rng = np.random.default_rng(SEED)
    templates = [(k, features(_words(t).hashes())) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    known = np.unique(np.concatenate([t for _, t in templates]))
    plain = []
    for p in paragraphs:
        words = _split(p)
        found = features(_hash_words(words)) if words else np.zeros(0, np.uint64)
        if words and max(float(np.isin(t, found).mean()) for _, t in templates) < 0.5:
            plain.append(words)
    rows: list[np.ndarray] = []
    labels: list[int] = []
    for k, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            for v in _variants(_split(t), rng, plain):
                rows.append(features(_hash_words(v)))
                labels.append(k)
    short = {}
    for k, f in enumerate(FAMILIES):
        for name in NAMES.get(f, ()):
            for form in FORMS + (("{}",) if name not in AMBIGUOUS else ()):
                words = _split(form.format(name))
                short[features(_hash_words(words)).tobytes()] = k
                for own in (words, ["copyright", str(rng.integers(1990, 2030)), *words]):
                    rows.append(features(_hash_words(own)))
                    labels.append(k)
    shorts = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in short]))
    for words in [*plain, ["license"], ["the", "license", "plate"], ["public", "version"], ["all", "rights"], ["reserved"]]:
        rows.append(features(_hash_words(words)))
        labels.append(NONE)
    y = np.array(labels)
    held = rng.random(len(y)) < 0.25
    count = np.unique(np.concatenate([r for r, h in zip(rows, held) if not h]), return_counts=True)
    vocabulary = np.union1d(np.union1d(known, shorts), count[0][count[1] >= 3])
    model = Model(vocabulary, np.zeros((len(vocabulary), NONE + 1), np.float32), np.zeros(NONE + 1, np.float32), 1.0,
                  np.zeros(NONE), templates, short, *(np.unique(np.concatenate(
                      [grams(_words(t).hashes(), n) for f in FAMILIES for t in TEMPLATES[f]])) for n in (3, 2)),
                  max(len(_words(t)) for f in FAMILIES for t in TEMPLATES[f]), np.zeros(1 << _BITS, bool), np.zeros(len(vocabulary), bool))
    model.known[vocabulary >> np.uint64(64 - _BITS)] = True
    _descend(model, [r for r, h in zip(rows, held) if not h], y[~held])
    _calibrate(model, [r for r, h in zip(rows, held) if h], y[held])
    model.speaks = model.weight[:, :NONE].max(axis=1) > model.weight[:, NONE]
    return model


def _descend(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """Full-batch AdaGrad on the class-balanced log loss with weight decay."""
    at = [np.searchsorted(model.vocabulary, r[np.isin(r, model.vocabulary)]) for r in rows]
    col, row = np.concatenate(at), np.repeat(np.arange(len(rows)), [len(a) for a in at])
    share = 1 / np.bincount(y, minlength=NONE + 1)[y] / (NONE + 1)
    share[y == NONE] *= NONE
    goal = np.eye(NONE + 1, dtype=np.float32)[y]
    order = np.argsort(col, kind="stable")
    by_row, by_col = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(col[order], prepend=-1))
    squares, b_squares = np.full_like(model.weight, 1e-8), np.full_like(model.bias, 1e-8)
    for _ in range(EPOCHS):
        z = np.tile(model.bias, (len(rows), 1))
        z[row[by_row]] += np.add.reduceat(model.weight[col], by_row, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = ((e / e.sum(axis=1, keepdims=True) - goal) * share[:, None]).astype(np.float32)
        g = DECAY * model.weight
        g[col[order][by_col]] += np.add.reduceat(d[row[order]], by_col, axis=0)
        squares += g ** 2
        b_squares += d.sum(axis=0) ** 2
        model.weight -= RATE * g / np.sqrt(squares)
        model.bias -= RATE * d.sum(axis=0) / np.sqrt(b_squares)


def _calibrate(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """Temperature of least log loss; least probabilities by false alarms on negatives."""
    def loss(t: float) -> float:
        model.temperature = t
        return -sum(np.log(max(model.probabilities(r)[k], 1e-12)) for r, k in zip(rows, y))

    model.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss) if len(rows) else 1.0
    negatives = np.array([model.probabilities(r)[:NONE] for r, k in zip(rows, y) if k == NONE])
    if len(negatives):
        model.least = np.quantile(negatives, 1 - FALSE_ALARMS, axis=0)
    model.least = np.clip(model.least, 0.4, 0.9)


def fitted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The classifier, with negatives from a bounded sample of the documents (every third
    of their distinct paragraphs)."""
    text = clean_text()
    # first only hashes are ranked, so that no task sends texts of its own to the driver
    chosen = [r.h for r in docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample_docs).collect()]
    sample = docs.where(F.xxhash64(text).isin(chosen)).select(text.alias("text")).distinct().collect()
    return train(sorted({p for r in sample for p in r.text.split("\n")})[::3])


def linked(model: Model, h: np.ndarray, edges: np.ndarray, number: np.ndarray, row: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Of every line but the last: may a notice go on in the next one?  Only without a line
    between them that has no words; two lines that are notices themselves only by the words at the break."""
    break_ = edges[1:-1]
    near = (row[1:] == row[:-1]) & (number[1:] == number[:-1] + 1)
    pair, triple = grams(h, 2), grams(h, 3)
    over = np.zeros(len(break_), bool)
    if len(pair):
        over = np.isin(pair[break_ - 1], model.pairs)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    at = np.flatnonzero(np.isin(triple, model.triples)) if len(triple) else np.zeros(0, np.int64)
    some = np.zeros(len(edges) - 1, bool)
    some[owner[at[owner[at] == owner[at + 2]]]] = True
    return near & (over | some[1:] & some[:-1] & ~(sure[1:] & sure[:-1]))


def wrapped(model: Model, h: np.ndarray, edges: np.ndarray, links: np.ndarray, judged: dict[int, tuple]) -> dict[int, tuple]:
    """The verdicts on lines, where linked lines are cut into pieces so that the pieces that
    confirm a family match most of its templates in all; of equal cuts that of shorter pieces."""
    out = dict(judged)
    lines = np.flatnonzero(links)
    for chain in np.split(lines, np.flatnonzero(np.diff(lines) > 1) + 1) if len(lines) else ():
        first, last = int(chain[0]), int(chain[-1]) + 1
        best, cut, verdict = [0.0], [first], [None]  # of the lines before first + k: matched, start of the last piece, its verdict
        for j in range(first, last + 1):
            top = (-1.0, j, None)
            for i in range(j, first - 1, -1):
                if i < j and edges[j] - edges[i + 1] > model.longest:  # words between the piece's first and last line
                    break
                own = judged.get(i) if i == j else model.judge(h[edges[i]:edges[j + 1]])
                sure = own is not None and own[0] != "unknown"
                if i < j and not sure:
                    continue
                total = best[i - first] + (model.matched(h[edges[i]:edges[j + 1]], own[0]) if sure else 0)
                if total > top[0]:
                    top = (total, i, own)
            for part, value in zip((best, cut, verdict), top):
                part.append(value)
        j = last
        while j >= first:
            i, own = cut[j - first + 1], verdict[j - first + 1]
            for k in range(i, j + 1):
                out.pop(k, None)
            if own:
                out[i] = own
            j = i - 1
    return dict(sorted(out.items()))


NOTICE = "struct<paragraph:int,family:string,probability:double,resemblance:double>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and notices (paragraph number, family, probability, resemblance) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary of templates and sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("licenses")
        own = sent.value
        for batch in batches:
            out: list = [[] for _ in range(batch.num_rows)]
            for lo, _, words in segmented(batch.column(1), ALNUM, lower=True):
                h = words.hashes()
                breaks = np.flatnonzero(words.data == 10)
                edges = np.union1d(np.searchsorted(words.start, breaks), words.first)  # first words of paragraphs
                if len(edges) < 2:
                    continue
                rows = np.searchsorted(words.first, edges[:-1], "right") - 1
                numbers = np.searchsorted(breaks, words.start[edges[:-1]]) - np.searchsorted(breaks, words.bounds[rows])
                judged = {k: own.judge(h[edges[k]:edges[k + 1]]) for k in own.candidates(h, edges).tolist()}
                judged = {k: v for k, v in judged.items() if v}
                sure = np.zeros(len(rows), bool)
                sure[[k for k, v in judged.items() if v[0] != "unknown"]] = True
                for k, v in wrapped(own, h, edges, linked(own, h, edges, numbers, rows, sure), judged).items():
                    out[lo + int(rows[k])].append(dict(zip(("paragraph", "family", "probability", "resemblance"), (int(numbers[k]), *v))))
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("resemblance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "notices"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text")).mapInArrow(run, f"doc_id long, notices array<{NOTICE}>")


@query("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n.getField("family"))))
    return scan(docs, fitted(docs)).select(
        "doc_id", F.array_join(F.filter(found, lambda f: f != "unknown"), ",").alias("licenses"),
        F.size("notices").cast("long").alias("n_notices"),
        F.size(F.filter("notices", lambda n: n.getField("family") == "unknown")).cast("long").alias("n_unknown"))
