"""Operator 4: licence notices, by a trained paragraph classifier that templates confirm.

A paragraph is the lines up to one without a word. It is read as a whole, across
its line ends, and line by line, what has more than 40 words in windows of 40
words, 20 apart. Features are hashed word 1- and 2-grams of such a unit
(letters, digits; A-Z lower-cased). A sparse multinomial logistic regression
tells the licence families from ordinary text; it is trained on the templates
with words dropped or added and parts cut off, and on a bounded sample of the
corpus's own paragraphs that hold no licence word. Probabilities are calibrated
by a temperature on held-out rows, and a unit less likely a notice than any but
one in a thousand held-out ordinary paragraphs is dropped. What remains is
compared with the templates by the share of a template's word pairs that the
unit holds: every family stands of which a template reaches ``CONFIRM``, and
``OWN`` of the pairs that no other family's templates have; without any, the
unit is ``unknown`` if the likeliest family reaches ``LIKE``, else no notice. A
notice spans the words where most of its template's pairs lie; of spans of one
family that overlap the most similar is kept, and no ``unknown`` on a confirmed one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import textbytes as tb

DIM_BITS = 13
SPAN, STRIDE = 40, 20
MAX_NEGATIVES = 4000
CONFIRM = 0.6
LIKE = 0.25  # share of a template's pairs below which a unit is no notice at all
OWN = 0.5
SURE = 0.5
COPIES = 60

# fixed values: usual wordings of public licence notices
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc0": ("This work has been dedicated to the public domain under CC0 1.0 Universal.", "Released into the public domain."),
    "all-rights-reserved": ("All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."),
}
NONE, UNKNOWN = "none", "unknown"
LICENCE_WORDS = r"(?i)licen[sc]|copyright|rights reserved|redistribut|public domain|permission|spdx|creative commons"


def paragraph_words(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, line number, name) of every word, in batches of rows."""
    data, offsets = tb.text_bytes(col)
    for a, b in tb.runs_of_rows(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = tb.word_spans(part, local, tb.NOT_WORD)
        breaks = np.concatenate([[0], np.cumsum(part == 0x0A)])
        yield a, row, breaks[start] - breaks[local[row]], tb.word_hashes(part, start, end)


def grams(names: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, unit) of the 1- and 2-grams inside each unit, in order of unit."""
    shift = tb.U64(64 - DIM_BITS)
    one = (names * tb._MIX1) >> shift
    with np.errstate(over="ignore"):
        two = tb.finalize(names[:-1] * tb._MIX2 + names[1:]) >> shift
    inside = unit[1:] == unit[:-1] if len(unit) else np.zeros(0, dtype=bool)
    feature = np.concatenate([one, two[inside]]).astype(np.int64)
    of = np.concatenate([unit, unit[1:][inside]])
    order = np.argsort(of, kind="stable")
    return feature[order], of[order]


def _windows(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, unit) of runs of words that begin where ``new`` is set, longer ones in windows of ``SPAN`` words."""
    if len(new) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    para = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(new)]]))
    place = np.arange(len(new)) - first[para]
    many = np.maximum(1, -(-(size - (SPAN - STRIDE)) // STRIDE))
    base = np.cumsum(many) - many
    # a word stands in the window of its stride and, unless that is the first, in the one before
    last = np.minimum(place // STRIDE, many[para] - 1)
    word = np.arange(len(new))
    again = (last > 0) & (place - (last - 1) * STRIDE < SPAN)
    w = np.concatenate([word, word[again]])
    u = np.concatenate([base[para] + last, base[para[again]] + last[again] - 1])
    order = np.lexsort((w, u))
    return w[order], u[order]


def units_of(row: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, unit), in order of unit: the lines of the texts, then the paragraphs of several lines."""
    if len(row) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate([[True], row[1:] != row[:-1]])
    step = np.concatenate([[0], np.diff(line)])
    new_line, new_para = text | (step != 0), text | (step > 1)
    w, u = _windows(new_line)
    para = np.cumsum(new_para) - 1
    wrapped = np.flatnonzero((np.bincount(para, weights=new_line) > 1)[para])
    pw, pu = _windows(new_para[wrapped])
    return np.concatenate([w, wrapped[pw]]), np.concatenate([u, pu + u[-1] + 1])


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text, value) of whole texts as single units; a text's values have unit length."""
    feature, of = [], []
    col = pa.array(texts, pa.string())
    for a, row, _, names in paragraph_words(col):
        f, u = grams(names, row)
        feature.append(f)
        of.append(u + a)
    f, u = np.concatenate(feature), np.concatenate(of)
    n = np.maximum(np.bincount(u, minlength=len(texts)), 1)
    return f, u, 1 / np.sqrt(n[u])


def _variants(rng: np.random.Generator, text: str, filler: list[str]) -> Iterator[str]:
    """A template as people write it: words dropped, other text around it up to a window, upper or lower case."""
    words = text.split()
    for _ in range(COPIES):
        keep = [w for w in words if rng.random() > 0.08] or words
        around = list(rng.choice(filler, size=int(rng.integers(0, 7 if rng.random() < 0.5 else SPAN - 4)))) if filler else []
        cut = int(rng.integers(0, len(around) + 1))
        out = " ".join(around[:cut] + keep + around[cut:])
        yield out.upper() if rng.random() < 0.05 else out.lower() if rng.random() < 0.2 else out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str]) -> dict:
    """Model from the templates and ordinary paragraphs; every fifth row is held out for calibration."""
    rng = np.random.default_rng(0)
    filler = sorted({w for t in negatives[:200] for w in t.split()})[:2000]
    names = [NONE, *TEMPLATES]
    plain = ["He renewed his driving licence in spring.", "The licence fee went up again.", "She asked for permission to leave.", "The general public was not admitted."]
    texts = [*negatives, *plain]
    label = [0] * len(texts)
    for k, family in enumerate(TEMPLATES, 1):
        for t in TEMPLATES[family]:
            for v in [t, *_variants(rng, t, filler)]:
                texts.append(v)
                label.append(k)
    label = np.array(label)
    feature, of, value = _sparse(texts)
    held = np.arange(len(texts)) % 5 == 4
    w, b = np.zeros((1 << DIM_BITS, len(names)), dtype=np.float64), np.zeros(len(names))
    onehot = np.eye(len(names))[label]
    weight = np.where(held, 0.0, 1 / np.bincount(label, minlength=len(names))[label])
    weight /= weight.sum()
    step_w = np.full_like(w, 1e-12)

    def scores() -> np.ndarray:
        z = np.tile(b, (len(texts), 1))
        np.add.at(z, of, w[feature] * value[:, None])
        return z

    for _ in range(150):  # full-batch adaptive gradient steps
        g = (_softmax(scores()) - onehot) * weight[:, None]
        gw = 1e-6 * w
        np.add.at(gw, feature, g[of] * value[:, None])
        step_w += gw * gw
        w -= 0.5 * gw / np.sqrt(step_w)
        b -= 0.5 * g.sum(axis=0)
    z = scores()[held]
    loss = {t: -np.log(np.maximum(_softmax(z * t)[np.arange(held.sum()), label[held]], 1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    heat = min(loss, key=loss.get)
    ordinary = 1 - _softmax(z[label[held] == 0] * heat)[:, 0]
    least = max(SURE, float(np.quantile(ordinary, 0.999))) if len(ordinary) else SURE
    return {"names": names, "w": (w * heat).astype(np.float32), "b": (b * heat).astype(np.float32), "least": min(least, 0.9)}


def _pairs(names: np.ndarray) -> np.ndarray:
    """Name of each pair of successive words."""
    with np.errstate(over="ignore"):
        return tb.finalize(names[:-1] * tb._MIX2 + names[1:])


class Templates:
    """All templates' distinct word pairs in one array; ``own`` marks those of no other family."""

    def __init__(self):
        self.family = [k for k, v in TEMPLATES.items() for _ in v]
        words = [next(paragraph_words(pa.array([t])))[3] for v in TEMPLATES.values() for t in v]
        self.pairs = [np.unique(_pairs(w)) for w in words]
        self.words = np.array([len(w) for w in words])
        self.all, size = np.concatenate(self.pairs), np.array([len(x) for x in self.pairs])
        self.first = np.cumsum(size) - size
        other = [np.concatenate([y for y, g in zip(self.pairs, self.family) if g != f]) for f in self.family]
        self.own = np.concatenate([~np.isin(x, y) for x, y in zip(self.pairs, other)])

    def _share(self, of: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of & held, self.first, dtype=np.int64) / np.maximum(np.add.reduceat(of, self.first, dtype=np.int64), 1)

    def found(self, pairs: np.ndarray, likeliest: str) -> Iterator[tuple[bool, float, str, int, int]]:
        """(confirmed, similarity, family, first word, last word) of the notices of a unit of these pairs."""
        held = np.isin(self.all, pairs)
        like = self._share(np.ones(len(held), dtype=bool), held)
        stands = (like >= CONFIRM) & (self._share(self.own, held) >= OWN)
        names = sorted({self.family[t] for t in np.flatnonzero(stands)})
        for name in names or [likeliest]:
            mine = [t for t, f in enumerate(self.family) if f == name and (stands[t] or not names)]
            best = max(mine, key=lambda t: (like[t], self.words[t]))
            if like[best] < LIKE:
                continue
            at = np.flatnonzero(np.isin(pairs, self.pairs[best]))
            n = np.searchsorted(at, at + 3 * self.words[best] // 2) - np.arange(len(at))
            k = int(n.argmax())
            yield bool(names), float(like[best]), name if names else UNKNOWN, int(at[k]), int(at[k + n[k] - 1]) + 1


def scan_licences(spark: SparkSession, docs: DataFrame, max_negatives: int = MAX_NEGATIVES) -> DataFrame:
    """(doc_id, line, family, probability, similarity, confirmed, first_word, last_word): every licence notice found.

    line, first_word and last_word say where it stands in the text, from 0 (words of letters and digits). family is
    ``unknown`` where the classifier is sure of a notice that
    resembles no template well enough to name its family; probability is that of any notice. Null and empty texts have none; repeated rows give repeated
    rows. The classifier sees at most ``max_negatives`` paragraphs of the
    corpus, one of a document, by smallest hash of doc_id.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # a share of the documents by hash, a little more than needed, then the exact number: few rows reach the driver
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000_000)) / 1_000_000_000
    some = texts.withColumn("h", draw).where(F.col("h") * texts.count() < 1.1 * max_negatives + 20)
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\w") & ~x.rlike(LICENCE_WORDS)), F.lit(0))
    plain = some.select("h", F.substring(first, 1, 400).alias("p")).where("p is not null")
    sample = plain.orderBy("h", "p").limit(max_negatives).collect()  # bounded by max_negatives, 400 characters each
    model = spark.sparkContext.broadcast(train([r["p"] for r in sample]))
    key = dict(docs.dtypes)["doc_id"]
    ddl = f"doc_id {key}, line long, family string, probability double, similarity double, confirmed boolean, first_word long, last_word long"
    return texts.mapInArrow(_scanner(model), ddl)


def _distinct(found: list[tuple], n_words: int) -> list[tuple]:
    """Notices in order of the text, the best of those of a family that share words; units overlap."""
    taken, kept = {}, []
    for hit in sorted(found, key=lambda h: (not h[0], -h[1], h[4] - h[5], -h[2], h[4], h[3])):
        family, span = hit[3], slice(hit[4], hit[5] + 1)
        mine = taken.setdefault(family, np.zeros(n_words, dtype=bool))
        if not mine[span].any():
            kept.append(hit)
            mine[span] = True
            taken.setdefault(UNKNOWN, np.zeros(n_words, dtype=bool))[span] = True
    return sorted(kept, key=lambda h: (h[4], h[3]))


def _scanner(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, Templates()
        for batch in batches:
            for a, row, line, names in paragraph_words(batch.column(1)):
                if len(names) == 0:
                    continue
                word, unit = units_of(row, line)
                feature, of = grams(names[word], unit)
                cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                n = np.diff(np.concatenate([cut, [len(of)]]))
                z = np.empty((len(cut), len(m["names"])), dtype=np.float32)
                for k in range(0, len(cut), 4096):
                    stop = cut[k + 4096] if k + 4096 < len(cut) else len(of)
                    z[k : k + 4096] = np.add.reduceat(m["w"][feature[cut[k] : stop]], cut[k : k + 4096] - cut[k], axis=0)
                p = _softmax(z / np.sqrt(n)[:, None] + m["b"])
                notice, best = 1 - p[:, 0], p[:, 1:].argmax(axis=1) + 1
                at = np.searchsorted(unit, of[cut])
                stop = np.searchsorted(unit, of[cut], side="right")
                found = []
                for u in np.flatnonzero(notice >= m["least"]):
                    w = word[at[u] : stop[u]]
                    for ok, like, family, first, last in known.found(_pairs(names[w]), m["names"][best[u]]):
                        found.append((ok, like, float(notice[u]), family, int(w[first]), int(w[last])))
                hits = _distinct(found, len(names))
                if hits:
                    ok, like, sure, family, first, last = zip(*hits)
                    first, last = np.array(first), np.array(last)
                    begin = np.searchsorted(row, row[first])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[first] + a)), pa.array(line[first], pa.int64()), pa.array(family), pa.array([round(x, 6) for x in sure]),
                         pa.array([round(x, 6) for x in like]), pa.array(ok), pa.array(first - begin, pa.int64()), pa.array(last - begin, pa.int64())],
                        names=["doc_id", "line", "family", "probability", "similarity", "confirmed", "first_word", "last_word"],
                    )

    return rows
