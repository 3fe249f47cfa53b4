"""Operator 5: language by hierarchical discrimination.

A text is first given to a language family, then one-versus-one linear support
vector machines separate the languages of that family by votes (ties by summed
margins). Families are learned: languages are joined by the likeness of their
mean profiles (average link) up to the largest gap; of three or more languages
there are two families at least.

Features are hashed byte 1- to 4-grams of the whole text, lower-cased, every
ASCII byte that is no letter read as a space; square-root counts, unit length.
The model is fitted on at most ``max_rows`` labelled rows, the same number for
each language, chosen by hash of doc_id; predicting is one pass over the
texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusforge.llm import textbytes as tb

DIM = 1 << 12
MAX_ROWS = 4000
UNKNOWN = "und"
_GRAMS = (1, 2, 3, 4)

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; two-byte capitals of the Latin-1 range too."""
    out = _FOLD[data]
    latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
    out[1:][latin] |= 0x20
    return out


def features(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of profiles) for consecutive rows."""
    data, offsets = tb.text_bytes(col)
    for a, b in tb.runs_of_rows(offsets):
        for a2 in range(a, b, 256):
            b2 = min(a2 + 256, b)
            part = _folded(data[offsets[a2] : offsets[b2]]).astype(np.uint32)
            local = offsets[a2 : b2 + 1] - offsets[a2]
            row = np.repeat(np.arange(b2 - a2), np.diff(local))
            counts = np.zeros((b2 - a2) * DIM, dtype=np.int64)
            code = np.zeros(len(part), dtype=np.uint32)
            for g in _GRAMS:
                if len(part) < g:
                    break
                code = code[: len(part) - g + 1] * np.uint32(257) + part[g - 1 :] + np.uint32(1)
                inside = row[: len(code)] == row[g - 1 :]
                slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int64) + row[: len(code)] * DIM
                counts += np.bincount(slot[inside], minlength=len(counts))
            x = np.sqrt(counts.reshape(-1, DIM)).astype(np.float32)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield a2, x / np.maximum(norm, 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of a squared-hinge linear SVM, by dual coordinate descent; y is -1 or 1, x has a last column of ones."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    diag = 1 / (2 * c * share)
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64) + diag
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


def families(profiles: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages joined by average link up to the largest gap; at least two groups, and each alone if there are fewer than three."""
    names = sorted(profiles)
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in profiles.items()}
    alike = {(a, b): float(unit[a] @ unit[b]) for a, b in combinations(names, 2)}
    groups = [(k,) for k in names]
    steps = [groups]  # groups after each join
    level = []  # likeness of each join

    def link(g: tuple, h: tuple) -> float:
        return sum(alike[min(a, b), max(a, b)] for a in g for b in h) / (len(g) * len(h))

    while len(groups) > 1:
        g, h = max(combinations(groups, 2), key=lambda x: link(*x))
        level.append(link(g, h))
        groups = sorted([x for x in groups if x not in (g, h)] + [tuple(sorted(g + h))])
        steps.append(groups)
    if len(names) < 3:
        return [list(g) for g in steps[0]]
    joins = 1 + max(range(len(level) - 1), key=lambda k: level[k] - level[k + 1])
    return [list(g) for g in steps[joins]]


def fit(texts: pa.Array, langs: np.ndarray) -> dict:
    x = np.ones((len(langs), DIM + 1), dtype=np.float32)
    for a, part in features(texts):
        x[a : a + len(part), :DIM] = part
    groups = families({k: x[langs == k, :DIM].mean(axis=0) for k in set(langs)})
    of = {k: i for i, g in enumerate(groups) for k in g}
    fam = np.array([of[k] for k in langs])
    top = [linear_svm(x, np.where(fam == i, 1.0, -1.0)) for i in range(len(groups))] if len(groups) > 1 else []
    pairs = {}
    for g in groups:
        for a, b in combinations(g, 2):
            rows = (langs == a) | (langs == b)
            pairs[(a, b)] = linear_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
    return {"groups": groups, "top": top, "pairs": pairs}


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score): score is the sureness of the family times that of the weakest won duel."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    groups = model["groups"]
    if model["top"]:
        margins = x @ np.stack(model["top"]).T
        fam = margins.argmax(axis=1)
        score = _sure(margins[np.arange(len(x)), fam])
    else:
        fam, score = np.zeros(len(x), dtype=np.int64), np.ones(len(x))
    lang = np.empty(len(x), dtype=object)
    for i, g in enumerate(groups):
        rows = np.flatnonzero(fam == i)
        if len(rows) == 0:
            continue
        votes, sums = np.zeros((len(rows), len(g))), np.zeros((len(rows), len(g)))
        duels = {}
        for a, b in combinations(range(len(g)), 2):
            m = x[rows] @ model["pairs"][(g[a], g[b])]
            duels[(a, b)] = m
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
        best = np.lexsort((sums.T, votes.T), axis=0)[-1] if len(g) > 1 else np.zeros(len(rows), dtype=np.int64)
        weakest = np.full(len(rows), np.inf)
        for (a, b), m in duels.items():
            weakest = np.where(best == a, np.minimum(weakest, m), np.where(best == b, np.minimum(weakest, -m), weakest))
        lang[rows] = np.array(g, dtype=object)[best]
        score[rows] *= np.where(np.isinf(weakest), 1.0, _sure(weakest))
    return lang, np.clip(score, 0.0, 1.0)


def in_held_out(doc_id: Column, folds: int = 3, held: int = 1) -> Column:
    """Whether the document belongs to the held-out fold; a null doc_id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(True))


def fit_language_model(spark: SparkSession, labelled: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    """Model from (doc_id, text, lang) rows; None without labelled text.

    The sample takes at most max_rows / languages rows of each language,
    smallest hash of doc_id first, so it does not depend on partitions.
    """
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'")
    # a share of each language by hash, a little more than needed, before any text is shuffled; then the exact number
    # (counts has one row per language, so it may be broadcast)
    counts = rows.groupBy("lang").agg(F.count("*").alias("c"))
    each = max(1, max_rows // max(1, counts.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    near = rows.join(F.broadcast(counts), "lang").where(draw * F.col("c") < 1.1 * each + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
    sample = near.withColumn("r", rank).where(F.col("r") <= each).select("doc_id", "text", "lang")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
        model = fit(table["text"].combine_chunks(), np.array(table["lang"].to_pylist(), dtype=object))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(train, "model binary").collect()  # one row, the model
    return pickle.loads(found[0]["model"]) if found else None


def has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text holds a letter."""
    data, offsets = tb.text_bytes(col)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for a, b in tb.runs_of_rows(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        wide = part >= 128
        seen = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[local] for x in ((_FOLD[part] != 0x20) & ~wide, wide)]
        ascii_letter, other = (np.diff(x) > 0 for x in seen)
        out[a:b] = ascii_letter
        for i in np.flatnonzero(other & ~ascii_letter):
            out[a + i] = any(c.isalpha() for c in col[a + int(i)].as_py())
    return out


def identify_language(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with lang_pred and score.

    lang_pred is a learned language; ``und`` with score 0 if the text is null
    or has no letter, or nothing was learned. Only the text is read. Columns of
    these names are replaced, all others and all rows stay.
    """
    plain = docs.drop("lang_pred", "score")
    n = len(plain.columns)
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n)
            lang, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            if model is not None:
                for a, x in features(texts):
                    lang[a : a + len(x)], score[a : a + len(x)] = predict(model, x)
            some = has_letter(texts)
            lang[~some], score[~some] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names[:n], "lang_pred", "score"],
            )

    return plain.select(*plain.columns, F.col("text").cast("string").alias("__text")).mapInArrow(rows, schema)
