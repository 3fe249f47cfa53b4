"""Operator 10: benchmark passages in training text, by BM25 with block-max WAND pruning.

The inverted index holds the test items: for each term the items with their
BM25 weight, divided by the item's own total, so that a score is the share of
an item's weight that a passage contains and one threshold fits all items.
Every passage of the corpus is a query. A document's words are cut into
windows of two strides, one stride apart, where a stride is the length of the
longest item, so any stretch as long as an item lies whole in one window.

Pruning is that of block-max WAND: items stand in blocks, each term has its
largest weight per block, and a (passage, block) pair whose sum of block maxima
stays below the threshold cannot hold a hit. The sums run over all words of an
Arrow batch at once. Pairs that remain are scored exactly, and hits at or above
the threshold are checked: the share of the item's question (all but its last
sentence) and of its answer (the last sentence) found in the passage. Short
items and parts are easily met by chance, so they need more: a part of fewer
words than a run is judged with the words beside it in the item, an item of
fewer than ``SHORT`` words must stand in the passage in a row, and one of fewer
than ``ALONE`` words must be all that the document says.

The index is made by Spark and used in shards of a bounded number of items, one
pass over the texts per shard, so a larger benchmark never means a larger
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import textbytes as tb
from corpusforge.llm.tables import Scratch

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.6
SHARD_ITEMS = 4096
SHARD_WORDS = 1 << 20
BLOCKS = 64
GRAM = 3
SHORT, ALONE = 8, 5  # words


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) of every plain word: letters, digits and non-ASCII characters, A-Z lower-cased."""
    data, offsets = tb.text_bytes(col)
    names, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in tb.runs_of_rows(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = tb.word_spans(part, local, tb.NOT_WORD)
        names.append(tb.word_hashes(part, start, end))
        rows.append(row + a)
    return np.concatenate(names), np.concatenate(rows)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, pos, term, answer) of each word of an item; answer marks its last sentence."""
    for batch in batches:
        for part, flag in ((1, False), (2, True)):
            names, row = _words(batch.column(part))
            first = np.searchsorted(row, np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - first[row]), pa.array(names.view(np.int64)), pa.array(np.full(len(row), flag))],
                names=["item", "pos", "term", "answer"],
            )


def build_index(spark: SparkSession, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, item_id, shard, term, weight, question, answer): postings, and on one row per item its words in order."""
    one = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    # the last sentence: after the last end mark that is followed by a further word
    cut = F.regexp_extract("text", r"(?s)^(.*[.!?\n])(?=[^.!?\n]*[\p{L}\p{N}])", 1)
    one = one.select(F.xxhash64("item_id", "text").alias("item"), "item_id", cut.alias("question"), F.expr("substring(text, length(regexp_extract(text, '(?s)^(.*[.!?\\\\n])(?=[^.!?\\\\n]*[\\\\p{L}\\\\p{N}])', 1)) + 1)").alias("answer"))
    one = scratch.keep(one, "items")
    words = one.select("item", "question", "answer").mapInArrow(_item_rows, "item long, pos long, term long, answer boolean")
    words = scratch.keep(words, "words")
    tf = words.groupBy("item", "term").agg(F.count("*").alias("tf"))
    lengths = words.groupBy("item").agg(F.count("*").alias("len"))
    facts = lengths.agg(F.count("*").alias("items"), F.avg("len").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    postings = tf.join(lengths, "item").join(df, "term").join(F.broadcast(facts))  # facts is one row
    postings = postings.select("item", "term", raw.alias("raw"))
    own = postings.groupBy("item").agg(F.sum("raw").alias("own"))
    postings = postings.join(own, "item").select("item", "term", (F.col("raw") / F.col("own")).alias("weight"))
    in_order = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("answer") == flag, F.struct("pos", "term")))), lambda x: x["term"])
    texts = words.groupBy("item").agg(in_order(False).alias("question"), in_order(True).alias("answer"))
    terms = postings.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    size = lengths.agg(F.count("*").alias("items"), F.sum("len").alias("all"), F.max("len").alias("longest"))
    shards = F.ceil(F.greatest(F.col("items") / SHARD_ITEMS, F.col("all") / SHARD_WORDS)).cast("long")
    out = terms.join(texts, "item").join(one.select("item", "item_id"), "item").join(F.broadcast(size))
    return out.select("item", "item_id", F.pmod(F.col("item"), shards).alias("shard"), shards.alias("shards"), "longest", "terms", "question", "answer")


class Shard:
    """One shard of the index as arrays: terms, block maxima, postings."""

    def __init__(self, rows: list, longest: int):
        rows = sorted(rows, key=lambda r: r["item"])
        self.item_ids = [r["item_id"] for r in rows]
        self.stride = max(1, longest)
        term = np.array([t["term"] for r in rows for t in r["terms"]], dtype=np.int64).view(np.uint64)
        weight = np.array([t["weight"] for r in rows for t in r["terms"]])
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        self.terms, where = np.unique(term, return_inverse=True)
        self.per_block = -(-len(rows) // BLOCKS)
        n_blocks = -(-len(rows) // self.per_block)
        self.block_max = np.zeros((len(self.terms), n_blocks), dtype=np.float32)
        np.maximum.at(self.block_max, (where, item // self.per_block), weight.astype(np.float32))
        order = np.argsort(where, kind="stable")
        self.post_item, self.post_weight = item[order], weight[order]
        self.post_start = np.searchsorted(where[order], np.arange(len(self.terms) + 1))
        as_names = lambda x: np.array(x or [], dtype=np.int64).view(np.uint64)
        self.question = [as_names(r["question"]) for r in rows]
        self.answer = [as_names(r["answer"]) for r in rows]

    def ids(self, names: np.ndarray) -> np.ndarray:
        """Position of each name among the terms, -1 for others."""
        at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        return np.where(self.terms[at] == names, at, -1)


def _share(part: np.ndarray, passage: np.ndarray, n: int = GRAM) -> float:
    """Share of the distinct runs of ``n`` words of an item's part found in a passage."""

    def runs(x: np.ndarray) -> np.ndarray:
        if len(x) < n:
            return x[:0]
        h = x[: len(x) - n + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                h = tb.finalize(h * tb._MIX1 + x[k : len(x) - n + 1 + k])
        return np.unique(h)

    mine = runs(part)
    return float(np.isin(mine, runs(passage), assume_unique=True).mean()) if len(mine) else 0.0


def overlaps(question: np.ndarray, answer: np.ndarray, passage: np.ndarray, whole: bool) -> tuple[float, float]:
    """Shares of an item's question and answer in a passage; ``whole``: the passage is all of its document.

    An item without a question has no evidence but its answer: both shares are the answer's."""
    item = np.concatenate([question, answer])
    if len(item) < SHORT:
        alike = len(item) > 0 and (np.array_equal(item, passage) if len(item) < ALONE else _share(item, passage, len(item)) == 1.0)
        found = float(alike and (whole or len(item) >= ALONE))
        return found, found
    a = _share(answer if len(answer) >= GRAM else item[-GRAM:], passage)
    return (_share(question if len(question) >= GRAM else item[:GRAM], passage) if len(question) else a), a


def search(shard: Shard, names: np.ndarray, row: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, first word of the window, item, score, question share, answer share) of hits in the words of a batch."""
    ids = shard.ids(names)
    first = np.searchsorted(row, row, side="left")  # first word of the row
    slot = (np.arange(len(row)) - first) // shard.stride
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])])
    begin = np.flatnonzero(new)
    known = np.flatnonzero(ids >= 0)
    sums = np.zeros((len(begin), shard.block_max.shape[1]), dtype=np.float32)
    piece = np.cumsum(new) - 1
    for a in range(0, len(known), 1 << 16):
        part = known[a : a + (1 << 16)]
        cuts = np.flatnonzero(np.concatenate([[True], piece[part][1:] != piece[part][:-1]]))
        sums[piece[part[cuts]]] += np.add.reduceat(shard.block_max[ids[part]], cuts, axis=0)
    joined = np.concatenate([row[begin][1:] == row[begin][:-1], [False]])
    both = sums + np.where(joined[:, None], np.concatenate([sums[1:], sums[:1]]), np.float32(0))
    stop = np.concatenate([begin[1:], [len(row)]])
    for w in np.flatnonzero(both.max(axis=1) >= threshold - 1e-4):
        end = stop[w + 1] if joined[w] else stop[w]
        have = np.unique(ids[begin[w] : end])
        have = have[have >= 0]
        blocks = np.flatnonzero(shard.block_max[have].sum(axis=0) >= threshold - 1e-4)  # now with each term once
        if len(blocks) == 0:
            continue
        begin_at, many = shard.post_start[have], shard.post_start[have + 1] - shard.post_start[have]
        at = np.arange(many.sum()) + np.repeat(begin_at - np.cumsum(many) + many, many)
        at = at[np.isin(shard.post_item[at] // shard.per_block, blocks)]
        scores = np.bincount(shard.post_item[at], weights=shard.post_weight[at], minlength=len(shard.item_ids))
        for item in np.flatnonzero(scores >= threshold):
            passage = names[begin[w] : end]
            whole = begin[w] == first[begin[w]] and (end == len(row) or row[end] != row[begin[w]])
            yield (
                int(row[begin[w]]), int(begin[w] - first[begin[w]]), int(item), float(scores[item]),
                *overlaps(shard.question[item], shard.answer[item], passage, bool(whole)),
            )


_HITS = "row_id {t}, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start): test items found in documents.

    One row per pair, of its best passage. A pair counts if the BM25 share is
    at least ``threshold`` and the passage holds at least ``question`` and
    ``answer`` of the item's two parts (shares of their 3-word runs, see
    ``overlaps`` for short ones; an item of one sentence is all answer). Null
    and empty texts, on either side, match nothing. Repeated documents or items count once per id; an item with a
    null id is reported with a null item_id.
    """
    scratch = Scratch(spark, "bench")
    index = scratch.keep(build_index(spark, benchmark, scratch), "index")
    texts = docs.select(F.col("doc_id").alias("row_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ddl = _HITS.format(t=dict(docs.dtypes)["doc_id"])
    shape = index.select("shards", "longest").first()
    found = spark.createDataFrame([], ddl)
    for s in range(shape["shards"] if shape else 0):
        shard = Shard(index.where(F.col("shard") == s).collect(), shape["longest"])  # bounded by SHARD_ITEMS and SHARD_WORDS
        if shard.item_ids:
            found = found.unionByName(texts.mapInArrow(_searcher(spark, shard, threshold), ddl))
    found = found.where((F.col("question_overlap") >= question) & (F.col("answer_overlap") >= answer))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage_start")).alias("p"))).alias("b")
    found = found.groupBy("row_id", "item_id").agg(best)
    return found.select(
        F.col("row_id").alias("doc_id"), "item_id", F.round("b.score", 6).alias("score"), F.round("b.question_overlap", 6).alias("question_overlap"),
        F.round("b.answer_overlap", 6).alias("answer_overlap"), (-F.col("b.p")).alias("passage_start"),
    )


def _searcher(spark: SparkSession, shard: Shard, threshold: float):
    held = spark.sparkContext.broadcast(shard)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        names = ["row_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                words, row = _words(part.column(1))
                if len(words) == 0:
                    continue
                hits = list(search(index, words, row, threshold))
                if hits:
                    r, p, i, s, q, w = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(r)), pa.array([index.item_ids[k] for k in i], pa.int64()), pa.array(p, pa.int64()),
                         pa.array(s, pa.float64()), pa.array(q, pa.float64()), pa.array(w, pa.float64())], names=names)

    return rows
