"""Cut long documents into token-bounded chunks.

Each document is handled on its own, so the whole chunker is a narrow
projection plus one ``explode``: no shuffle, no Python, and its memory is
bounded by the largest document, not by the corpus.

* T10 passthrough: a document of <= limit tokens (with 2 specials) is kept as is.
* T11 greedy pack: sentences in order, a chunk takes the next sentence while
  it stays <= limit (inclusive). A single oversize sentence becomes its own
  chunk, never split; no empty chunk is emitted before it (decision Q8).
* T12 tail back-fill: a last chunk under limit//2 takes earlier sentences in
  front until it reaches limit//2 (clean overlap, decision Q9); when the
  document runs out it starts at the first sentence.
* T13 explode: one row per chunk, keeping ``doc_id`` and ``chunk_no``.

The fold (T11) only carries the current length and the list of chunk starts,
so it is linear in the number of sentences; the back-fill (T12) is a second
linear fold with a scalar state over the sentences before the tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.functions.rules import CHUNK_MAX_TOKENS


def _sum_ints(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)


def chunk_starts(lens: Column, limit: int) -> Column:
    """1-based first-sentence index of every chunk (greedy, inclusive limit)."""
    idx = F.sequence(F.lit(1), F.size(lens))
    zero = F.struct(F.lit(0).cast("bigint").alias("cur"), F.array(F.lit(1)).alias("starts"))

    def step(acc, i):
        x = F.element_at(lens, i).cast("bigint")
        new_chunk = (acc["cur"] + x > limit) & (acc["cur"] > 0)
        return F.when(
            new_chunk, F.struct(x.alias("cur"), F.concat(acc["starts"], F.array(i)).alias("starts"))
        ).otherwise(F.struct((acc["cur"] + x).alias("cur"), acc["starts"].alias("starts")))

    return F.when(F.size(lens) > 0, F.aggregate(idx, zero, step)["starts"]).otherwise(F.array().cast("array<int>"))


def backfill_start(lens: Column, last_start: Column, tail_min: int) -> Column:
    """New first sentence of the last chunk so that it holds >= tail_min tokens."""
    tail = _sum_ints(F.slice(lens, last_start, F.size(lens)))
    before = F.reverse(F.slice(lens, 1, last_start - 1))
    zero = F.struct(tail.alias("acc"), last_start.cast("int").alias("i"), (tail >= tail_min).alias("done"))

    def step(s, x):
        acc = s["acc"] + x
        return F.when(s["done"], s).otherwise(
            F.struct(acc.alias("acc"), (s["i"] - 1).cast("int").alias("i"), (acc >= tail_min).alias("done"))
        )

    return F.when(last_start > 1, F.aggregate(before, zero, step)["i"]).otherwise(last_start)


def chunk_documents(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = CHUNK_MAX_TOKENS,
    tail_min: int | None = None,
    fast_tokens: bool = False,
) -> DataFrame:
    """One row per chunk: ``*keep, chunk_no, text, n_tokens, n_sentences``.

    ``chunk_no`` is 0-based; a passthrough document has one chunk with its text
    unchanged; a packed chunk's text is its sentences joined by one space.
    """
    tail_min = limit // 2 if tail_min is None else tail_min
    t = F.col(text_col)
    n_doc = tx.token_count(t, specials=2, fast=fast_tokens)

    step1 = docs.select(*keep, t.alias("_text"), n_doc.alias("_n_doc"))
    packed = step1.select(
        *keep,
        "_text",
        "_n_doc",
        F.when(F.col("_n_doc") > limit, tx.sentences("_text")).alias("_sents"),
    ).select(
        *keep,
        "_text",
        "_n_doc",
        "_sents",
        F.transform("_sents", lambda s: F.size(tx.tokens(s, fast_tokens))).alias("_lens"),
    )
    with_starts = packed.withColumn("_starts", chunk_starts(F.col("_lens"), limit))
    k = F.size("_starts")
    m = F.size("_lens")
    last = F.element_at("_starts", -1)
    with_tail = with_starts.withColumn(
        "_last_start", F.when(k > 0, backfill_start(F.col("_lens"), last, tail_min))
    )

    def chunk_at(j):
        start = F.when(j == k, F.col("_last_start")).otherwise(F.element_at("_starts", j))
        end = F.when(j == k, m).otherwise(F.element_at("_starts", j + 1) - 1)
        n = end - start + 1
        return F.struct(
            (j - 1).cast("int").alias("chunk_no"),
            F.array_join(F.slice("_sents", start, n), " ").alias("text"),
            _sum_ints(F.slice("_lens", start, n)).alias("n_tokens"),
            n.cast("int").alias("n_sentences"),
        )

    passthrough = F.array(
        F.struct(
            F.lit(0).alias("chunk_no"),
            F.col("_text").alias("text"),
            (F.col("_n_doc") - 2).cast("bigint").alias("n_tokens"),
            F.lit(1).alias("n_sentences"),
        )
    )
    chunks = F.when(F.col("_n_doc") <= limit, passthrough).otherwise(
        F.when(k > 0, F.transform(F.sequence(F.lit(1), k), chunk_at)).otherwise(F.array().cast(passthrough_type()))
    )
    return with_tail.select(*keep, F.explode(chunks).alias("_c")).select(*keep, "_c.*")


def passthrough_type() -> str:
    return "array<struct<chunk_no:int,text:string,n_tokens:bigint,n_sentences:int>>"


def chunk_summary(chunks: DataFrame, by: str = "lang") -> DataFrame:
    """entry() flagship: chunks and tokens per language."""
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("n_tokens").cast("bigint").alias("sum_tokens"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.max("n_tokens").cast("bigint").alias("max_tokens"),
    )
