"""Operator 9: repeated byte strings, by prefix doubling over sampled positions.

A suffix array names each position by the rank of its prefix and doubles the
prefix length until the names are unique or the threshold is reached. To remove
every byte covered by a ``length``-byte string that starts earlier, only ranks
up to ``length`` matter, and only positions whose shorter prefixes repeat go on:

1. ``anchor`` bytes: every window of ``length`` bytes has one anchor, the
   position inside it whose ``anchor``-byte string has the smallest hash
   (leftmost of equals). Equal windows have equal anchors at equal distance, so
   one rank per anchor speaks for the whole run of windows that share it (about
   40 bytes of text each).
2. ``length - 8`` bytes: what remains of the runs is cut into cells of up to 9
   windows whose distances to the anchor are alike; all windows of a cell
   contain the same ``length - 8`` bytes, its core.
3. ``length`` bytes: the single windows of the remaining cells.

In every round Spark groups the core ranks, and cells with a unique one leave.
The others are named by the pair (core rank, rank of the whole span): of equal
pairs the first goes on and the others are copies, all their windows removed.
Where a core rank has one pair left, that cell is unique and leaves too.

Ranks are 64-bit hashes of the bytes; removing always rests on a pair, 128
bits. Every round is a few shuffles of fixed-width rows; hot ranks meet in
partial aggregates and in joins that AQE may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import textbytes as tb
from corpusforge.llm.tables import Scratch

LENGTH = 100
ANCHOR = 20
CELL = 9  # windows in a cell of the second round
_SHAPE_BITS = 16  # left distance and number of windows of a run, 8 bits each


def _running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = tb.Powers.get(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(tb.BYTE_NAME[data] * up[: len(data)], out=run[1:])
    return run, down


def _names(run: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tb.finalize((run[end] - run[start]) * down[start])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Runs of windows that share an anchor: (first window, left distance, windows, anchor rank, span rank, row)."""
    n = len(data)
    m = n - length + 1
    empty = np.zeros(0, np.int64)
    if m <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty
    run, down = _running(data)
    with np.errstate(over="ignore"):
        rank = tb.finalize((run[anchor:] - run[:-anchor]) * down[: n - anchor + 1])
    bits = int(n).bit_length()
    low = tb.U64((1 << bits) - 1)
    cur = (rank & ~low) | np.arange(len(rank), dtype=np.uint64)
    width, have = length - anchor + 1, 1
    while have * 2 <= width:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    if width > have:
        cur = np.minimum(cur[: len(cur) - (width - have)], cur[width - have :])
    at = (cur & low).astype(np.int64)
    valid = np.ones(m, dtype=bool)
    for stop in offsets[1:]:
        valid[max(stop - length + 1, 0) : stop] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(offsets, first, side="right") - 1
    left, count = at[first] - first, final - first + 1
    shape = (left * 256 + count).astype(np.uint64)
    with np.errstate(over="ignore"):
        span = tb.finalize(_names(run, down, first, final + length) + shape * tb._MIX1)
    return first, left, count, rank[at[first]], span, row


def _anchor_rows(length: int, anchor: int):
    schema = pa.schema([("rank", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = tb.text_bytes(batch.column(1))
            for a, b in tb.runs_of_rows(offsets):
                local = offsets[a : b + 1] - offsets[a]
                first, left, count, rank, span, row = anchor_runs(data[offsets[a] : offsets[b]], local, length, anchor)
                at = ((first - local[row]) << _SHAPE_BITS) | (left << 8) | count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[a:b][row]), pa.array(at)],
                    schema=schema,
                )

    return rows


def _cell_rows(length: int, width: int):
    """Cells of ``width`` windows of the listed runs (or cells), as rows like those of ``_anchor_rows``."""
    schema = pa.schema([("rank", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(1))
            for i, (doc, ats) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                at = np.unique(ats.values.to_numpy(zero_copy_only=False))
                part = data[offsets[i] : offsets[i + 1]]
                left, count = (at >> 8) & 0xFF, at & 0xFF
                anchor = (at >> _SHAPE_BITS) + left
                high, low = left // width, (left - count + 1) // width
                n = high - low + 1
                which = np.repeat(np.arange(len(at)), n)
                cell = np.repeat(high, n) - (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
                far = np.minimum(left[which], cell * width + width - 1)  # distances to the anchor
                near = np.maximum((left - count + 1)[which], cell * width)
                first, final, core = anchor[which] - far, anchor[which] - near, anchor[which] - cell * width
                run, down = _running(part)
                if width == 1:
                    rank = _names(run, down, first, first + length // 2)
                    span = _names(run, down, first + length // 2, first + length)
                else:
                    rank = _names(run, down, core, core + length - width + 1)
                    shape = ((cell * width - near + 256) * 512 + far - near).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        span = tb.finalize(_names(run, down, first, final + length) + shape * tb._MIX1)
                new = (first << _SHAPE_BITS) | (far << 8) | (far - near + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank.view(np.int64)), pa.array(span.view(np.int64)), pa.array(np.full(len(new), doc, np.int64)), pa.array(new)],
                    schema=schema,
                )

    return rows


def _round(scratch: Scratch, rows: DataFrame, length: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(copies as byte ranges, cells to split further as (doc_id, ats)) of one round's rows."""
    # tables of their own, so that AQE can split the other side of the joins at a hot rank
    twice = scratch.keep(rows.groupBy("rank").count().where("count > 1").select("rank"), f"twice{label}")
    live = scratch.keep(rows.join(twice, "rank", "left_semi"), f"live{label}")
    first = live.groupBy("rank", "span").agg(F.min(F.struct("doc_id", "at")).alias("f"))
    first = scratch.keep(first.select("rank", F.col("f.doc_id").alias("doc_id"), F.col("f.at").alias("at")), f"first{label}")
    copies = live.join(first.select("doc_id", "at"), ["doc_id", "at"], "left_anti")
    start = F.shiftright("at", _SHAPE_BITS)
    copies = copies.select("doc_id", start.alias("start"), (start + F.col("at").bitwiseAND(0xFF) + (length - 1)).alias("stop"))
    copies = scratch.keep(copies, f"copies{label}")
    many = scratch.keep(first.groupBy("rank").count().where("count > 1").select("rank"), f"many{label}")
    rest = first.join(many, "rank", "left_semi").groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    rest = scratch.keep(rest, f"rest{label}")
    scratch.drop(live, first, twice, many)
    return copies, rest


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start, stop): byte ranges covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start.
    Ranges may overlap. Rows with a null doc_id take no part; null and short
    texts have no windows. Rows that repeat a doc_id are one document's row
    twice, not copies of each other.
    """
    if not 8 <= anchor < length <= 255 or length % 2:
        raise ValueError("need 8 <= anchor < length <= 254, length even")
    scratch = Scratch(spark, "suffix")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    anchors = texts.mapInArrow(_anchor_rows(length, anchor), "rank long, span long, doc_id long, at long")

    copies, rest = _round(scratch, anchors, length, "1")
    for label, width in (("2", CELL), ("3", 1)):
        cells = texts.join(rest, "doc_id").select("doc_id", "text", "ats")
        cells = cells.mapInArrow(_cell_rows(length, width), "rank long, span long, doc_id long, at long")
        cells = scratch.keep(cells, f"cells{label}")
        scratch.drop(rest)
        more, rest = _round(scratch, cells, length, label)
        scratch.drop(cells)
        copies = copies.unionByName(more)
    return copies


def _cut(keep_text: bool):
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept_text", pa.string())] if keep_text else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_in = batch.num_columns - 2
            data, offsets = tb.text_bytes(batch.column(n_in))
            out: list[list] = [[] for _ in fields]
            for i, spans in enumerate(batch.column(n_in + 1)):
                part = data[offsets[i] : offsets[i + 1]]
                n, removed, n_spans = len(part), 0, 0
                kept = part.tobytes()
                if spans.is_valid and len(spans.values):
                    s = spans.values.field("start").to_numpy(zero_copy_only=False)
                    e = np.minimum(spans.values.field("stop").to_numpy(zero_copy_only=False), n)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(s, n), 1)
                    np.add.at(edge, e, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    removed = int(gone.sum())
                    n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    kept = part[~gone].tobytes()
                row = [n, removed, n_spans, hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    row.append(kept.decode("utf-8", "ignore") if batch.column(n_in)[i].is_valid else None)
                for col, v in zip(out, row):
                    col.append(v)
            arrays = list(batch.columns[:n_in]) + [pa.array(c, type=t) for c, (_, t) in zip(out, fields)]
            names = list(batch.schema.names[:n_in]) + [f for f, _ in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def remove_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = True
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text (see ``repeated_spans``).

    n_spans counts maximal removed runs; kept_sha256 is over the remaining
    bytes; kept_text drops the halves of a character that a cut splits (null
    stays null). Columns of these names in ``docs`` are replaced; every other
    column and row stays. An empty table gives an empty table.
    """
    spans = repeated_spans(spark, docs, length, anchor)
    per_doc = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept_text"] if keep_text else [])
    plain = docs.drop(*[c for c in docs.columns if c in extra or c in ("__id", "__spans", "__text")])
    joined = plain.join(per_doc, plain["doc_id"].cast("long") == F.col("__id"), "left").drop("__id")
    cols = [c for c in plain.columns if c != "text" or keep_text]
    joined = joined.select(*cols, F.col("text").cast("string").alias("__text"), "__spans")
    ddl = joined.select(*cols).schema
    for f in ["n_bytes", "n_removed", "n_spans"]:
        ddl = ddl.add(f, "long")
    ddl = ddl.add("kept_sha256", "string")
    if keep_text:
        ddl = ddl.add("kept_text", "string")
    return joined.mapInArrow(_cut(keep_text), ddl)
