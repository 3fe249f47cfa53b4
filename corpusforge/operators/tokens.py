"""Vocabulary, encode/decode, truncation and fixed-length padding.

A vocabulary whose summed bytes are under ``MAP_VOCAB_MAX_BYTES`` goes to every
task as one Arrow table; tokens are cut by Spark's own regular expressions and
looked up batch by batch (a hash lookup over whole columns), so rows neither
explode nor shuffle and the same code encodes a stream. Of a larger vocabulary the
tasks hold that many bytes of the most frequent tokens; only the other tokens of a
row are joined, and put back in their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusforge.functions import text as tx
from corpusforge.functions.rules import BOS_ID, EOS_ID, N_SPECIALS, PAD_ID, SPECIALS, UNK_ID, VOCAB_MULTIPLE
from corpusforge.operators.index import range_index


def vocab_build(docs: DataFrame, text_col: str = "text", fast: bool = False) -> DataFrame:
    """(token, id, count) ranked by count desc, token asc; specials take ids 0..4.

    Word count with map-side partial aggregation, then the positions of a range
    sort over distinct tokens.
    """
    counts = (
        docs.select(F.explode(tx.tokens(text_col, fast)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = range_index(counts, order=[F.col("count").desc(), F.col("token")], name="_r")
    words = ranked.select("token", (F.col("_r") + N_SPECIALS).cast("int").alias("id"), F.col("count").cast("bigint"))
    spark = docs.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, count bigint")
    return specials.unionByName(words)


def padded_vocab_size(n: Column | int) -> Column:
    """Table grown to the next multiple of 64 (only when needed)."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.ceil(n / F.lit(VOCAB_MULTIPLE)) * VOCAB_MULTIPLE).cast("bigint")


#: bytes of tokens (with 16 for each) up to which the vocabulary goes to every task as one map
MAP_VOCAB_MAX_BYTES = 64 << 20
#: tokens beyond the sent part of a vocabulary up to which the tokens are sent to its rest, and not joined with it
ASKED_SENT = 1_000_000


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a reused table: written once as parquet in the shared folder named by ``spark.checkpoint.dir``."""
    from corpusforge.session import scratch_path, shuffles_cleaned

    path = scratch_path(df.sparkSession, "table")
    with shuffles_cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, rule: str = "") -> DataFrame:
    """``build(df)`` as a table kept under a fingerprint of its input: built once, then read by whoever asks again.

    The fingerprint is that of the files behind ``df`` (path, length, time of change), of the
    plan over them and of ``rule``; other files, a changed one or another rule give another table.
    A frame without files is built each time.
    """
    from corpusforge.session import checkpoint_dir, shuffles_cleaned

    spark = df.sparkSession
    files = sorted(df.inputFiles())
    if not files:
        return materialize(build(df))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256(repr((rule, name, df.schema.simpleString(), df._jdf.queryExecution().analyzed().canonicalized().toString())).encode())
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.update(f"{f}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    path = f"{checkpoint_dir(spark)}/{name}-{seen.hexdigest()[:24]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        built = build(df)
        with shuffles_cleaned(spark):
            built.write.mode("overwrite").parquet(path)  # an unfinished earlier build goes
    return spark.read.parquet(path)


def vocab_map(vocab: DataFrame, max_bytes: int | None = None) -> tuple[Broadcast, DataFrame | None]:
    """(token, id) for every task, and the rows of the vocabulary that have no room there (None if all have).

    Rows go by id, smallest first (the most frequent tokens of T03), up to ``max_bytes``; bytes are summed by
    blocks of ids, of which at most 1,024 fit."""
    max_bytes = MAP_VOCAB_MAX_BYTES if max_bytes is None else max_bytes
    known = vocab.__dict__.get("_sent")  # one frame is asked again by every micro-batch
    if known is None or known[0] != max_bytes:
        rows = materialize(vocab.select(F.col("token").cast("string").alias("token"), F.col("id").cast("int").alias("id")))
        sent, rest = sent_table(rows, max_bytes), None
        if sent is None:
            block = max(1, max_bytes // (16 * 1024))
            sizes = rows.where("id >= 0").groupBy(F.floor(F.col("id") / block).alias("b")).agg(F.sum(F.octet_length("token") + 16).alias("n"))
            first, total = 0, 0
            for b, n in sorted(tuple(r) for r in sizes.orderBy("b").limit(1024).collect()):
                total += n
                if total > max_bytes:
                    break
                first = (b + 1) * block
            head = F.coalesce(F.col("id").between(0, first - 1), F.lit(False))
            sent, rest = sent_table(rows.where(head), max_bytes), rows.where(~head)
        known = vocab._sent = (max_bytes, (sent, rest))
    return known[1]


def sent_table(table: DataFrame, max_bytes: int) -> Broadcast | None:
    """A table of (token, id) as one Arrow table for every task; None if its texts, with 16 bytes a row, exceed ``max_bytes``."""
    spark = table.sparkSession
    texts = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
    rows = materialize(table)  # summed, then fetched
    size = rows.agg((sum((F.sum(F.octet_length(c)) for c in texts), F.lit(0)) + 16 * F.count(F.lit(1))).alias("b")).first()["b"] or 0
    if size > max_bytes:
        return None
    got = rows.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as out:
        out.write_table(got)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _offsets(lengths: pa.Array) -> pa.Array:
    lengths = pc.fill_null(lengths, 0).cast(pa.int64())
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths)])


def _map_lists(df: DataFrame, key: Sequence[str], items: Column, sent: Broadcast, get: str, give: str, missing, out: str, kind: pa.DataType) -> DataFrame:
    """Each row's list looked up in the sent table (``get`` -> ``give``), row by row of Arrow batches: no shuffle, streams too.

    With ``missing`` None, items that the table lacks are null and stand in the list ``_rest`` as well, in their order."""
    cols = df.select(*key, items.alias("_items"))
    fields = [f for f in cols.schema.fields if f.name != "_items"]
    rest = [] if missing is not None else [StructField("_rest", cols.schema["_items"].dataType)]
    schema = StructType([*fields, StructField(out, ArrayType(from_arrow_type(kind))), *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(sent.value).read_all()
        values, results = table.column(get).combine_chunks(), table.column(give).combine_chunks()
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, offsets = lists.flatten(), _offsets(lists.value_lengths())
            found = results.take(pc.index_in(flat, value_set=values))
            if missing is not None:
                got = [pa.ListArray.from_arrays(offsets.cast(pa.int32()), found.fill_null(missing).cast(kind))]
            else:
                gone = found.is_null()
                at = _offsets(gone.cast(pa.int64())).take(offsets).cast(pa.int32())
                got = [pa.ListArray.from_arrays(offsets.cast(pa.int32()), found.cast(kind)), pa.ListArray.from_arrays(at, flat.filter(gone))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *got], schema.names)

    return cols.mapInArrow(run, schema)


def _fill_lists(df: DataFrame, key: Sequence[str], out: str, found: str) -> DataFrame:
    """The nulls of the list ``out`` replaced by the items of the list ``found``, in their order."""
    cols = df.select(*key, out, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 2).flatten()
            filled = pc.replace_with_mask(flat, flat.is_null(), batch.column(batch.num_columns - 1).flatten())
            got = pa.ListArray.from_arrays(_offsets(lists.value_lengths()).cast(pa.int32()), filled)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], got], batch.schema.names[:-1])

    return cols.mapInArrow(run, StructType(cols.schema.fields[:-1]))


def _lookup(df: DataFrame, key: Sequence[str], items: Column, vocab: DataFrame, get: str, give: str, missing, out: str, kind: pa.DataType,
            map_bytes: int | None) -> DataFrame:
    """Each row's list looked up in a vocabulary of any size.

    What the tasks hold of it is found where the row is. Only the items beyond that are joined with the other
    rows of the vocabulary, by the number of their row, and only the rows that have such items are joined with the outcome."""
    sent, rest = vocab_map(vocab, map_bytes)
    if rest is None:
        return _map_lists(df, key, items, sent, get, give, missing, out, kind)
    if df.isStreaming:
        raise ValueError("a stream needs a vocabulary of at most map_bytes; larger ones encode inside foreachBatch")
    rows = _map_lists(df, key, items, sent, get, give, None, out, kind)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))  # the row's number must not change
    asked = rows.where(F.size("_rest") > 0).select("_row", F.posexplode("_rest").alias("_pos", get))
    if (rows.agg(F.sum(F.size("_rest"))).first()[0] or 0) <= ASKED_SENT:  # a micro-batch, say: the vocabulary stays where it is
        words = materialize(asked.select(get).distinct())
        rest = F.broadcast(materialize(rest.join(F.broadcast(words), get, "left_semi")))
    item = F.struct("_pos", F.coalesce(give, F.lit(missing)).alias("v"))
    found = asked.join(rest, get, "left").groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("_found"))
    found = found.select("_row", F.transform("_found", lambda s: s["v"]).alias("_found"))
    filled = _fill_lists(rows.where(F.size("_rest") > 0).join(found, "_row"), key, out, "_found")
    return rows.where(F.size("_rest") == 0).select(*key, out).unionByName(filled)


def encode(
    df: DataFrame,
    key: Sequence[str],
    text_col: str,
    vocab: DataFrame,
    max_tokens: int | None = None,
    add_specials: bool = True,
    out: str = "ids",
    fast: bool = False,
    map_bytes: int | None = None,
    toks: Column | None = None,
) -> DataFrame:
    """Text -> token ids (unknown -> <unk>), optionally wrapped in <s> ... </s>.

    Returns ``key`` columns plus ``out``; rows with no token (a null text too) keep an
    empty list. ``vocab`` should be a stored table (its bytes are summed). Its first ``map_bytes``
    (``MAP_VOCAB_MAX_BYTES``) go to the tasks as a map; if that is all of it, rows stay where they are and ``df`` may
    be a stream. Tokens beyond are joined with the rest of the vocabulary. ``toks``: the tokens, where they are cut already.
    """
    if toks is None:
        toks = tx.tokens(text_col, fast) if max_tokens is None else tx.tokens_head(text_col, max_tokens, fast)
    grouped = _lookup(df, key, toks, vocab, "token", "id", UNK_ID, "_ids", pa.int32(), map_bytes)
    ids = F.col("_ids")
    if add_specials:
        ids = F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))
    return grouped.select(*key, ids.alias(out))


def decode(df: DataFrame, key: Sequence[str], ids_col: str, vocab: DataFrame, out: str = "text",
           map_bytes: int | None = None) -> DataFrame:
    """Ids -> tokens joined by one space (whitespace is lost, as in any decode)."""
    grouped = _lookup(df, key, F.col(ids_col).cast("array<int>"), vocab, "id", "token", SPECIALS[UNK_ID], "_t", pa.string(), map_bytes)
    return grouped.select(*key, F.array_join("_t", " ").alias(out))


def pad_truncate(ids, length: int, pad_id: int = PAD_ID, side: str = "right") -> tuple[Column, Column]:
    """Fixed-length (input_ids, attention_mask); ``side`` is where pads go."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(ids, 1, length)
    n = F.size(cut)
    pads = F.array_repeat(F.lit(pad_id), F.lit(length) - n)
    ones = F.array_repeat(F.lit(1), n)
    zeros = F.array_repeat(F.lit(0), F.lit(length) - n)
    if side == "right":
        return F.concat(cut, pads), F.concat(ones, zeros)
    if side == "left":
        return F.concat(pads, cut), F.concat(zeros, ones)
    raise ValueError("side must be 'right' or 'left'")


def pair_encode_only_first(first, second, length: int) -> Column:
    """<s> A </s></s> B </s>, only A shortened; null when B alone does not fit."""
    a = F.col(first) if isinstance(first, str) else first
    b = F.col(second) if isinstance(second, str) else second
    room = F.lit(length - 4) - F.size(b)
    ids = F.concat(
        F.array(F.lit(BOS_ID)), F.slice(a, 1, F.greatest(room, F.lit(0))),
        F.array(F.lit(EOS_ID), F.lit(EOS_ID)), b, F.array(F.lit(EOS_ID)),
    )
    return F.when(room >= 0, ids)
