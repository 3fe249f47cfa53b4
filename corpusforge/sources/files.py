"""Readers and writers for the corpus file layouts.

Every reader is one Spark read over all matching files (never a driver loop
over rows); file-derived columns come from the ``_metadata`` column. Line
order inside a file is recovered from (file, block start, row id in split)
and turned into dense line numbers with the bucketed index (D00).
"""

from __future__ import annotations

import csv
import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions.rules import (
    ALIGNED_SPLITS,
    ALIGNED_SUBSETS,
    LEXICON_PIVOT_COLUMN,
    SOURCE_ALIGNED_PREFIX,
    SOURCE_LEXICON,
    SOURCE_WIDE,
)
from corpusforge.operators.index import range_index

# pandas' default missing-value words (read_csv): cells holding one of these read as null.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PAIR4 = ["source_lang", "target_lang", "source_text", "target_text"]


def na_to_null(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(list(tokens)), F.lit(None)).otherwise(F.col(c)) for c in cols})


# --- S01, S12, S14: tables --------------------------------------------------------------

def read_split(spark: SparkSession, path: str, split: str | None = None, col: str = "data_split") -> DataFrame:
    """A stored table's split; the filter prunes partitions of a partitioned table."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col(col) == split)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("data_split",), mode: str = "errorifexists") -> str:
    """Publish a table as parquet partitioned by split; returns the path."""
    df.write.mode(mode).partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_state(spark: SparkSession, path: str) -> str:
    """'absent', 'empty', 'complete' (has _SUCCESS) or 'partial'."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return "absent"
    if fs.isFile(p):
        return "partial"
    if fs.exists(p.suffix("/_SUCCESS")):
        return "complete"
    return "empty" if len(fs.listStatus(p)) == 0 else "partial"


def guarded_write(df: DataFrame, path: str, overwrite: bool = False, reuse: bool = False,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Refuse a non-empty output folder unless ``overwrite``; with ``reuse`` a
    complete earlier result is read instead of rebuilt. The guard runs before any work."""
    spark = df.sparkSession
    state = path_state(spark, path)
    if reuse and state == "complete":
        return spark.read.parquet(path)
    if state not in ("absent", "empty") and not overwrite:
        raise FileExistsError(f"output folder {path} exists and is not empty; set overwrite")
    df.write.mode("overwrite" if state != "absent" else "errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def append_metrics(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Append (run, phase, metric, value double) rows to the metric table."""
    out = rows.select(F.col("run").cast("string"), F.col("phase").cast("string"), F.col("metric").cast("string"),
                      F.col("value").cast("double"))
    out.write.mode("append").parquet(path)
    return spark.read.parquet(path)


# --- S02, S03, S05, S11: text files ----------------------------------------------------------

def _raw_lines(spark: SparkSession, path, sep: str | None = None) -> DataFrame:
    """(value, file, size, block, rid): lines with the file block they lie in; ``rid`` rises by 1 from line to line of a block."""
    r = spark.read if sep is None else spark.read.option("lineSep", sep)
    return r.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("rid"))


def number_lines(lines: DataFrame, per: Sequence[str] = ("file",), name: str = "line_no") -> DataFrame:
    """Add ``name`` = 0-based line number within ``per`` (``()`` numbers across all files, by path).

    Blocks are counted (one row per file block), their counts summed up in
    file order, sent to the tasks, and a line's place in its block added: no line is sorted or
    shuffled. A compressed file is one block, so its order holds as well."""
    heads = lines.groupBy(*dict.fromkeys([*per, "file", "block"])).agg(F.count(F.lit(1)).alias("_n"), F.min("rid").alias("_first"))
    before = Window.partitionBy(*per).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return lines.join(F.broadcast(heads), ["file", "block"]).withColumn(name, (F.col("rid") + F.col("_off")).cast("bigint")).drop("_off")


def _block_parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((file, block), its rows) for each run of rows of one file block."""
    if batch.num_rows == 0:
        return
    file, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
    code = file.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
        yield (file.dictionary[int(code[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _block_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, q) of lines in their order -> per file block its quotes, lines, and the lines with an even number of the block's quotes before them."""
    at, quotes, lines, even = None, 0, 0, 0
    for batch in batches:
        out = []
        for place, part in _block_parts(batch):
            if place != at:
                if at:
                    out.append((*at, quotes, lines, even))
                at, quotes, lines, even = place, 0, 0, 0
            q = part.column(2).to_numpy(zero_copy_only=False)
            run = quotes + np.cumsum(q)
            lines, even, quotes = lines + len(q), even + int(((run - q) % 2 == 0).sum()), int(run[-1])
        yield _arrow(out, BLOCK_STARTS)
    yield _arrow([(*at, quotes, lines, even)] if at else [], BLOCK_STARTS)


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, q, value) of lines in their order -> the records of each file block, numbered from 0 in it.

    With ``odd`` the block begins inside a record: that piece has number -1. ``ends`` is false of a last piece that goes on after the block.
    Lines are looked at and joined a batch at a time."""
    at, inside, held, k = None, 0, [], 0

    def rest() -> pa.RecordBatch:
        return _arrow([(*at, k, "\n".join(held), False)] if held else [], BLOCK_RECORDS)

    for batch in batches:
        for place, part in _block_parts(batch):
            if place != at:
                yield rest()
                odd = int(part.column(2)[0].as_py())
                at, inside, held, k = place, odd, [], -odd
            value = part.column(4)
            open_after = (inside + np.cumsum(part.column(3).to_numpy(zero_copy_only=False))) % 2
            ends = np.flatnonzero(open_after == 0) + 1
            inside, done = int(open_after[-1]), int(ends[-1]) if len(ends) else 0
            if done:
                whole = value.slice(0, done)
                if len(ends) < done:  # some records have several lines
                    bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
                    whole = pc.binary_join(pa.ListArray.from_arrays(bounds, whole), "\n")
                if held:
                    first = "\n".join([*held, whole[0].as_py()])
                    whole = pa.concat_arrays([pa.array([first], pa.string()), whole.slice(1)])
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(at[0], pa.string()), n), pa.repeat(pa.scalar(at[1], pa.int64()), n),
                     pa.array(np.arange(k, k + n, dtype=np.int64)), whole, pa.repeat(True, n)], list(BLOCK_RECORDS))
                held, k = [], k + n
            held.extend(value.slice(done).to_pylist())
    yield rest()


BLOCK_STARTS = {"file": "string", "block": "bigint", "quotes": "bigint", "lines": "bigint", "even": "bigint"}
BLOCK_RECORDS = {"file": "string", "block": "bigint", "k": "bigint", "value": "string", "ends": "boolean"}
ARROW_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _arrow(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW_TYPES[t]) for c, t in zip(columns, fields.values())], list(fields))


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, value): the records of CSV files, numbered from 0 (the header); a quoted field may hold line ends.

    Files are read in splits. A line begins a record if an even number of
    quotes stands before it in its file; quotes, then record starts, are
    summed per block (a small table), and each block's lines become records where they are read.
    Only pieces of records that run over block ends are brought together."""
    from corpusforge.operators.tokens import materialize

    lines = _raw_lines(spark, path, "\n")
    lines = lines.withColumn("value", F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")))
    lines = lines.withColumn("q", F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = lines.select("file", "block", "q").mapInArrow(_block_starts, _ddl(BLOCK_STARTS))
    heads = heads.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("odd") == 0, F.col("even")).otherwise(F.col("lines") - F.col("even"))
    heads = heads.withColumn("starts", starts).withColumn("before", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
    heads = materialize(heads.select("file", "block", "odd", "before"))  # one row per file block
    known = F.broadcast(heads)
    pieces = lines.join(known.select("file", "block", "odd"), ["file", "block"]).select("file", "block", "odd", "q", "value")
    pieces = pieces.mapInArrow(_block_records, _ddl(BLOCK_RECORDS)).join(known.select("file", "block", "before"), ["file", "block"])
    pieces = pieces.withColumn("rec", F.col("before") + F.col("k"))
    if heads.where("odd = 1").isEmpty():  # no record runs over a block's end
        return pieces.select("file", "rec", "value")
    whole = F.col("ends") & (F.col("k") >= 0)
    cut = pieces.where(~whole).groupBy("file", "rec").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return pieces.where(whole).select("file", "rec", "value").unionByName(cut)


def _parsed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV records by each file's own header, with (file, line_no) = place among the file's data records."""
    records = _csv_records(spark, path).where("value <> ''")
    heads = sorted(records.where("rec = 0").select("file", "value").collect())  # one row per file
    options = {"escape": '"', "mode": "PERMISSIVE"}
    frames = []
    names_of = {h["file"]: next(csv.reader([h["value"]])) for h in heads}
    for names in dict.fromkeys(tuple(n) for n in names_of.values()):
        own = [f for f, n in names_of.items() if tuple(n) == names]
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        got = records.where(F.col("file").isin(own) & (F.col("rec") > 0))
        frames.append(got.select(F.from_csv("value", schema, options).alias("_c"), "file", (F.col("rec") - 1).alias("line_no"))
                      .select("_c.*", "file", "line_no"))
    if not frames:
        return spark.createDataFrame([], "file string, line_no bigint")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_by_extension(spark: SparkSession, train_file: str | None = None, validation_file: str | None = None,
                      required: Sequence[str] = PAIR4) -> DataFrame:
    """Csv / json / txt chosen by the suffix of the train file, or of the validation
    file where that is all there is; it decides the reader for both. Other suffixes raise;
    required columns are checked up front and named when missing. ``file`` and ``line_no``
    say where a row stood, in every format (D03 cuts the head by them)."""
    first = train_file or validation_file
    if not first:
        raise ValueError("a train or a validation file is needed")
    ext = first.rstrip("/").rsplit(".", 1)[-1].lower() if "." in first.rsplit("/", 1)[-1] else ""
    if ext not in ("csv", "json", "txt"):
        raise ValueError(f"train file must be csv, json or txt, got '{ext}'")

    def load(p):
        if ext == "csv":
            return _parsed_csv(spark, p)
        lines = number_lines(_raw_lines(spark, p)).select("value", "file", "line_no")
        if ext == "txt":
            return lines.withColumnRenamed("value", "text")
        schema = spark.read.json(p).schema
        return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("_j"), "file", "line_no").select("_j.*", "file", "line_no")

    frames = [load(p).withColumn("data_split", F.lit(name)) for name, p in (("train", train_file), ("validation", validation_file)) if p]
    missing = [c for c in required if c not in frames[0].columns]
    if missing:
        raise ValueError(f"missing columns for the template: {missing}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: two characters that are common in text: a file's last character differs from one of them
TAIL_MARKS = (" ", "e")


def _compressed(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of ``paths`` that Spark will read through a codec."""
    jvm = spark.sparkContext._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return [p for p in paths if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is not None]


def open_ended_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files whose last line has no line end, found by tasks, whatever the codec.

    A plain file's lines and line ends add up to its length. The length of a
    compressed one is not known, so it is read again, cut at one common
    character and at another: if it ends with a line end, so does the last
    piece of both; if not, one of the two characters is not its last, and that
    reading's last piece ends with something else. Pieces must fit in memory."""
    lines = _raw_lines(spark, path, "\n")
    packed = _compressed(spark, lines.inputFiles())
    plain = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("b"), F.first("size").alias("size"))
    out = plain.where("b = size + 1").select("file")
    if packed:
        tails = [_raw_lines(spark, packed, c).groupBy("file").agg(F.max_by(F.right("value", F.lit(1)), F.struct("block", "rid")).alias("t")) for c in TAIL_MARKS]
        known = [t.where(F.col("t") == "\n").select("file") for t in tails]
        names = tails[0].select("file").union(tails[1].select("file")).distinct()
        ended = known[0].join(known[1], "file")
        out = out.join(names, "file", "left_anti").union(names.join(ended, "file", "left_anti"))
    return out


def read_text_lines(spark: SparkSession, path: str, keep_linebreaks: bool = True) -> DataFrame:
    """One row per line; with ``keep_linebreaks`` the newline is part of the text,
    except on a file's last line when the file does not end with one (inside gzip too)."""
    if not keep_linebreaks:
        return spark.read.text(path).select(F.col("value").alias("text"))
    lines = _raw_lines(spark, path, "\n")
    last = lines.groupBy("file").agg(F.max(F.struct("block", "rid")).alias("_last")).join(open_ended_files(spark, path), "file")
    j = lines.join(last, "file", "left")
    is_last = F.coalesce(F.struct("block", "rid") == F.col("_last"), F.lit(False))
    return j.select(F.when(is_last, F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("text"))


def read_line_file(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """File -> (file, line_no, text); inner blank lines kept as ''; \\r\\n, \\r and \\n all end a line.
    ``across`` numbers all files' lines on, by path (a line file written in parts)."""
    lines = number_lines(_raw_lines(spark, path), per=() if across else ("file",))
    return lines.select("file", "line_no", F.col("value").alias("text"))


def read_gzip_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Gzip text read directly, with line numbers; one gzip is one task, so the lines are spread after."""
    return read_line_file(spark, path).repartition(partitions or spark.sparkContext.defaultParallelism)


# --- S04, S06, S07: the aligned corpus ------------------------------------------------------------

def read_id_file(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Headerless TSV; 3 columns for train (its own first column is discarded), 2 otherwise."""
    names = ["data_source", "source_lang", "target_lang"] if split == "train" else ["source_lang", "target_lang"]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("sep", "\t").option("header", False).schema(schema).csv(path).select(
        "source_lang", "target_lang")


#: consecutive lines that are dealt out together when line files are zipped
ZIP_LINES = 64

ALIGNED_RE = r"/([^/]+)/([^/]+)\.(id|src|trg)(\.gz)?(/part-[^/]+)?$"


def _raw_aligned(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """(value, kind, subset, split, file, block, rid) of the lines of all line files, plain or gzip."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("rid")]
    if layout == "partitioned":
        return spark.read.text(root).select("value", "kind", "subset", "split", *place)  # discovers kind / subset / split columns
    fp = F.col("_metadata.file_path")
    return spark.read.option("recursiveFileLookup", True).text(f"{root}/*").where(fp.rlike(ALIGNED_RE)).select(
        "value", F.regexp_extract(fp, ALIGNED_RE, 3).alias("kind"), F.regexp_extract(fp, ALIGNED_RE, 1).alias("subset"),
        F.regexp_extract(fp, ALIGNED_RE, 2).alias("split"), *place)


def _aligned_lines(df: DataFrame) -> DataFrame:
    """(subset, split, kind, line_no, value) of ``_raw_aligned``, numbered within (subset, split, kind)."""
    per = ["subset", "split", "kind"]
    lines = number_lines(df.where(F.col("kind") != "id"), per)
    # blank lines of the id table are skipped (blank text lines hold alignment and stay): what is left is
    # ranked within its file block and the counts of earlier blocks added
    ids = df.where((F.col("kind") == "id") & (F.trim("value") != ""))
    ids = ids.withColumn("rid", F.row_number().over(Window.partitionBy(*per, "file", "block").orderBy("rid")))
    ids = number_lines(ids, per)
    return lines.unionByName(ids).select(*per, "line_no", "value")


def read_aligned(spark: SparkSession, root: str, layout: str = "files") -> tuple[DataFrame, DataFrame]:
    """S06 + S07: (pairs, status). Pairs zip .id/.src/.trg by line number for every
    (subset, split) whose three files have equal line counts; status reports rows
    per loaded entry and the true reason for every other one.

    The lines of all three kinds are shuffled once, in runs of ``ZIP_LINES``
    numbers, so that a shuffle's compression finds what neighbours share."""
    # a line's number hangs on its file, block and place there alone, so lines are numbered where they are read and kept nowhere;
    # they are counted without their numbers
    df = _raw_aligned(spark, root, layout)
    counted = df.where((F.col("kind") != "id") | (F.trim("value") != ""))
    counts = counted.groupBy("subset", "split").pivot("kind", ["id", "src", "trg"]).agg(F.count(F.lit(1)))
    lines = _aligned_lines(df)
    expected = spark.createDataFrame([(s, p) for s in ALIGNED_SUBSETS for p in ALIGNED_SPLITS], "subset string, split string")
    status = expected.join(counts, ["subset", "split"], "full")
    reason = (
        F.when(F.col("id").isNull() & F.col("src").isNull() & F.col("trg").isNull(), "missing files")
        .when(F.col("id").isNull() | F.col("src").isNull() | F.col("trg").isNull(), "missing file")
        .when((F.col("id") != F.col("src")) | (F.col("src") != F.col("trg")), "line counts differ")
    )
    status = status.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "loaded").otherwise("rejected"))
    ok = status.where(F.col("status") == "loaded").select("subset", "split")
    # one row per (subset, split); a null name equals none, so its lines go
    loaded = lines.join(F.broadcast(ok), ["subset", "split"], "left_semi").withColumn("_run", F.floor(F.col("line_no") / ZIP_LINES))
    value = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("value")), ignorenulls=True)  # noqa: E731  a number is there once in each kind
    zipped = loaded.repartition("subset", "split", "_run").groupBy("subset", "split", "_run", "line_no").agg(
        F.split(value("id"), "\t").alias("f"), value("src").alias("source_text"), value("trg").alias("target_text"))
    zipped = zipped.withColumns({
        "source_lang": F.when(F.col("split") == "train", F.get("f", F.lit(1))).otherwise(F.get("f", F.lit(0))),
        "target_lang": F.when(F.col("split") == "train", F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1)))})
    pairs = zipped.select(
        "line_no", "source_lang", "target_lang", "source_text", "target_text",
        F.col("split").alias("data_split"), F.concat(F.lit(SOURCE_ALIGNED_PREFIX), "subset").alias("data_source"))
    return pairs, status


def manifest_counts(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """Rows per loaded entry after the non-empty and distinct-code filters."""
    kept = pairs.where((F.col("source_text") != "") & (F.col("target_text") != "")
                       & (F.col("source_lang") != F.col("target_lang")))
    n = kept.groupBy("data_source", "data_split").agg(F.count(F.lit(1)).alias("n_rows"))
    st = status.select(F.concat(F.lit(SOURCE_ALIGNED_PREFIX), "subset").alias("data_source"),
                       F.col("split").alias("data_split"), "status", "reason")
    return st.join(n, ["data_source", "data_split"], "left").withColumn(
        "n_rows", F.when(F.col("status") == "loaded", F.coalesce("n_rows", F.lit(0))).cast("bigint"))


def _one_line(col: str) -> Column:
    """A text as one line of a line file: line breaks become spaces, null becomes ''."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"[\r\n]", " ")


def write_aligned(df: DataFrame, root: str, order: str, partitions: int | None = None, dealt: bool = False) -> None:
    """Write pairs as aligned line files (gzip) in the partitioned layout, one job:
    root/kind=<id|src|trg>/subset=<s>/split=<p>/part-*. Lines of the three kinds
    follow the same order (range partitions sorted by ``order``); a line file
    holds one text per line, so line breaks inside a text become spaces.
    ``dealt``: the rows lie in range partitions of (subset, split, order) already."""
    rows = df.select(
        F.col("subset"), F.col("split"), F.col(order).alias("_o"),
        F.when(F.col("split") == "train", F.concat_ws("\t", "data_source", "source_lang", "target_lang"))
        .otherwise(F.concat_ws("\t", "source_lang", "target_lang")).alias("_id"), "source_text", "target_text")
    if not dealt:
        partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(partitions, "subset", "split", "_o")
    rows = rows.select("subset", "split", "_o", F.explode(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("_id").alias("value")),
        F.struct(F.lit("src").alias("kind"), _one_line("source_text").alias("value")),
        F.struct(F.lit("trg").alias("kind"), _one_line("target_text").alias("value")),
    )).alias("r")).select("subset", "split", "_o", "r.*")
    rows = rows.sortWithinPartitions("kind", "subset", "split", "_o")
    rows.select("value", "kind", "subset", "split").write.partitionBy("kind", "subset", "split").option("compression", "gzip").text(root)


# --- S08, S09, S10: CSV folders ---------------------------------------------------------------------

def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"')


def _csv_entries(spark: SparkSession, folder: str) -> list[str]:
    """Names of the *.csv files (or folders of part files) in a folder."""
    fs, p = _fs(spark, folder)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".csv"))


def read_wide_csv_dir(spark: SparkSession, folder: str, index_col: bool = True) -> DataFrame:
    """Every *.csv of a folder; split = file name up to the first '.'; the leading index column is dropped.

    Each file is read by its own header, so files may order their columns
    differently; a column that a file lacks is null. One plan per file: a
    folder has one file per split."""
    folder = folder.rstrip("/")
    frames = []
    for name in _csv_entries(spark, folder):
        df = _csv(spark).csv(f"{folder}/{name}")
        df = df.drop(df.columns[0]) if index_col else df
        frames.append(df.withColumn("data_split", F.lit(name.split(".")[0])))
    if not frames:
        raise FileNotFoundError(f"no csv in {folder}")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    langs = [c for c in df.columns if c != "data_split"]
    return na_to_null(df, langs).withColumn("data_source", F.lit(SOURCE_WIDE))


def read_lexicon_dir(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """One read per lexicon file (their column names differ), renamed and stacked.
    Language = file name without '.csv'; ``split`` is explicit (decision Q3)."""
    fs, p = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    frames = []
    for name in names:
        if not name.endswith(".csv"):
            continue  # only CSV files are lexicons
        lang = name[: -len(".csv")]
        df = _csv(spark).csv(f"{folder.rstrip('/')}/{name}")
        df = df.select(F.col(LEXICON_PIVOT_COLUMN).alias("source_text"), F.col(f"`{lang}`").alias("target_text"))
        frames.append(na_to_null(df, ["source_text", "target_text"]).select(
            F.lit(LEXICON_PIVOT_COLUMN).alias("source_lang"), F.lit(lang).alias("target_lang"),
            "source_text", "target_text", F.lit(SOURCE_LEXICON).alias("data_source"),
            F.lit(split).alias("data_split")))
    if not frames:
        raise FileNotFoundError(f"no lexicon csv in {folder}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_nested_dir(spark: SparkSession, folder: str) -> DataFrame:
    """<lang>/<split>.csv; adds ``language`` and ``split`` from the path. Each file is read by its own header."""
    folder = folder.rstrip("/")
    fs, p = _fs(spark, folder)
    frames = []
    for lang in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()):
        for name in _csv_entries(spark, f"{folder}/{lang}"):
            df = _csv(spark).csv(f"{folder}/{lang}/{name}")
            frames.append(df.withColumns({"language": F.lit(lang), "split": F.lit(name[: -len(".csv")])}))
    if not frames:
        raise FileNotFoundError(f"no csv in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv_with_index(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV with a header and a leading unnamed, unique 0..n-1 index (decision Q4)."""
    idx = range_index(df, order=list(order), name="_idx")
    cols = ["_idx"] + [c for c in df.columns]
    idx.select(*cols).withColumnRenamed("_idx", "Unnamed: 0").write.option("header", True).option(
        "escape", '"').csv(path)
