"""Corpus-building projections, filters, lookups, reshapes."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators.index import range_index

# --- P: projections and filters -------------------------------------------------

def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep only the named columns (missing ones raise, as the reference's select does)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Drop named columns; ``cols=None`` drops every input column except ``keep``."""
    cols = [c for c in df.columns if c not in keep] if cols is None else list(cols)
    return df.drop(*cols)


def rename_pair(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rename two text columns to ``source_text`` / ``target_text``."""
    return df.withColumnsRenamed({source: "source_text", target: "target_text"})


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant provenance columns."""
    return df.withColumns({k: (v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()})


def filter_nonempty_pair(df: DataFrame, a: str = "source_text", b: str = "target_text") -> DataFrame:
    """Both texts differ from ''. No trim: whitespace-only text survives."""
    return df.where((F.col(a) != "") & (F.col(b) != ""))


def filter_distinct_lang(df: DataFrame, a: str = "source_lang", b: str = "target_lang") -> DataFrame:
    """Source code differs from target code (on codes, before any mapping)."""
    return df.where(F.col(a) != F.col(b))


def lang_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """Dictionary table (code, name); its size is the literal's size."""
    return spark.createDataFrame(sorted(mapping.items()), "code string, name string")


#: rows of a dictionary up to which it is sent to every task
DICTIONARY_MAX = 100_000


def sent_along(dictionary: DataFrame) -> DataFrame:
    """The dictionary with a broadcast hint if it has at most ``DICTIONARY_MAX`` rows (counted); beyond that a shuffle join
    does the lookup. Codes are few and frequent, so a small one must not be joined by a shuffle on them."""
    few = dictionary.limit(DICTIONARY_MAX + 1).count() <= DICTIONARY_MAX
    return F.broadcast(dictionary) if few else dictionary


def filter_lang_allowlist(df: DataFrame, dictionary: DataFrame, cols=("source_lang", "target_lang")) -> DataFrame:
    """Keep rows whose codes are all dictionary keys (left-semi joins; a dictionary of counted, small size is sent along)."""
    keys = sent_along(dictionary.select(F.col("code")).distinct())
    for c in cols:
        df = df.join(keys.withColumnRenamed("code", f"_k_{c}"), F.col(c) == F.col(f"_k_{c}"), "left_semi")
    return df


def dense_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Throw away any old index; number rows 0..n-1 in ``order``."""
    return range_index(df, order=list(order), name=name)


# --- J: joins and lookups -------------------------------------------------------

def lookup_lang_name(df: DataFrame, dictionary: DataFrame, cols=("source_lang", "target_lang"),
                     drop_same_name: bool = False) -> DataFrame:
    """Code -> name on each side, by joins on the dictionary (sent along if its counted size is small).

    Two codes may share one name, so a pair can become same-name after mapping;
    it is kept (decision Q5) unless ``drop_same_name``."""
    d = sent_along(dictionary)
    for c in cols:
        df = (
            df.join(d.withColumnsRenamed({"code": "_code", "name": "_name"}), F.col(c) == F.col("_code"), "left")
            .drop(c, "_code")
            .withColumnRenamed("_name", c)
        )
    if drop_same_name and len(cols) == 2:
        df = df.where(~F.col(cols[0]).eqNullSafe(F.col(cols[1])))
    return df


def _map_literal(mapping: Mapping) -> Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def lookup_label_id(df: DataFrame, col: str, mapping: Mapping[str, int], out: str = "labels",
                    on_unknown: str = "error") -> DataFrame:
    """Label text -> id from a map literal (no join). Unknown labels raise,
    or with ``on_unknown='null'`` stay null for a later count."""
    v = _map_literal(mapping)[F.col(col)]
    if on_unknown == "error":
        v = F.when(v.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col(col).cast("string")))).otherwise(v)
    return df.withColumn(out, v.cast("int"))


def lookup_label_name(df: DataFrame, col: str, mapping: Mapping[str, int], out: str = "label_text") -> DataFrame:
    """Id -> label text through the inverse map (must be 1:1)."""
    inverse = {v: k for k, v in mapping.items()}
    if len(inverse) != len(mapping):
        raise ValueError("label dictionary is not one-to-one")
    return df.withColumn(out, _map_literal(inverse)[F.col(col)])


def zip_arrays(*cols: str) -> Column:
    """J04 (arrays): positional zip of equal-length arrays; unequal lengths raise."""
    sizes = [F.size(c) for c in cols]
    same = reduce(lambda a, b: a & b, [s == sizes[0] for s in sizes[1:]], F.lit(True))
    return F.when(same, F.arrays_zip(*cols)).otherwise(F.raise_error(F.lit("zip: arrays differ in length")))


#: consecutive numbers that are dealt out together when tables are zipped
ZIP_ROWS = 64


def zip_tables(left: DataFrame, right: DataFrame, index: str = "line_no") -> DataFrame:
    """J04 (tables): positional zip = equi-join on a dense line index (whole numbers).

    Both sides must have the same number of rows, else the zip is rejected:
    a row without a partner raises when the result is read. The rows of both
    sides are shuffled once, in runs of ``ZIP_ROWS`` numbers, so that a shuffle's
    compression finds what neighbours share."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(index), F.struct(*[c for c in df.columns if c != index], F.lit(True).alias("_has")).alias(name))

    both = side(left, "_l").unionByName(side(right, "_r"), allowMissingColumns=True).withColumn("_run", F.floor(F.col(index) / ZIP_ROWS))
    met = both.repartition("_run").groupBy("_run", index).agg(F.collect_list("_l").alias("_l"), F.collect_list("_r").alias("_r"))
    paired = F.col(index).isNotNull() & (F.size("_l") > 0) & (F.size("_r") > 0)
    met = met.where(F.when(paired, True).otherwise(F.raise_error(F.lit("zip: tables differ in length"))))
    met = met.select(index, F.explode("_l").alias("_l"), "_r").select(index, "_l", F.explode("_r").alias("_r"))
    return met.select(index, "_l.*", "_r.*").drop("_has")


# --- U: set operations and reshape ------------------------------------------------

def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL aligning by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_same_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames that must share one schema."""
    first = frames[0].schema
    for f in frames[1:]:
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first]:
            raise ValueError("schemas differ")
    return reduce(lambda a, b: a.union(b), frames)


def unpivot_ordered_pairs(df: DataFrame, lang_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A wide row with k language columns -> k*(k-1) ordered (source, target) rows.

    One scan and one explode over a literal list of column pairs; null cells
    stay as null text.
    """
    pairs = [
        F.struct(F.lit(a).alias("source_lang"), F.lit(b).alias("target_lang"),
                 F.col(a).alias("source_text"), F.col(b).alias("target_text"))
        for a, b in itertools.permutations(lang_cols, 2)
    ]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.*")


def duplicate_n(df: DataFrame, n: int, name: str = "copy_id") -> DataFrame:
    """The whole table N times; ``copy_id`` (0..N-1) seeds later per-copy draws."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
