"""The pair corpus from its three kinds of files, as one stored table (S06, S08, S09 -> P05-P07, J01, U03 -> U01 -> S12)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from corpusforge.functions.rules import ALIGNED_LANGS
from corpusforge.operators import pairs as pr
from corpusforge.sources import files as fl

COLUMNS = ["source_lang", "target_lang", "source_text", "target_text", "data_split", "data_source"]


def aligned_part(spark: SparkSession, root: str, layout: str = "files", names: Mapping[str, str] = ALIGNED_LANGS) -> tuple[DataFrame, DataFrame]:
    """(pairs, status): aligned line files whose two texts are not empty and whose two codes differ and are in ``names``.

    Codes become names; two codes of one name make a pair of that name with
    itself, which stays (decision Q5). status counts the rows per manifest
    entry before codes are looked up."""
    pairs, status = fl.read_aligned(spark, root, layout)
    table = pr.lang_table(spark, names)
    kept = pr.filter_distinct_lang(pr.filter_nonempty_pair(pairs))
    kept = pr.lookup_lang_name(pr.filter_lang_allowlist(kept, table), table)
    return kept.select(*COLUMNS), fl.manifest_counts(pairs, status)


def wide_part(spark: SparkSession, folder: str) -> DataFrame:
    """Every ordered pair of a wide CSV's language columns; empty cells stay, as null text."""
    wide = fl.read_wide_csv_dir(spark, folder)
    langs = [c for c in wide.columns if c not in ("data_split", "data_source")]
    return pr.unpivot_ordered_pairs(wide, langs, keep=["data_split", "data_source"]).select(*COLUMNS)


def build_pair_corpus(spark: SparkSession, out: str, aligned: str, wide: str, lexicon: str, layout: str = "files",
                      names: Mapping[str, str] = ALIGNED_LANGS, lexicon_split: str = "train") -> tuple[DataFrame, DataFrame]:
    """Write the corpus to ``out``, by split, and give (the table read back, status of the aligned files).

    ``out`` must not exist. Repeated rows stay, as do texts that occur in more
    than one part. The plan is a union: no part's rows are shuffled for it."""
    pairs, status = aligned_part(spark, aligned, layout, names)
    words = fl.read_lexicon_dir(spark, lexicon, lexicon_split).select(*COLUMNS)
    fl.write_table(pr.union_by_name([pairs, wide_part(spark, wide), words]), out)
    return fl.read_split(spark, out).select(*COLUMNS), status
