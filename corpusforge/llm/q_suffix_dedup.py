"""Query op9: repeated passages of 100 bytes over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.suffix_dedup import remove_repeats


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(spark, docs, keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE: dict[str, str] = {}
