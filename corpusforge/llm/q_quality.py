"""Query op8: every document judged by voting rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.quality import judge_quality


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return judge_quality(spark, docs).select(*cols)


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
