"""Query op12: all embeddings whitened on their first 8 components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.whitening import whiten


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(spark, rows).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
