"""Query op1: all documents mixed to source weights 1, 2, 3, repeating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.mixing import mix_sources


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE: dict[str, str] = {}
