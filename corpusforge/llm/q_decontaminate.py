"""Query op10: benchmark items found in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.decontaminate import contaminated


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE: dict[str, str] = {}
