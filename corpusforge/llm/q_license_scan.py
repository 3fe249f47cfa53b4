"""Query op4: licence notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.license_scan import scan_licences


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE: dict[str, str] = {}
