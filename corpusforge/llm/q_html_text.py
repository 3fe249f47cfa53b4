"""Query op3: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.html_text import extract_main_text


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op3_html_text": op3_html_text}
ORACLE: dict[str, str] = {}
