"""Query op6: reply-ordered chat messages of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.quote_links import link_conversations


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_quote_links": op6_quote_links}
ORACLE: dict[str, str] = {}
