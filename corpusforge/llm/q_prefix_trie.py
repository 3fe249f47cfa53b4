"""Query op13: the prefix trie of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.prefix_trie import prefix_trie


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(spark, rows).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE: dict[str, str] = {}
