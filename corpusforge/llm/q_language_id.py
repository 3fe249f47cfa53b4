"""Query op5: the language of every document, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.language_id import fit_language_model, identify_language, in_held_out


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = in_held_out(docs["doc_id"])
    model = fit_language_model(spark, docs.where(~held))
    out = identify_language(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
