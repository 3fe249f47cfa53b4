"""Query registry: one key per operator of the inventory.

Each entry holds the Spark plan builder ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express it, an independent DuckDB query over the same parquet
tables. Arrays are rendered as strings and doubles rounded to 6 places in
both, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate key {key}")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the catalog modules fills REGISTRY
    from corpusforge.plans import (  # noqa: F401
        q_core,
        q_metrics,
        q_models,
        q_sampling,
        q_sources,
        q_streaming,
        q_text,
    )

    return REGISTRY
