"""User functions on Arrow batches (the only Python in a plan).

Built-in operators never use these; they exist for user code that has no
Spark expression. Batches travel as Arrow record batches (``mapInPandas`` /
``applyInPandas``), never row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def map_batched(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """N rows -> n rows, one pandas batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = fn(b)
            if len(out) != len(b):
                raise ValueError("map_batched: the function must keep the row count")
            yield out

    return df.mapInPandas(run, schema)


def flat_map_batched(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """N rows -> m rows per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def map_stream_rows(stream: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The row generator of a stream: a stateless batch function on a streaming DataFrame."""
    return flat_map_batched(stream, fn, schema)


def collate_group(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                  schema: str) -> DataFrame:
    """A group of rows -> one value (a collated batch). Groups must be bounded,
    e.g. batches of B rows; never a whole table."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
