"""Dense 0..n-1 row index in a total order, without a global window.

Two ways. ``dense_index`` is for orders by hash, ``range_index`` for all others.

A global ``row_number()`` with no ``partitionBy`` moves every row into one
task. For a hash order the order is cut into buckets, the hash's first
digits:

1. count rows per bucket (map-side partial aggregation; the count table has
   one row per bucket, bounded by construction);
2. running sum over the small count table gives each bucket's offset;
3. ``row_number`` inside (bucket) plus the offset.

The result does not depend on partition layout, so it is stable under AQE
re-planning and task retries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 4  # 65,536 buckets: n/65,536 rows per ranking task; offsets table ~1-2 MB


def hash_bucket(hash_col: str | Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    c = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return F.substring(c, 1, digits)


def dense_index(
    df: DataFrame,
    order: Sequence[str | Column],
    bucket: Column,
    partition_by: Sequence[str] = (),
    name: str = "idx",
    total_name: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order`` (within ``partition_by``).

    ``bucket`` must be monotone in ``order``: sorting by (bucket, order) must
    equal sorting by order. ``total_name`` also adds the group's row count.
    ``bounded`` declares that the bucket rule has a fixed number of values
    (hash prefixes), which proves the offset table small enough to broadcast;
    otherwise AQE decides at run time from the measured size.
    """
    parts = list(partition_by)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).cast("bigint"))
    if total_name:
        offsets = offsets.withColumn(total_name, F.sum("_cnt").over(Window.partitionBy(*parts)).cast("bigint"))
    offsets = offsets.drop("_cnt").withColumnsRenamed({c: f"_o_{c}" for c in (*parts, "_bkt")})
    if bounded and not parts:
        # one row per bucket, at most 16**digits (65,536) rows: a proven bound
        offsets = F.broadcast(offsets)
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*parts, "_bkt")]  # null is a value like others
    joined = b.join(offsets, reduce(and_, same)).drop(*[f"_o_{c}" for c in (*parts, "_bkt")])
    inner = Window.partitionBy(*parts, "_bkt").orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(inner) - 1 + F.col("_off")).cast("bigint")).drop(
        "_bkt", "_off"
    )


def range_index(
    df: DataFrame,
    order: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "idx",
    total_name: str | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order`` (within ``partition_by``), for any total order.

    Rows are dealt out by range of (partition_by, order) and sorted where they
    are; the place in the partition is the row number that Spark gives there, and
    a table of one row per partition and group holds how many rows of the group
    lie in earlier partitions. So a group or a frequent first key is spread over
    as many partitions as it fills, and only that small table is ever summed up
    in order. Rows equal in all of ``order`` lie side by side, in any order.
    Nulls are values like others. The placed rows are written once (numbers
    must not change between their readers): pass keys, join wide columns later.
    """
    from corpusforge.operators.tokens import materialize

    parts = list(partition_by)
    by = [*parts, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialize(placed.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    heads = placed.groupBy(*parts, "_part").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*parts).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first"))
    if total_name:
        heads = heads.withColumn(total_name, F.sum("_cnt").over(Window.partitionBy(*parts)).cast("bigint"))
    heads = heads.drop("_cnt", "_first").withColumnsRenamed({c: f"_o_{c}" for c in (*parts, "_part")})
    if not parts:
        heads = F.broadcast(heads)  # one row per partition of the sort
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*parts, "_part")]
    out = placed.join(heads, reduce(and_, same)).withColumn(name, (F.col("_at") + F.col("_off")).cast("bigint"))
    return out.drop("_part", "_at", "_off", *[f"_o_{c}" for c in (*parts, "_part")])
