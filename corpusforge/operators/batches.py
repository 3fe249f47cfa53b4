"""Batches, step plans, accumulation groups, learning-rate plans, epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.rules import WARMUP_SHARE


def _field(name: str):
    return lambda r: r[name]


def batch_assemble(df: DataFrame, pos_col: str, batch_size: int, features: Sequence[str], label: str | None,
                   group_by: Sequence[str] = ()) -> DataFrame:
    """B consecutive examples (by ``pos``) -> one row per batch with one list per
    feature and the label vector split off. A batch holds at most B rows."""
    bid = F.floor(F.col(pos_col) / batch_size).cast("bigint")
    cols = [pos_col, *features] + ([label] if label else [])
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    out = df.withColumn("batch_id", bid).groupBy(*group_by, "batch_id").agg(rows.alias("_rows"))
    sel = [*group_by, "batch_id", F.size("_rows").alias("n_rows")]
    sel += [F.transform("_rows", _field(f)).alias(f) for f in features]
    if label:
        sel.append(F.transform("_rows", lambda r: r[label]).alias(label))
    return out.select(*sel)


def batch_drop_last(batches: DataFrame, n_rows: Column | int, batch_size: int) -> DataFrame:
    """Drop the short last batch: keep batch_id < floor(n / B)."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return batches.where(F.col("batch_id") < F.floor(n / batch_size))


def step_plan(n: Column, batch_size: int, epochs: int, unit: str = "batch", accum: int = 1,
              warmup_share: float = WARMUP_SHARE, drop_last: bool = False) -> list[Column]:
    """Steps per epoch = ceil(n / B), or floor(n / B) when the short last batch
    is dropped (the streaming plan); ``unit='row'``: n, as the translation scripts
    do; total = epochs x that (/ accum when accumulation is counted);
    warm-up = int(share x total)."""
    if unit == "batch":
        per_epoch = F.floor(n / batch_size) if drop_last else F.ceil(n / batch_size)
    else:
        per_epoch = n
    per_epoch = F.ceil(per_epoch / accum) if accum > 1 else per_epoch
    total = (per_epoch * epochs).cast("bigint")
    warm = F.floor(total * F.lit(warmup_share)).cast("bigint")
    return [per_epoch.cast("bigint").alias("steps_per_epoch"), total.alias("total_steps"), warm.alias("warmup_steps")]


def accum_factor(effective_batch: int, chips: int, per_chip: int = 8) -> int:
    """Micro-batches per optimizer step; 0 is an error (too many chips)."""
    k = effective_batch // (chips * per_chip)
    if k <= 0:
        raise ValueError(f"accumulation factor is {k}: chips x batch exceeds the effective batch")
    return k


def accum_groups(batches: DataFrame, k: int, sums: Sequence[str] = ("n_rows",),
                 group_by: Sequence[str] = ()) -> DataFrame:
    """opt_step = floor(batch_id / k); sums per group. The last partial group is kept."""
    step = F.floor(F.col("batch_id") / k).cast("bigint")
    aggs = [F.count(F.lit(1)).alias("micro_batches")] + [F.sum(s).cast("bigint").alias(f"sum_{s}") for s in sums]
    return batches.withColumn("opt_step", step).groupBy(*group_by, "opt_step").agg(*aggs)


def lr_at(step, base_lr: float, warmup, total) -> Column:
    """Base * min(1, step/warm) * max(0, 1 - step/total); 0 at step 0."""
    s = F.col(step) if isinstance(step, str) else step
    w = F.lit(warmup) if isinstance(warmup, int) else warmup
    t = F.lit(total) if isinstance(total, int) else total
    w = F.when(w > 0, w).otherwise(F.raise_error(F.lit("warm-up steps must be positive")))
    return F.lit(base_lr) * F.least(F.lit(1.0), s / w) * F.greatest(F.lit(0.0), 1 - s / t)


def epoch_expand(df: DataFrame, epochs: int, name: str = "epoch") -> DataFrame:
    """The table once per epoch (0..E-1); order per epoch comes from D05."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
