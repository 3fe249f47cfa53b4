"""Predictions, loss, accuracy, perplexity and their roll-ups.

Scores are ``array<double>`` per example; token-level metrics use ``zip_with``
on the arrays (no explode, no shuffle) and aggregate with plain sums, so the
weighted mean over batches equals the mean over examples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.rules import IGNORE_INDEX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(scores) -> Column:
    """0-based index of the largest score; the first one on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def logsumexp(scores) -> Column:
    s = _c(scores)
    m = F.array_max(s)
    return m + F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def cross_entropy(scores, label) -> Column:
    """A02 (per example): -(s[y] - logsumexp(s)), shifted by the max against overflow."""
    s = _c(scores)
    return logsumexp(s) - F.element_at(s, _c(label) + 1)


def accuracy(pred, label) -> Column:
    """A03 (aggregate): share of correct predictions."""
    return F.avg((_c(pred) == _c(label)).cast("double"))


def masked_counts(preds, labels) -> tuple[Column, Column]:
    """A04 per row: (correct, total) over positions whose label is not -100."""
    p, y = _c(preds), _c(labels)
    valid = F.zip_with(p, y, lambda a, b: F.when(b != IGNORE_INDEX, F.when(a == b, 1).otherwise(0)))
    correct = F.aggregate(valid, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    total = F.aggregate(valid, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.isNull(), 0).otherwise(1))
    return correct, total


def masked_accuracy(correct_sum: Column, total_sum: Column) -> Column:
    """Correct / total, 0 when total is 0."""
    return F.coalesce(F.try_divide(correct_sum.cast("double"), total_sum.cast("double")), F.lit(0.0))


def shifted_counts(preds, labels) -> tuple[Column, Column]:
    """A05 per row: labels[1:] against preds[:-1]; every position counts."""
    p, y = _c(preds), _c(labels)
    n = F.size(y) - 1
    eq = F.zip_with(F.slice(p, 1, n), F.slice(y, 2, n), lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(eq, F.lit(0).cast("bigint"), lambda a, x: a + x), n.cast("bigint")


def perplexity(mean_loss) -> Column:
    """exp(mean loss); overflow gives Infinity, not an error."""
    return F.exp(_c(mean_loss))


def metric_rollup(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean per key set (batch-size weighted, as the loggers do)."""
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"),
        F.sum(weight).cast("bigint").alias("weight"),
    )


def metric_every_n(df: DataFrame, step: str, value: str, n: int, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per logged step (every n-th), holding the mean since the last log; a step not reached has no row."""
    bucket = F.ceil(F.col(step) / n) * n
    return (
        df.withColumn("log_step", bucket.cast("bigint"))
        .groupBy(*group_by, "log_step")
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_steps"), F.max(step).alias("_last"))
        .where("_last = log_step")
        .drop("_last")
    )


def topk_checkpoints(df: DataFrame, run: str, loss: str, step: str, k: int) -> DataFrame:
    """The k lowest validation losses per run, ties by the earlier step; ``is_best`` flags rank 1.

    A per-run window is fine here: a run has one row per evaluation, not per example.
    """
    w = Window.partitionBy(run).orderBy(F.col(loss).asc(), F.col(step).asc())
    r = df.withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= k).withColumn("is_best", F.col("rank") == 1)


def rows_per_subset(df: DataFrame, keys: Sequence[str] = ("data_source", "data_split")) -> DataFrame:
    """A10: row count per subset and split."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def sample_counts(n: Column, cap: int | None) -> Column:
    """min(cap, n); no cap gives n."""
    return n if cap is None else F.least(n, F.lit(cap))
