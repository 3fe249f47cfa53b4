"""Exact seeded splits, shuffles and limits on top of the dense index.

Every seeded order is ``md5(key#seed)`` then ``key``; the dense index turns it
into positions without a single-task window, so split sizes are exact and
repeatable (``randomSplit`` gives neither).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.rules import SEED, TEST_SHARE
from corpusforge.functions.text import seeded_hash
from corpusforge.operators.index import dense_index, hash_bucket, range_index


def _key(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def hash_position(df: DataFrame, key, seed, name: str = "pos", total: str | None = None) -> DataFrame:
    """0..n-1 position in the seeded hash order (ties broken by the key)."""
    h = seeded_hash(key, seed)
    return dense_index(
        df.withColumn("_h", h), order=["_h", _key(key)], bucket=hash_bucket("_h"), name=name,
        total_name=total, bounded=True,
    ).drop("_h")


def split_exact_seeded(df: DataFrame, key, test_share: float = TEST_SHARE, seed=SEED,
                       out: str = "data_split", test_name: str = "test", train_name: str = "train") -> DataFrame:
    """Test <=> position < ceil(share * n) in the seeded order; exact, disjoint, complete."""
    p = hash_position(df, key, seed, name="_pos", total="_n")
    cut = F.ceil(F.lit(test_share) * F.col("_n"))
    return p.withColumn(out, F.when(F.col("_pos") < cut, test_name).otherwise(train_name)).drop("_pos", "_n")


def split_unseeded(df: DataFrame, key, test_share: float = TEST_SHARE, seed: int | None = None) -> DataFrame:
    """D01 with a seed drawn once and recorded in the output (``split_seed``)."""
    seed = random.SystemRandom().randrange(1 << 31) if seed is None else seed
    return split_exact_seeded(df, key, test_share, seed).withColumn("split_seed", F.lit(seed))


def split_head_percent(df: DataFrame, position: str | list[str], percent: float, out: str = "data_split") -> DataFrame:
    """First p % of rows by position -> validation, the rest -> train.

    Both sides share one cut = floor(p*n/100 + 0.5), so no row is lost or doubled.
    """
    p = range_index(df, order=[position] if isinstance(position, str) else position, name="_i", total_name="_n")
    cut = F.floor(F.lit(percent) * F.col("_n") / 100 + 0.5)
    return p.withColumn(out, F.when(F.col("_i") < cut, "validation").otherwise("train")).drop("_i", "_n")


def validation_from_head(df: DataFrame, split_col: str, position: str | list[str], percent: float) -> DataFrame:
    """D03 as the reference applies it: only when the table has no ``validation`` rows
    are the first p % of the train rows (by position) turned into validation. Rows of
    other splits, and of none, stay."""
    if not df.where(F.col(split_col) == "validation").isEmpty():
        return df
    train = df.where(F.col(split_col) == "train")
    carved = split_head_percent(train.drop(split_col), position, percent, out=split_col)
    return carved.unionByName(df.where(~F.col(split_col).eqNullSafe("train"))).select(*df.columns)


def head_split_capped(df: DataFrame, position: str | list[str], percent: float, max_train: int | None = None,
                      max_eval: int | None = None, out: str = "data_split") -> DataFrame:
    """D03 + D07: the head cut, then at most the first ``max_train`` and ``max_eval`` rows of each side, by position."""
    p = range_index(df, order=[position] if isinstance(position, str) else position, name="_i", total_name="_n")
    cut = F.floor(F.lit(percent) * F.col("_n") / 100 + 0.5)
    head = F.col("_i") < cut
    keep = (head & (F.col("_i") < (1 << 62 if max_eval is None else max_eval))) | (~head & (F.col("_i") - cut < (1 << 62 if max_train is None else max_train)))
    return p.where(keep).withColumn(out, F.when(head, "validation").otherwise("train")).drop("_i", "_n")


def shuffle_seeded(df: DataFrame, key, seed=SEED, name: str = "pos") -> DataFrame:
    """Seeded permutation; ``pos`` is the new order."""
    return hash_position(df, key, seed, name=name)


def shuffle_per_epoch(df: DataFrame, key, epoch_col: str = "epoch", seed=SEED, name: str = "pos",
                      shuffle: bool = True) -> DataFrame:
    """A new order every epoch (seed#epoch); ``shuffle=False`` keeps the key order."""
    if not shuffle:
        return range_index(df, order=[_key(key)], partition_by=[epoch_col], name=name)
    seeded = F.concat_ws("#", _key(key).cast("string"), F.lit(str(seed)), F.col(epoch_col).cast("string"))
    h = F.md5(seeded)
    return dense_index(
        df.withColumn("_h", h), order=["_h", _key(key)], bucket=hash_bucket("_h"), partition_by=[epoch_col],
        name=name,
    ).drop("_h")


def limit_head(df: DataFrame, position: str, n: int) -> DataFrame:
    """First min(n, N) rows by a dense position; N > n gives n."""
    return df.where(F.col(position) < n)


def limit_batches(df: DataFrame, batch_col: str, n: int) -> DataFrame:
    """Only the first N batches (counted in batches, not rows)."""
    return df.where(F.col(batch_col) < n)
