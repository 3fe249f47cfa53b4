"""D00-D07 properties: exact, disjoint, complete, repeatable; shuffles keep the multiset."""

import math

from pyspark.sql import functions as F

from corpusforge.operators import sampling as sm
from corpusforge.operators.index import dense_index, hash_bucket, range_index


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_dense_index_is_a_permutation(spark):
    d = sm.hash_position(ids(spark, 5000), "k", 42, name="i")
    got = sorted(r.i for r in d.collect())
    assert got == list(range(5000))


def test_dense_index_positional_matches_order(spark):
    d = range_index(ids(spark, 3000), order=["k"], name="i")
    assert all(r.i == r.k for r in d.collect())


def test_dense_index_per_group(spark):
    d = ids(spark, 1000).withColumn("g", F.col("k") % 3)
    out = range_index(d, order=["k"], partition_by=["g"], name="i", total_name="n")
    for g in range(3):
        rows = sorted((r.k, r.i, r.n) for r in out.where(F.col("g") == g).collect())
        assert [i for _, i, _ in rows] == list(range(len(rows)))
        assert all(n == len(rows) for _, _, n in rows)


def test_index_keeps_null_keys(spark):
    rows = [(1, None, "b"), (2, "x", "a"), (None, "x", "c"), (None, None, "d"), (2, "y", "e")]
    df = spark.createDataFrame(rows, "k long, g string, t string")
    out = range_index(df, order=["k", "t"], name="i", total_name="n").collect()
    assert [r.t for r in sorted(out, key=lambda r: r.i)] == ["c", "d", "b", "a", "e"] and {r.n for r in out} == {5}
    per = {(r.g, r.t): (r.i, r.n) for r in range_index(df, order=["k", "t"], partition_by=["g"], name="i", total_name="n").collect()}
    assert per == {(None, "d"): (0, 2), (None, "b"): (1, 2), ("x", "c"): (0, 2), ("x", "a"): (1, 2), ("y", "e"): (0, 1)}
    hashed = dense_index(df.withColumn("h", F.md5("t")), order=["h"], bucket=F.when(F.col("k").isNotNull(), hash_bucket("h")), partition_by=["g"], name="i")
    assert hashed.count() == 5


def test_range_index_spreads_a_hot_first_key(spark):
    """A key with nine rows in ten is numbered by several partitions, and only their counts are summed in order."""
    n = 60_000
    df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.repartitionByRange("k", "t").withColumn("p", F.spark_partition_id())
        most = placed.groupBy("p").count().agg(F.max("count")).first()[0]
        assert most < n / 4
        out = range_index(df, order=["k", "t"], name="i")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "row_number" not in plan
        got = out.orderBy("k", "t").select("i").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r.i for r in got] == list(range(n))


def test_split_exact_sizes_and_repeatable(spark):
    n = 1999
    a = sm.split_exact_seeded(ids(spark, n), "k", 0.05, 42)
    test = {r.k for r in a.where(F.col("data_split") == "test").collect()}
    train = {r.k for r in a.where(F.col("data_split") == "train").collect()}
    assert len(test) == math.ceil(0.05 * n)
    assert not test & train and len(test | train) == n
    b = sm.split_exact_seeded(ids(spark, n), "k", 0.05, 42)
    assert test == {r.k for r in b.where(F.col("data_split") == "test").collect()}
    c = sm.split_exact_seeded(ids(spark, n), "k", 0.05, 7)
    assert test != {r.k for r in c.where(F.col("data_split") == "test").collect()}


def test_unseeded_split_records_its_seed(spark):
    a = sm.split_unseeded(ids(spark, 100), "k")
    seeds = {r.split_seed for r in a.select("split_seed").distinct().collect()}
    assert len(seeds) == 1


def test_head_percent_shares_one_cut(spark):
    a = sm.split_head_percent(ids(spark, 101), "k", 5)
    val = sorted(r.k for r in a.where(F.col("data_split") == "validation").collect())
    assert val == list(range(5))  # floor(5.05 + 0.5) = 5, contiguous from the start
    assert a.count() == 101


def test_shuffle_keeps_rows_and_changes_order(spark):
    s = sm.shuffle_seeded(ids(spark, 500), "k", 42).collect()
    assert sorted(r.k for r in s) == list(range(500))
    assert sorted(r.pos for r in s) == list(range(500))
    assert [r.k for r in sorted(s, key=lambda r: r.pos)] != list(range(500))


def test_per_epoch_orders_differ(spark):
    from corpusforge.operators.batches import epoch_expand

    e = sm.shuffle_per_epoch(epoch_expand(ids(spark, 200), 2), "k", "epoch", 42).collect()
    o0 = [r.k for r in sorted((r for r in e if r.epoch == 0), key=lambda r: r.pos)]
    o1 = [r.k for r in sorted((r for r in e if r.epoch == 1), key=lambda r: r.pos)]
    assert sorted(o0) == sorted(o1) == list(range(200)) and o0 != o1


def test_limit_head_beyond_size(spark):
    s = sm.shuffle_seeded(ids(spark, 10), "k", 42)
    assert sm.limit_head(s, "pos", 100).count() == 10


def test_no_single_partition_window_on_rows(spark):
    """The only unpartitioned window is over the bucket-count table, never over the rows."""
    d = sm.hash_position(ids(spark, 100), "k", 42)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "row_number()" in plan
    assert "windowspecdefinition(_bkt" in plan.replace(" ", "")


def test_validation_from_head_only_when_missing(spark):
    d = ids(spark, 40).withColumn("data_split", F.lit("train"))
    a = sm.validation_from_head(d, "data_split", "k", 10)
    assert sorted(r.k for r in a.where(F.col("data_split") == "validation").collect()) == [0, 1, 2, 3]
    b = d.withColumn("data_split", F.when(F.col("k") >= 38, "validation").otherwise("train"))
    out = sm.validation_from_head(b, "data_split", "k", 10)
    assert sorted(r.k for r in out.where(F.col("data_split") == "validation").collect()) == [38, 39]
    assert out.count() == 40


def test_streaming_step_plan_matches_reference_numbers(spark):
    from corpusforge.operators.batches import step_plan

    df = spark.createDataFrame([(194157658,)], "n long")
    r = df.select(*step_plan(F.col("n"), 2048, 1, drop_last=True)).first()
    assert (r.steps_per_epoch, r.total_steps, r.warmup_steps) == (94803, 94803, 9480)


def test_drop_same_name(spark):
    from corpusforge.operators.pairs import lang_table, lookup_lang_name

    d = spark.createDataFrame([("en", "de"), ("en", "fr")], "source_lang string, target_lang string")
    lm = lang_table(spark, {"de": "west_germanic", "en": "west_germanic", "fr": "north_french"})
    assert lookup_lang_name(d, lm).count() == 2
    assert lookup_lang_name(d, lm, drop_same_name=True).count() == 1
