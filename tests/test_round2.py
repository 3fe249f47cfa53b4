"""Faults of the first round: dropped tokens, short zips, logs of steps never reached, shared folder on clusters."""

import pytest
from pyspark.sql import functions as F

from corpusforge import session
from corpusforge.functions import text as tx
from corpusforge.operators import metrics as mt
from corpusforge.operators import pairs as pr
from corpusforge.plans import views as v

SF = "/root/testdata/sf0.001"


def test_pieces_keep_every_token(spark):
    t = v.Tables(spark, SF)
    whole = t["documents"].select(F.sum(F.size(tx.tokens("text")))).first()[0]
    p = v.pieces(t)
    cut = p.select(F.sum(F.size(tx.tokens("text"))).alias("s"), F.max(F.size(tx.tokens("text"))).alias("m")).first()
    e = v.examples(t).select(F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x) - 2)).collect()[0][0]
    assert cut.s == whole == e and cut.m <= 510


def test_zip_rejects_unequal_tables(spark):
    five, two = spark.range(5).withColumnRenamed("id", "line_no"), spark.range(2).withColumnRenamed("id", "line_no")
    assert pr.zip_tables(five, five).count() == 5
    with pytest.raises(Exception, match="differ in length"):
        pr.zip_tables(five, two).collect()


def test_only_reached_steps_are_logged(spark):
    df = spark.range(1, 701).select(F.col("id").alias("step"), F.lit(1.0).alias("loss"))
    assert [tuple(r) for r in mt.metric_every_n(df, "step", "loss", 500).collect()] == [(500, 1.0, 500)]


def test_cluster_needs_a_checkpoint_folder():
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master, "spark.app.id": "a"}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_dir(Session("spark://somewhere:7077"))
    own = session.checkpoint_dir(Session("local[2]"))
    assert own and own == session.checkpoint_dir(Session("local[2]"))
