"""Registry entries: D01-D08 splits, shuffles and limits; B01-B06 batches and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions.rules import SENTIMENT_LABELS
from corpusforge.operators import batches as bt
from corpusforge.operators import pairs as pr
from corpusforge.operators import sampling as sm
from corpusforge.plans import views as v
from corpusforge.plans.q_core import arr_str
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import with_views

H = "md5(concat_ws('#', {k}::VARCHAR, '42'))"


@register("D01_split_exact_seeded", f"""SELECT doc_id,
  CASE WHEN row_number() OVER (ORDER BY {H.format(k='doc_id')}, doc_id) - 1 < ceil(0.05 * count(*) OVER ())
  THEN 'test' ELSE 'train' END AS data_split FROM documents""")
def q_split_exact(spark, sf):
    d = v.Tables(spark, sf)["documents"].select("doc_id")
    return sm.split_exact_seeded(d, "doc_id", 0.05, 42)


@register("D02_split_unseeded", """SELECT doc_id, count(*) AS n_places, 1::BIGINT AS n_splits,
  (SELECT ceil(0.05 * count(*))::BIGINT FROM documents) AS n_test, 1::BIGINT AS n_seeds FROM documents GROUP BY doc_id""")
def q_split_unseeded(spark, sf):
    """Which rows fall where differs from run to run; that each falls into one split, the sizes and the one recorded seed do not."""
    d = v.Tables(spark, sf)["documents"].select("doc_id")
    s = sm.split_unseeded(d, "doc_id", 0.05)
    places = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("data_split").alias("n_splits"))
    sizes = s.agg(F.count_if(F.col("data_split") == "test").alias("n_test"), F.countDistinct("split_seed").alias("n_seeds"))
    return places.join(F.broadcast(sizes))


@register("D03_split_head_percent", """SELECT doc_id,
  CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(5 * count(*) OVER () / 100 + 0.5)
  THEN 'validation' ELSE 'train' END AS data_split FROM documents""")
def q_split_head(spark, sf):
    # the documents table has no validation split, so the head 5 % of train becomes one
    d = v.Tables(spark, sf)["documents"].select("doc_id", F.lit("train").alias("data_split"))
    return sm.validation_from_head(d, "data_split", "doc_id", 5)


@register("D04_shuffle_seeded", with_views(
    f"SELECT pair_id, (row_number() OVER (ORDER BY {H.format(k='pair_id')}, pair_id) - 1)::BIGINT AS pos FROM pairs",
    "pairs"))
def q_shuffle_seeded(spark, sf):
    p = v.pairs(v.Tables(spark, sf)).select("pair_id")
    return sm.shuffle_seeded(p, "pair_id", 42)


EPOCH_H = "md5(concat_ws('#', doc_id::VARCHAR, '42', epoch::VARCHAR))"


@register("D05_shuffle_per_epoch", with_views(
    f"""SELECT doc_id, epoch::INTEGER AS epoch,
  (row_number() OVER (PARTITION BY epoch ORDER BY {EPOCH_H}, doc_id) - 1)::BIGINT AS pos
  FROM sent, range(3) AS r(epoch)""", "sent"))
def q_shuffle_per_epoch(spark, sf):
    s = bt.epoch_expand(v.sent(v.Tables(spark, sf)).select("doc_id"), 3).withColumn("epoch", F.col("epoch").cast("int"))
    return sm.shuffle_per_epoch(s, "doc_id", "epoch", 42)


SHUF_SENT = ("shuf", f"""SELECT doc_id, text, label_text,
  (CASE label_text WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END)::INTEGER AS labels,
  (row_number() OVER (ORDER BY {H.format(k='doc_id')}, doc_id) - 1)::BIGINT AS pos FROM sent""")


def shuffled_sent(spark, sf):
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "text", "label_text")
    s = pr.lookup_label_id(s, "label_text", SENTIMENT_LABELS)
    return sm.shuffle_seeded(s, "doc_id", 42)


@register("D07_limit_head", with_views("SELECT doc_id, pos FROM shuf WHERE pos < 100", "sent", extra=[SHUF_SENT]))
def q_limit_head(spark, sf):
    return sm.limit_head(shuffled_sent(spark, sf), "pos", 100).select("doc_id", "pos")


@register("D08_limit_batches", with_views(
    "SELECT doc_id, (pos // 8)::BIGINT AS batch_id FROM shuf WHERE pos // 8 < 20", "sent", extra=[SHUF_SENT]))
def q_limit_batches(spark, sf):
    s = shuffled_sent(spark, sf).withColumn("batch_id", F.floor(F.col("pos") / 8).cast("bigint"))
    return sm.limit_batches(s, "batch_id", 20).select("doc_id", "batch_id")


# --- B: batches and plans -------------------------------------------------------------

BATCH_SQL = ("bat", """SELECT (pos // 8)::BIGINT AS batch_id, count(*) AS n_rows,
  array_to_string(list(doc_id ORDER BY pos), ' ') AS doc_id, array_to_string(list(labels ORDER BY pos), ' ') AS labels
  FROM shuf GROUP BY 1""")


def batches(spark, sf):
    b = bt.batch_assemble(shuffled_sent(spark, sf), "pos", 8, ["doc_id"], "labels")
    return b.select("batch_id", F.col("n_rows").cast("bigint"), arr_str("doc_id").alias("doc_id"),
                    arr_str("labels").alias("labels"))


@register("B01_batch_assemble", with_views("SELECT * FROM bat", "sent", extra=[SHUF_SENT, BATCH_SQL]))
def q_batch_assemble(spark, sf):
    return batches(spark, sf)


@register("B02_batch_drop_last", with_views(
    "SELECT * FROM bat WHERE batch_id < (SELECT count(*) FROM sent) // 8", "sent", extra=[SHUF_SENT, BATCH_SQL]))
def q_batch_drop_last(spark, sf):
    n = v.sent(v.Tables(spark, sf)).select(F.count(F.lit(1))).scalar()
    return bt.batch_drop_last(batches(spark, sf), n, 8)


@register("B03_step_plan", with_views("""SELECT split, n,
  ceil(n / 128)::BIGINT AS steps_per_epoch, (3 * ceil(n / 128))::BIGINT AS total_steps,
  floor(3 * ceil(n / 128) * 0.1)::BIGINT AS warmup_steps,
  (3 * n)::BIGINT AS total_steps_rows, floor(3 * n * 0.1)::BIGINT AS warmup_steps_rows,
  (3 * ceil(ceil(n / 128) / 32))::BIGINT AS total_steps_accum
  FROM (SELECT split, count(*) AS n FROM sent GROUP BY split)""", "sent"))
def q_step_plan(spark, sf):
    s = v.sent(v.Tables(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    by_batch = bt.step_plan(F.col("n"), 128, 3)
    by_row = bt.step_plan(F.col("n"), 128, 3, unit="row")
    accum = bt.step_plan(F.col("n"), 128, 3, accum=32)
    return s.select(
        "split", "n", *by_batch,
        by_row[1].alias("total_steps_rows"), by_row[2].alias("warmup_steps_rows"),
        accum[1].alias("total_steps_accum"),
    )


ACCUM_SQL = ("acc", """SELECT (batch_id // 8)::BIGINT AS opt_step, count(*) AS micro_batches,
  sum(n_rows)::BIGINT AS sum_n_rows FROM bat GROUP BY 1""")


def accum(spark, sf):
    b = bt.batch_assemble(shuffled_sent(spark, sf), "pos", 8, ["doc_id"], None)
    return bt.accum_groups(b, bt.accum_factor(2048, 32), ["n_rows"])


@register("B04_accum_groups", with_views("SELECT * FROM acc", "sent", extra=[SHUF_SENT, BATCH_SQL, ACCUM_SQL]))
def q_accum_groups(spark, sf):
    return accum(spark, sf)


@register("B05_lr_schedule", with_views("""SELECT epoch, batch_id, step,
  round(2e-5 * least(1.0, step / w) * greatest(0.0, 1 - step / t), 12) AS lr
  FROM (SELECT epoch::INTEGER AS epoch, batch_id, (epoch * nb + batch_id)::BIGINT AS step, t, w
        FROM bat, range(3) AS r(epoch),
        (SELECT count(*) AS nb, 3 * count(*)::DOUBLE AS t, floor(0.3 * count(*))::DOUBLE AS w FROM bat) s)""",
    "sent", extra=[SHUF_SENT, BATCH_SQL]))
def q_lr_schedule(spark, sf):
    from corpusforge.operators.tokens import materialize

    one = materialize(batches(spark, sf).select("batch_id"))  # read by the rows and by the count
    b = bt.epoch_expand(one, 3).withColumn("epoch", F.col("epoch").cast("int"))
    nb = one.select(F.count(F.lit(1))).scalar()
    b = b.withColumn("step", (F.col("epoch") * nb + F.col("batch_id")).cast("bigint"))
    t = (nb * 3).cast("double")
    w = F.floor(t * 0.1).cast("double")
    return b.select("epoch", "batch_id", "step", F.round(bt.lr_at("step", 2e-5, w, t), 12).alias("lr"))


@register("B06_epoch_expand", with_views(
    "SELECT doc_id, epoch::INTEGER AS epoch FROM sent, range(3) AS r(epoch)", "sent"))
def q_epoch_expand(spark, sf):
    s = v.sent(v.Tables(spark, sf)).select("doc_id")
    return bt.epoch_expand(s, 3).withColumn("epoch", F.col("epoch").cast("int"))
