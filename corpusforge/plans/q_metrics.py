"""Registry entries: A01-A09, A11 (predictions, loss, accuracy, perplexity, roll-ups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import labels as lb
from corpusforge.operators import metrics as mt
from corpusforge.operators import sampling as sm
from corpusforge.plans import views as v
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import with_views

LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
LOSS_SQL = f"({LSE} - logits[label + 1])"


@register("A01_argmax_class", with_views(
    "SELECT doc_id, (list_position(logits, list_max(logits)) - 1)::INTEGER AS pred FROM preds", "preds"))
def q_argmax(spark, sf):
    p = v.preds(v.Tables(spark, sf))
    return p.select("doc_id", mt.argmax("logits").alias("pred"))


@register("A02_cross_entropy", with_views(f"SELECT doc_id, round({LOSS_SQL}, 6) AS loss FROM preds", "preds"))
def q_cross_entropy(spark, sf):
    p = v.preds(v.Tables(spark, sf))
    return p.select("doc_id", F.round(mt.cross_entropy("logits", "label"), 6).alias("loss"))


H42 = "md5(concat_ws('#', doc_id::VARCHAR, '42'))"


@register("A03_accuracy", with_views(f"""SELECT (pos // 8)::BIGINT AS batch_id, count(*) AS n,
  round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(loss), 6) AS mean_loss
  FROM (SELECT label, (list_position(logits, list_max(logits)) - 1) AS pred, {LOSS_SQL} AS loss,
        row_number() OVER (ORDER BY {H42}, doc_id) - 1 AS pos FROM preds) GROUP BY 1""", "preds"))
def q_accuracy(spark, sf):
    p = v.preds(v.Tables(spark, sf))
    p = sm.shuffle_seeded(p, "doc_id", 42).withColumn("batch_id", F.floor(F.col("pos") / 8).cast("bigint"))
    p = p.withColumn("pred", mt.argmax("logits")).withColumn("loss", mt.cross_entropy("logits", "label"))
    return p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(mt.accuracy("pred", "label"), 6).alias("accuracy"),
                                     F.round(F.avg("loss"), 6).alias("mean_loss"))


TOKPRED_SQL = ("tokpred", """SELECT doc_id, input_ids,
  list_transform(input_ids, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END) AS labels
  FROM examples""")
PRED_EXPR = ("list_transform(labels, lambda y, i: CASE WHEN y = -100 THEN -100 WHEN substr(md5(concat_ws('#', doc_id::VARCHAR, "
             "(i - 1)::VARCHAR)), 1, 1) < 'a' THEN y ELSE y + 1 END)")


def token_examples(spark, sf):
    e = v.examples(v.Tables(spark, sf))
    e = e.withColumn("labels", lb.labels_copy("input_ids", ignore_pad=True))
    return e.withColumn("preds", v.token_preds(e))


@register("A04_accuracy_masked", with_views(f"""SELECT doc_id, correct, total,
  round(coalesce(correct / nullif(total, 0), 0.0), 6) AS accuracy FROM (
  SELECT doc_id,
    len(list_filter(list_zip({PRED_EXPR}, labels), lambda z: z[2] <> -100 AND z[1] = z[2]))::BIGINT AS correct,
    len(list_filter(labels, lambda y: y <> -100))::BIGINT AS total FROM tokpred)""",
    "examples", extra=[TOKPRED_SQL]))
def q_accuracy_masked(spark, sf):
    e = token_examples(spark, sf)
    c, t = mt.masked_counts("preds", "labels")
    e = e.select("doc_id", c.alias("correct"), t.alias("total"))
    return e.withColumn("accuracy", F.round(mt.masked_accuracy(F.col("correct"), F.col("total")), 6))


@register("A05_accuracy_shifted", with_views(f"""SELECT doc_id,
  len(list_filter(list_zip(list_slice(p, 1, len(input_ids) - 1), list_slice(input_ids, 2, len(input_ids))),
      lambda z: z[1] = z[2]))::BIGINT AS correct, (len(input_ids) - 1)::BIGINT AS total
  FROM (SELECT doc_id, input_ids, {PRED_EXPR} AS p FROM tokpred)""", "examples", extra=[TOKPRED_SQL]))
def q_accuracy_shifted(spark, sf):
    e = token_examples(spark, sf)
    c, t = mt.shifted_counts("preds", "input_ids")
    return e.select("doc_id", c.alias("correct"), t.alias("total"))


@register("A06_perplexity", with_views(f"""SELECT label, round(avg(loss), 6) AS mean_loss,
  round(exp(avg(loss)), 6) AS perplexity FROM (SELECT label, {LOSS_SQL} AS loss FROM preds) GROUP BY label""", "preds"))
def q_perplexity(spark, sf):
    p = v.preds(v.Tables(spark, sf)).withColumn("loss", mt.cross_entropy("logits", "label"))
    g = p.groupBy("label").agg(F.avg("loss").alias("m"))
    return g.select("label", F.round("m", 6).alias("mean_loss"), F.round(mt.perplexity("m"), 6).alias("perplexity"))


@register("A07_metric_rollup", with_views("""SELECT run, epoch,
  round(sum(val_loss * batch_rows) / sum(batch_rows), 6) AS value, sum(batch_rows)::BIGINT AS weight
  FROM runs GROUP BY run, epoch""", "runs"))
def q_metric_rollup(spark, sf):
    r = mt.metric_rollup(v.runs(v.Tables(spark, sf)), ["run", "epoch"], "val_loss", "batch_rows")
    return r.withColumn("value", F.round("value", 6))


@register("A08_metric_every_n", with_views("""SELECT run, (ceil(step / 10) * 10)::BIGINT AS log_step,
  round(avg(val_loss), 6) AS mean_value, count(*) AS n_steps FROM runs GROUP BY 1, 2
  HAVING max(step) = (ceil(step / 10) * 10)::BIGINT""", "runs"))
def q_metric_every_n(spark, sf):
    r = mt.metric_every_n(v.runs(v.Tables(spark, sf)), "step", "val_loss", 10, ["run"])
    return r.withColumn("mean_value", F.round("mean_value", 6))


@register("A09_topk_checkpoints", with_views("""SELECT run, step, round(val_loss, 6) AS val_loss, rank, rank = 1 AS is_best
  FROM (SELECT run, step, val_loss, row_number() OVER (PARTITION BY run ORDER BY val_loss, step)::INTEGER AS rank
        FROM runs) WHERE rank <= 4""", "runs"))
def q_topk_checkpoints(spark, sf):
    r = mt.topk_checkpoints(v.runs(v.Tables(spark, sf)), "run", "val_loss", "step", 4)
    return r.select("run", "step", F.round("val_loss", 6).alias("val_loss"), "rank", "is_best")


@register("A11_sample_counts", with_views("""SELECT data_split, count(*) AS n, least(count(*), 100) AS n_capped
  FROM pairs GROUP BY data_split""", "pairs"))
def q_sample_counts(spark, sf):
    p = v.pairs(v.Tables(spark, sf)).groupBy("data_split").agg(F.count(F.lit(1)).alias("n"))
    return p.select("data_split", "n", mt.sample_counts(F.col("n"), 100).alias("n_capped"))
