"""Registry entries: M01-M06 (re-aimed model operators)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusforge.functions.rules import SENTIMENT_LABELS
from corpusforge.operators import labels as lb
from corpusforge.operators import models as md
from corpusforge.operators import pairs as pr
from corpusforge.operators import sampling as sm
from corpusforge.plans import views as v
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import TOK, sq, with_views
from corpusforge.session import scratch_path

SPLIT_EX_SQL = [
    ("spl", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('#', doc_id::VARCHAR, '42')), doc_id) - 1
  < ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents"""),
    ("ex", f"SELECT e.doc_id, e.input_ids AS ids, s.split FROM examples e JOIN spl s ON s.doc_id = e.doc_id // {v.PIECE_KEY}"),
]


def split_examples(spark, sf):
    """Examples with their train/test split, materialized: both sides read them."""
    from corpusforge.operators.tokens import materialize

    t = v.Tables(spark, sf)
    sp = sm.split_exact_seeded(t["documents"].select("doc_id"), "doc_id", 0.05, 42, out="split")
    ex = v.examples(t).withColumn("_doc", F.floor(F.col("doc_id") / v.PIECE_KEY).cast("bigint"))
    sp = sp.withColumnRenamed("doc_id", "_doc")
    return materialize(ex.join(sp, "_doc").select("doc_id", F.col("input_ids").alias("ids"), "split"))


M03_SQL = with_views("""SELECT count(*) AS n_eval, sum(CASE WHEN pred = y THEN 1 ELSE 0 END)::BIGINT AS n_correct,
  round(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(p3)::BIGINT AS n_tri, sum(CASE WHEN p3 IS NULL AND p2 IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_bi
FROM (SELECT ev.y, b3.p3, b2.p2, coalesce(b3.p3, b2.p2, (SELECT m FROM uni)) AS pred
      FROM ev LEFT JOIN b3 ON b3.l = ev.l AND b3.r = ev.r LEFT JOIN b2 ON b2.l = ev.l)""",
    "examples", extra=SPLIT_EX_SQL + [
        ("tri", """SELECT ids[k - 1] AS l, ids[k] AS m, ids[k + 1] AS r
  FROM (SELECT ids, unnest(range(2, len(ids))) AS k FROM ex WHERE split = 'train') WHERE ids[k] <> 1"""),
        ("b3", """SELECT l, r, m AS p3 FROM (SELECT l, r, m, row_number() OVER (PARTITION BY l, r ORDER BY count(*) DESC, m) AS rn
  FROM tri GROUP BY l, r, m) WHERE rn = 1"""),
        ("b2", """SELECT l, m AS p2 FROM (SELECT l, m, row_number() OVER (PARTITION BY l ORDER BY count(*) DESC, m) AS rn
  FROM tri GROUP BY l, m) WHERE rn = 1"""),
        ("uni", "SELECT m FROM tri WHERE m >= 5 GROUP BY m ORDER BY count(*) DESC, m LIMIT 1"),
        ("ev", """SELECT doc_id, ids[k] AS y, ids[k - 1] AS l, ids[k + 1] AS r
  FROM (SELECT doc_id, ids, unnest(range(2, len(ids))) AS k FROM ex WHERE split = 'test')
  WHERE ids[k] >= 5 AND substr(md5(concat_ws('#', doc_id::VARCHAR, '0', '0', ((k - 1) // 4)::VARCHAR)), (k - 1) % 4 * 8 + 1, 8) < '26666666'"""),
    ])


@register("M03_fit_masked_token", M03_SQL)
def q_fit_masked_token(spark, sf):
    ex = split_examples(spark, sf)
    model = md.fit_masked_token(ex.where(F.col("split") == "train"), "ids")
    a = F.col("ids")
    test = ex.where(F.col("split") == "test").withColumn("_d", lb.mlm_draws("ids", "doc_id", F.lit(0), F.lit(0)))
    picked = F.filter(F.sequence(F.lit(1), F.size(a) - 2), lambda i: (F.get(a, i) >= 5) & (lb.draw_at("_d", i) < lb.PICK_BELOW))
    pos = F.transform(picked, lambda i: F.struct(F.get(a, i - 1).alias("l"), F.get(a, i).alias("y"), F.get(a, i + 1).alias("r")))
    test = test.select(F.explode(pos).alias("p")).groupBy("p.l", "p.r", "p.y").agg(F.count(F.lit(1)).alias("cnt"))
    p = md.predict_masked_token(model, test)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)).cast("bigint")
    right, total = n(F.col("pred") == F.col("y")), n(F.lit(True))
    return p.agg(
        total.alias("n_eval"), right.alias("n_correct"), F.round(F.try_divide(right.cast("double"), total.cast("double")), 6).alias("accuracy"),
        n(F.col("p3").isNotNull()).alias("n_tri"), n(F.col("p3").isNull() & F.col("p2").isNotNull()).alias("n_bi"),
    )


BI_SQL = [
    ("bi", """SELECT split, ids[k] AS a, ids[k + 1] AS b
  FROM (SELECT split, ids, unnest(range(1, len(ids))) AS k FROM ex) WHERE ids[k] <> 1 AND ids[k + 1] <> 1"""),
    ("cab", "SELECT a, b, count(*) AS c_ab FROM bi WHERE split = 'train' GROUP BY a, b"),
    ("ca", "SELECT a, count(*) AS c_a FROM bi WHERE split = 'train' GROUP BY a"),
]


@register("M04_fit_causal_lm", with_views("""SELECT count(*) AS n_tokens, round(avg(loss), 6) AS mean_loss,
  round(exp(avg(loss)), 6) AS perplexity FROM (
  SELECT -ln((coalesce(cab.c_ab, 0) + 1) / (coalesce(ca.c_a, 0) + (SELECT count(*) FROM vocab))) AS loss
  FROM bi t LEFT JOIN cab ON cab.a = t.a AND cab.b = t.b LEFT JOIN ca ON ca.a = t.a WHERE t.split = 'test')""",
    "examples", "vocab", extra=SPLIT_EX_SQL + BI_SQL))
def q_fit_causal_lm(spark, sf):
    ex = split_examples(spark, sf)
    model = md.fit_bigram_lm(ex.where(F.col("split") == "train"), "ids")
    vs = v.vocab(v.Tables(spark, sf)).select(F.count(F.lit(1))).scalar()
    loss = md.bigram_loss(model, ex.where(F.col("split") == "test"), vs, "ids")
    m = F.sum(F.col("cnt") * F.col("loss")) / F.sum("cnt")
    return loss.agg(F.sum("cnt").cast("bigint").alias("n_tokens"), F.round(m, 6).alias("mean_loss"),
                    F.round(F.exp(m), 6).alias("perplexity"))


@register("M06_phase2_merge", with_views("""SELECT a, b, sum(c)::BIGINT AS count FROM (
  SELECT a, b, count(*) AS c FROM bi WHERE split = 'train' GROUP BY a, b
  UNION ALL SELECT a, b, count(*) AS c FROM bi WHERE split = 'test' GROUP BY a, b) GROUP BY a, b""",
    "examples", extra=SPLIT_EX_SQL + BI_SQL[:1]))
def q_phase2_merge(spark, sf):
    """Phase 1 is counted and stored; phase 2 is counted later and merged into the stored table. Each merge is done again, as
    a run that failed after its write would, and changes nothing."""
    ex = split_examples(spark, sf)
    b = md.bigrams(ex, "ids", keep=["split"])
    store = md.CountStore(spark, scratch_path(spark, "counts"))
    for phase, split in (("phase1", "train"), ("phase2", "test"), ("phase1", "train"), ("phase2", "test")):
        store.merge(phase, b.where(F.col("split") == split).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")))
    return store.read()


@register("M05_lexicon_gloss", with_views(f"""SELECT f.doc_id, f.lang,
  coalesce(string_agg(coalesce(l.src_word, t.token), ' ' ORDER BY t.pos), '') AS glossed,
  count(t.pos)::BIGINT AS n_tokens, count(l.src_word)::BIGINT AS n_matched
  FROM texts f
  LEFT JOIN (SELECT doc_id, lang, unnest(tk) AS token, unnest(range(len(tk))) AS pos
             FROM (SELECT doc_id, lang, regexp_extract_all(text, {sq(TOK)}) AS tk FROM texts)) t ON t.doc_id = f.doc_id
  LEFT JOIN lexicon l ON l.lang = t.lang AND l.trg_word = t.token
  WHERE f.lang <> 'en' GROUP BY f.doc_id, f.lang""", "texts", "lexicon"))
def q_lexicon_gloss(spark, sf):
    t = v.Tables(spark, sf)
    docs = v.texts(t).where(F.col("lang") != v.LEXICON_PIVOT)
    return md.lexicon_gloss(docs, v.lexicon(t))


def sentiment_rows(spark, sf):
    s = pr.lookup_label_id(v.sent(v.Tables(spark, sf)), "label_text", SENTIMENT_LABELS)
    return md.text_features(s.select("doc_id", "split", "labels", "text"))


@register("M01_fit_text_classifier")
def q_fit_text_classifier(spark, sf):
    s = sentiment_rows(spark, sf)
    model = md.text_classifier().fit(s.where(F.col("split") == "train"))
    out = model.transform(s.where(F.col("split") != "train"))
    return out.select("doc_id", "split", "labels", F.col("prediction").cast("int").alias("prediction"))


def moment_rows(spark, moments, names, places):
    """(labels, feature, total) of fitted moments: counts as whole numbers, others rounded; totals of 0 stay out."""
    rows = [(c, n, round(float(x), places.get(n, 0)) + 0.0) for c, line in enumerate(moments) for n, x in zip(names, line)]
    return spark.createDataFrame([r for r in rows if r[2] != 0], "labels int, feature string, total double")


@register("M01_fit_certificate", with_views(f"""SELECT y.labels, t.feature, t.total FROM
  (SELECT y AS labels, 'rows' AS feature, count(*)::DOUBLE AS total FROM tr GROUP BY y
   UNION ALL
   SELECT w.y, w.b, count(*)::DOUBLE FROM tw w JOIN
     (SELECT b FROM tw GROUP BY b HAVING count(DISTINCT doc_id) < (SELECT count(*) FROM tr)) k ON k.b = w.b GROUP BY w.y, w.b) t
  JOIN (SELECT DISTINCT y AS labels FROM tr) y ON y.labels = t.labels""",
    "sent", extra=[
    ("tr", """SELECT doc_id, text, (CASE label_text WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END)::INTEGER AS y
  FROM sent WHERE split = 'train'"""),
    ("tw", f"""SELECT doc_id, y, substr(md5(w), 1, 4) AS b
  FROM (SELECT doc_id, y, unnest(regexp_extract_all(text, {sq(TOK)})) AS w FROM tr)""")]))
def q_fit_text_certificate(spark, sf):
    """At the fitted coefficients every class has its own rows and its own tokens per bucket (the loss's gradient is 0).

    Buckets found in every row have weight 0 and stay out, as the fit can't see them."""
    from corpusforge.operators.tokens import materialize

    train = materialize(sentiment_rows(spark, sf).where(F.col("split") == "train"))
    model = md.text_classifier().fit(train)
    idf = model.stages[1].idf.toArray()
    moments = md.fitted_moments(model.stages[-1], model.transform(train))
    seen = np.concatenate([[True], idf > 0])
    names = ["rows", *[f"{j:04x}" for j in np.flatnonzero(idf > 0)]]
    return moment_rows(spark, moments[:, seen] / np.concatenate([[1.0], idf])[seen], names, {})


@register("M02_pair_features", with_views(f"""SELECT doc_id, labels, overlap, jaccard, len_ratio FROM (
  SELECT doc_id, labels, len(list_intersect(a, b))::DOUBLE AS overlap,
    round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(a || b)), 0), 0.0), 6) AS jaccard,
    round(coalesce(nh::DOUBLE / nullif(np, 0), 0.0), 6) AS len_ratio
  FROM (SELECT doc_id, labels, list_distinct(regexp_extract_all(premise, {sq(TOK)})) AS a,
          list_distinct(regexp_extract_all(hypothesis, {sq(TOK)})) AS b,
          len(regexp_extract_all(premise, {sq(TOK)})) AS np, len(regexp_extract_all(hypothesis, {sq(TOK)})) AS nh
        FROM nli))""", "nli"))
def q_pair_features(spark, sf):
    f = md.pair_features(v.nli(v.Tables(spark, sf)))
    return f.select("doc_id", "labels", "overlap", F.round("jaccard", 6).alias("jaccard"),
                    F.round("len_ratio", 6).alias("len_ratio"))


PAIR_TOKENS = f"""coalesce(list_distinct(regexp_extract_all(premise, {sq(TOK)})), []) AS a,
  coalesce(list_distinct(regexp_extract_all(hypothesis, {sq(TOK)})), []) AS b"""
CROSSED = """list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: 'first#' || x)
  || list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: 'second#' || x)
  || list_transform(list_filter(a, lambda x: list_contains(b, x)), lambda x: 'both#' || x)"""


@register("M02_pair_buckets", with_views(f"""SELECT n.doc_id, n.labels, coalesce(k.buckets, '') AS buckets FROM nli n LEFT JOIN (
  SELECT doc_id, string_agg(k, ' ' ORDER BY k) AS buckets FROM (SELECT DISTINCT doc_id, substr(md5(w), 1, 3) AS k
    FROM (SELECT doc_id, unnest({CROSSED}) AS w FROM (SELECT doc_id, {PAIR_TOKENS} FROM nli))) GROUP BY doc_id) k ON k.doc_id = n.doc_id""", "nli"))
def q_pair_buckets(spark, sf):
    """Hashed texts of a pair: places of the sparse vector that hold 1."""
    f = md.pair_buckets(v.nli(v.Tables(spark, sf)))
    return f.select("doc_id", "labels", F.array_join("_buckets", " ").alias("buckets"))


def pair_rows(spark, sf):
    from corpusforge.operators.tokens import materialize

    n = v.nli(v.Tables(spark, sf))
    n = md.pair_words(sm.split_exact_seeded(n, "doc_id", 0.05, 42, out="split"))
    f = md.pair_buckets(md.pair_features(n))
    return materialize(f.select("doc_id", "labels", "split", *md.PAIR_NUMBERS, "_buckets"))


@register("M02_fit_pair_classifier")
def q_fit_pair_classifier(spark, sf):
    f = pair_rows(spark, sf)
    model = md.pair_classifier().fit(f.where(F.col("split") == "train"))
    out = model.transform(f.where(F.col("split") == "test"))
    return out.select("doc_id", "labels", F.col("prediction").cast("int").alias("prediction"))


@register("M02_fit_certificate", with_views(f"""SELECT labels, 'rows' AS feature, count(*)::DOUBLE AS total FROM tr GROUP BY labels
  UNION ALL SELECT labels, 'overlap', sum(len(list_intersect(a, b)))::DOUBLE FROM tr GROUP BY labels HAVING sum(len(list_intersect(a, b))) > 0
  UNION ALL SELECT labels, 'jaccard', round(sum(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(a || b)), 0), 0.0)), 2)
    FROM tr GROUP BY labels HAVING sum(len(list_intersect(a, b))) > 0
  UNION ALL SELECT labels, 'len_ratio', round(sum(coalesce(nh::DOUBLE / nullif(np, 0), 0.0)), 2) FROM tr GROUP BY labels HAVING sum(nh) > 0
  UNION ALL SELECT labels, k, count(DISTINCT doc_id)::DOUBLE FROM (
    SELECT doc_id, labels, substr(md5(w), 1, 3) AS k FROM (SELECT doc_id, labels, unnest({CROSSED}) AS w FROM tr)) GROUP BY labels, k""",
    "nli", extra=[
    ("spl", SPLIT_EX_SQL[0][1].replace("FROM documents", "FROM nli")),
    ("tr", f"""SELECT doc_id, labels, {PAIR_TOKENS},
  len(regexp_extract_all(premise, {sq(TOK)})) AS np, len(regexp_extract_all(hypothesis, {sq(TOK)})) AS nh
  FROM nli WHERE doc_id IN (SELECT doc_id FROM spl WHERE split = 'train')""")]))
def q_fit_pair_certificate(spark, sf):
    """At the fitted coefficients every class has its own rows, numbers and buckets (the loss's gradient is 0)."""
    train = pair_rows(spark, sf).where(F.col("split") == "train")
    model = md.pair_classifier().fit(train)
    moments = md.fitted_moments(model.stages[-1], model.transform(train))
    names = ["rows", *md.PAIR_NUMBERS, *[f"{j:03x}" for j in range(moments.shape[1] - 4)]]
    return moment_rows(spark, moments, names, {"jaccard": 2, "len_ratio": 2})
