"""Registry entries: chunking, dense index, projections, filters, lookups, reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.functions.rules import NLI_LABELS, SENTIMENT_LABELS, SOURCE_LEXICON
from corpusforge.operators import chunk as ch
from corpusforge.operators import pairs as pr
from corpusforge.operators.sampling import hash_position
from corpusforge.plans import views as v
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import SENT, TOK, sq, with_views

PAIR6 = ["source_lang", "target_lang", "source_text", "target_text", "data_split", "data_source"]
PAIR6_SQL = ", ".join(PAIR6)


def arr_str(c):
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), " ")


# --- chunking (T04, T09-T13) -------------------------------------------------------

CHUNK_SQL_CTES = [
    ("cd", f"SELECT doc_id, lang, text, len(regexp_extract_all(text, {sq(TOK)})) + 2 AS n_doc FROM documents"),
    ("cl", f"""SELECT doc_id, lang, sents, list_transform(sents, lambda x: len(regexp_extract_all(x, {sq(TOK)}))) AS lens
  FROM (SELECT doc_id, lang, regexp_extract_all(text, {sq(SENT)}) AS sents FROM cd WHERE n_doc > 512)"""),
    ("cs", """SELECT *, list_reduce(lens, lambda acc, x, i: CASE WHEN acc.cur + x > 512 AND acc.cur > 0
    THEN {'cur': x::BIGINT, 'starts': list_append(acc.starts, i)} ELSE {'cur': acc.cur + x, 'starts': acc.starts} END,
    {'cur': 0::BIGINT, 'starts': [1]}).starts AS starts FROM cl WHERE len(lens) > 0"""),
    ("cb", """SELECT *, coalesce(list_max(list_filter(range(1, starts[-1] + 1),
    lambda i: list_sum(list_slice(lens, i, len(lens))) >= 256)), 1) AS last_start FROM cs"""),
    ("cj", "SELECT *, unnest(generate_series(1, len(starts))) AS j FROM cb"),
    ("ce", """SELECT doc_id, lang, sents, lens, j,
    CASE WHEN j = len(starts) THEN last_start ELSE starts[j] END AS cs,
    CASE WHEN j = len(starts) THEN len(lens) ELSE starts[j + 1] - 1 END AS ce FROM cj"""),
    ("chunks", """SELECT doc_id, lang, (j - 1)::INTEGER AS chunk_no, array_to_string(list_slice(sents, cs, ce), ' ') AS text,
    list_sum(list_slice(lens, cs, ce))::BIGINT AS n_tokens, (ce - cs + 1)::INTEGER AS n_sentences FROM ce
  UNION ALL SELECT doc_id, lang, 0, text, (n_doc - 2)::BIGINT, 1 FROM cd WHERE n_doc <= 512"""),
]


def chunks(spark, sf):
    t = v.Tables(spark, sf)
    return ch.chunk_documents(t["documents"], keep=("doc_id", "lang"))


def entry_summary(spark, sf):
    return ch.chunk_summary(chunks(spark, sf))


ENTRY_SQL = with_views(
    """SELECT lang, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS sum_tokens,
  sum(CASE WHEN chunk_no = 0 THEN 1 ELSE 0 END)::BIGINT AS n_docs, max(n_tokens)::BIGINT AS max_tokens
FROM chunks GROUP BY lang""", extra=CHUNK_SQL_CTES)


@register("T13_chunk_explode", with_views(
    "SELECT doc_id, lang, chunk_no, text, n_tokens, n_sentences FROM chunks", extra=CHUNK_SQL_CTES))
def q_chunk_explode(spark, sf):
    return chunks(spark, sf)


@register("T04_tok_count", f"""SELECT doc_id, (len(regexp_extract_all(text, {sq(TOK)})) + 2)::BIGINT AS n_tokens,
  len(regexp_extract_all(text, {sq(TOK)})) + 2 > 512 AS needs_split FROM documents""")
def q_tok_count(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    n = tx.token_count("text", specials=2).cast("bigint")
    return d.select("doc_id", n.alias("n_tokens"), (n > 512).alias("needs_split"))


@register("T09_sent_split", f"""SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_no, unnest(s) AS sentence,
  len(regexp_extract_all(unnest(s), {sq(TOK)}))::BIGINT AS n_tokens
  FROM (SELECT doc_id, regexp_extract_all(text, {sq(SENT)}) AS s FROM documents)""")
def q_sent_split(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    e = d.select("doc_id", F.posexplode(tx.sentences("text")).alias("sent_no", "sentence"))
    return e.select("doc_id", F.col("sent_no").cast("bigint"), "sentence",
                    F.size(tx.tokens("sentence")).cast("bigint").alias("n_tokens"))


@register("T10_chunk_passthrough", f"""SELECT doc_id, text FROM documents
  WHERE len(regexp_extract_all(text, {sq(TOK)})) + 2 <= 512""")
def q_chunk_passthrough(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    return d.where(tx.token_count("text", specials=2) <= 512).select("doc_id", "text")


@register("T11_chunk_greedy_pack", with_views(
    "SELECT doc_id, len(lens)::BIGINT AS n_sentences, array_to_string(starts, ' ') AS chunk_starts FROM cs",
    extra=CHUNK_SQL_CTES[:3]))
def q_chunk_greedy_pack(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    p = d.where(tx.token_count("text", specials=2) > 512).select(
        "doc_id", F.transform(tx.sentences("text"), lambda s: F.size(tx.tokens(s))).alias("lens"))
    p = p.where(F.size("lens") > 0)
    return p.select("doc_id", F.size("lens").cast("bigint").alias("n_sentences"),
                    arr_str(ch.chunk_starts(F.col("lens"), 512)).alias("chunk_starts"))


@register("T12_chunk_tail_backfill", with_views(
    """SELECT doc_id, starts[-1]::BIGINT AS tail_start, last_start::BIGINT AS filled_start,
  list_sum(list_slice(lens, starts[-1], len(lens)))::BIGINT AS tail_tokens,
  list_sum(list_slice(lens, last_start, len(lens)))::BIGINT AS filled_tokens FROM cb""",
    extra=CHUNK_SQL_CTES[:4]))
def q_chunk_tail_backfill(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    p = d.where(tx.token_count("text", specials=2) > 512).select(
        "doc_id", F.transform(tx.sentences("text"), lambda s: F.size(tx.tokens(s))).alias("lens"))
    p = p.where(F.size("lens") > 0).withColumn("starts", ch.chunk_starts(F.col("lens"), 512))
    last = F.element_at("starts", -1)
    p = p.withColumn("tail_start", last).withColumn("filled_start", ch.backfill_start(F.col("lens"), last, 256))
    tail_sum = lambda s: F.aggregate(F.slice("lens", s, F.size("lens")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("doc_id", F.col("tail_start").cast("bigint"), F.col("filled_start").cast("bigint"),
                    tail_sum(F.col("tail_start")).alias("tail_tokens"),
                    tail_sum(F.col("filled_start")).alias("filled_tokens"))


# --- D00 dense index -------------------------------------------------------------

@register("D00_dense_index", """SELECT doc_id,
  (row_number() OVER (ORDER BY md5(concat_ws('#', doc_id::VARCHAR, '42')), doc_id) - 1)::BIGINT AS idx FROM documents""")
def q_dense_index(spark, sf):
    d = v.Tables(spark, sf)["documents"].select("doc_id")
    return hash_position(d, "doc_id", 42, name="idx")


# --- P: projections and filters ---------------------------------------------------

@register("P01_proj_select", with_views(
    "SELECT source_lang, target_lang, source_text, target_text FROM pairs", "pairs"))
def q_proj_select(spark, sf):
    return pr.select_columns(v.pairs(v.Tables(spark, sf)), ["source_lang", "target_lang", "source_text", "target_text"])


@register("P02_proj_drop", with_views(f"SELECT {PAIR6_SQL} FROM pairs", "pairs"))
def q_proj_drop(spark, sf):
    return pr.drop_columns(v.pairs(v.Tables(spark, sf)), ["pair_id", "src", "row_id"])


@register("P03_proj_rename", with_views("SELECT src, row_id, en AS source_text, fr AS target_text FROM wide", "wide"))
def q_proj_rename(spark, sf):
    w = v.wide(v.Tables(spark, sf)).select("src", "row_id", "en", "fr")
    return pr.rename_pair(w, "en", "fr")


@register("P04_proj_constant", with_views(
    f"""SELECT src_word AS source_text, trg_word AS target_text, 'en' AS source_lang, lang AS target_lang,
  '{SOURCE_LEXICON}' AS data_source, 'train' AS data_split FROM lexicon""", "lexicon"))
def q_proj_constant(spark, sf):
    lx = v.lexicon(v.Tables(spark, sf))
    out = lx.select(F.col("src_word").alias("source_text"), F.col("trg_word").alias("target_text"),
                    F.col("lang").alias("target_lang"))
    return pr.add_constants(out, {"source_lang": "en", "data_source": SOURCE_LEXICON, "data_split": "train"})


@register("P05_filter_nonempty_pair", with_views(
    f"SELECT pair_id, {PAIR6_SQL} FROM pairs WHERE source_text <> '' AND target_text <> ''", "pairs"))
def q_filter_nonempty(spark, sf):
    return pr.filter_nonempty_pair(v.pairs(v.Tables(spark, sf)).drop("src", "row_id"))


NEIGHBOURS_SQL = ("neighbours", """SELECT a.doc_id, a.lang AS source_lang, b.lang AS target_lang,
  a.text AS source_text, b.text AS target_text FROM texts a JOIN texts b ON b.doc_id = a.doc_id + 1""")


def neighbours(t):
    """Each document's first line aligned with the next document's (codes may repeat)."""
    fl = v.texts(t)
    a = fl.select("doc_id", F.col("lang").alias("source_lang"), F.col("text").alias("source_text"))
    b = fl.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("target_lang"),
                  F.col("text").alias("target_text"))
    return a.join(b, "doc_id", "inner")


@register("P06_filter_distinct_lang", with_views(
    "SELECT doc_id, source_lang, target_lang, source_text, target_text FROM neighbours "
    "WHERE source_text <> '' AND target_text <> '' AND source_lang <> target_lang",
    "texts", extra=[NEIGHBOURS_SQL]))
def q_filter_distinct_lang(spark, sf):
    n = neighbours(v.Tables(spark, sf))
    return pr.filter_distinct_lang(pr.filter_nonempty_pair(n))


@register("P07_filter_lang_allowlist", with_views(
    f"""SELECT pair_id, {PAIR6_SQL} FROM pairs WHERE source_lang IN (SELECT code FROM lang_map)
  AND target_lang IN (SELECT code FROM lang_map)""", "pairs", "lang_map"))
def q_filter_allowlist(spark, sf):
    p = v.pairs(v.Tables(spark, sf)).drop("src", "row_id")
    return pr.filter_lang_allowlist(p, v.lang_map(spark))


@register("P08_drop_row_index", with_views(
    """SELECT pair_id, (row_number() OVER (ORDER BY row_id, pair_id) - 1)::BIGINT AS row_index
  FROM pairs WHERE source_text <> '' AND target_text <> ''""", "pairs"))
def q_drop_row_index(spark, sf):
    p = pr.filter_nonempty_pair(v.pairs(v.Tables(spark, sf))).select("pair_id", "row_id")
    return pr.dense_row_index(p, ["row_id", "pair_id"]).select("pair_id", "row_index")


# --- J: lookups ----------------------------------------------------------------------

@register("J01_lookup_lang_name", with_views(
    """SELECT p.pair_id, s.name AS source_lang, t.name AS target_lang, p.source_text, p.target_text
  FROM pairs p JOIN lang_map s ON p.source_lang = s.code JOIN lang_map t ON p.target_lang = t.code""",
    "pairs", "lang_map"))
def q_lookup_lang_name(spark, sf):
    p = v.pairs(v.Tables(spark, sf)).select("pair_id", "source_lang", "target_lang", "source_text", "target_text")
    lm = v.lang_map(spark)
    return pr.lookup_lang_name(pr.filter_lang_allowlist(p, lm), lm).select(
        "pair_id", "source_lang", "target_lang", "source_text", "target_text")


_sent_ids = " ".join(f"WHEN '{k}' THEN {val}" for k, val in SENTIMENT_LABELS.items())
_nli_names = " ".join(f"WHEN {val} THEN '{k}'" for k, val in NLI_LABELS.items())


@register("J02_lookup_label_id", with_views(
    f"SELECT doc_id, label_text, (CASE label_text {_sent_ids} END)::INTEGER AS labels FROM sent", "sent"))
def q_lookup_label_id(spark, sf):
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "label_text")
    return pr.lookup_label_id(s, "label_text", SENTIMENT_LABELS)


@register("J03_lookup_label_name", with_views(
    f"SELECT doc_id, labels, CASE labels {_nli_names} END AS label_text FROM nli", "nli"))
def q_lookup_label_name(spark, sf):
    n = v.nli(v.Tables(spark, sf)).select("doc_id", "labels")
    return pr.lookup_label_name(n, "labels", NLI_LABELS)


@register("J04_zip_by_position", with_views(
    """SELECT a.line_no, a.source_text, b.target_text FROM
  (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS line_no, regexp_replace(coalesce(source_text, ''), '[\r\n]', ' ', 'g') AS source_text FROM pairs) a
  JOIN (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS line_no, regexp_replace(coalesce(target_text, ''), '[\r\n]', ' ', 'g') AS target_text FROM pairs) b
  ON a.line_no = b.line_no""", "pairs"))
def q_zip_by_position(spark, sf):
    """Two line files, written apart in the order of pair_id and cut into parts differently, zipped by line number."""
    from corpusforge.operators.tokens import materialize
    from corpusforge.session import scratch_path
    from corpusforge.sources import files as fl

    t = v.Tables(spark, sf)
    wide = materialize(v.wide(t))  # both sides are written from it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def side(col, parts):
        path = scratch_path(spark, "zip")
        p = v.dealt_pairs(t, wide, parts).select("pair_id", F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "[\r\n]", " ").alias(col))
        p.sortWithinPartitions("pair_id").select(col).write.option("compression", "gzip").text(path)
        return fl.read_line_file(spark, path, across=True).select("line_no", F.col("text").alias(col))

    return pr.zip_tables(side("source_text", parts), side("target_text", parts + 2), "line_no")


# --- U: unions and reshapes ------------------------------------------------------------

@register("U01_union_by_name", with_views(
    f"""SELECT {PAIR6_SQL} FROM pairs
  UNION ALL SELECT 'en', lang, src_word, trg_word, NULL, '{SOURCE_LEXICON}' FROM lexicon""", "pairs", "lexicon"))
def q_union_by_name(spark, sf):
    t = v.Tables(spark, sf)
    p = v.pairs(t).select(*PAIR6)
    lx = v.lexicon(t).select(F.lit("en").alias("source_lang"), F.col("lang").alias("target_lang"),
                             F.col("src_word").alias("source_text"), F.col("trg_word").alias("target_text"),
                             F.lit(SOURCE_LEXICON).alias("data_source"))
    return pr.union_by_name([p, lx])


@register("U02_union_same_schema", with_views("SELECT doc_id, lang, source, text FROM texts", "texts"))
def q_union_same_schema(spark, sf):
    fl = v.texts(v.Tables(spark, sf))
    return pr.union_same_schema([fl.where(F.col("lang") == x) for x in v.LANGS] +
                                [fl.where(~F.col("lang").isin(v.LANGS))])


@register("U03_unpivot_ordered_pairs", with_views(
    "SELECT src, row_id, source_lang, target_lang, source_text, target_text FROM pairs0", "pairs0"))
def q_unpivot(spark, sf):
    return pr.unpivot_ordered_pairs(v.wide(v.Tables(spark, sf)), v.LANGS, keep=["src", "row_id"])


@register("U04_duplicate_n", with_views(
    "SELECT doc_id, copy_id::INTEGER AS copy_id, text FROM sent, range(7) AS r(copy_id)", "sent"))
def q_duplicate_n(spark, sf):
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "text")
    return pr.duplicate_n(s, 7)


# --- A10 -------------------------------------------------------------------------------

@register("A10_rows_per_subset", with_views(
    """SELECT data_source, data_split, count(*) AS n_rows FROM pairs
  WHERE source_text <> '' AND target_text <> '' AND source_lang <> target_lang GROUP BY 1, 2""", "pairs"))
def q_rows_per_subset(spark, sf):
    from corpusforge.operators.metrics import rows_per_subset

    p = pr.filter_distinct_lang(pr.filter_nonempty_pair(v.pairs(v.Tables(spark, sf))))
    return rows_per_subset(p)
