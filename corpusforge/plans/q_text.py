"""Registry entries: T01-T03, T05, T06, T08, T14-T21 (tokens, templates, labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.functions.rules import (
    BUDGET_SLACK_CHAT,
    BUDGET_SLACK_INSTRUCTION,
    BUDGET_SLACK_SECTIONS,
    CHAT_END,
    CHAT_START,
    CLASSIFIER_LENGTH,
    MLM_COPIES,
    MLM_LENGTH,
    SPECIALS,
)
from corpusforge.operators import batches as bt
from corpusforge.operators import chunk as ch
from corpusforge.operators import labels as lb
from corpusforge.operators import pairs as pr
from corpusforge.operators import templates as tp
from corpusforge.operators import tokens as tk
from corpusforge.operators.tokens import padded_vocab_size
from corpusforge.plans import views as v
from corpusforge.plans.q_core import CHUNK_SQL_CTES, arr_str
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import TOK, sq, with_views

BLOCK = CLASSIFIER_LENGTH  # 256 for the translation examples here
BUDGET_INSTR = (BLOCK - BUDGET_SLACK_INSTRUCTION) // 2   # 88
BUDGET_SECT = (BLOCK - BUDGET_SLACK_SECTIONS) // 2       # 78
BUDGET_CHAT = (BLOCK - BUDGET_SLACK_CHAT) // 2           # 113


def sql_encode(name: str, src: str, key: str, col: str, max_tokens: int | None = None):
    """DuckDB: ids (no specials) of ``col`` per ``key`` of the CTE ``src``."""
    tks = f"regexp_extract_all({col}, {sq(TOK)})"
    if max_tokens:
        tks = f"list_slice({tks}, 1, {max_tokens})"
    return (name, f"""SELECT s.{key} AS {key},
  coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS ids
  FROM {src} s LEFT JOIN (SELECT {key}, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS pos
    FROM (SELECT {key}, {tks} AS tk FROM {src})) t ON s.{key} = t.{key}
  LEFT JOIN vocab v ON v.token = t.token GROUP BY s.{key}""")


def sql_trunc(col: str, k: int) -> str:
    return f"array_to_string(list_slice(regexp_extract_all({col}, {sq(TOK)}), 1, {k}), ' ')"


def sql_title(col: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(replace({col}, '_', ' '), '\\p{{L}}+|[^\\p{{L}}]+'), "
            "lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '')")


def sql_pad(ids: str, length: int, pad: int = 1) -> str:
    return f"({ids} || list_transform(range({length} - len({ids})), lambda x: {pad}))"


def enc_docs(t, max_tokens=None, specials=False):
    return tk.encode(t["documents"], ["doc_id"], "text", v.vocab(t), max_tokens=max_tokens, add_specials=specials)


# --- T01-T03 ------------------------------------------------------------------------

@register("T01_tok_encode", with_views("SELECT doc_id, array_to_string(ids, ' ') AS ids FROM enc_docs", "enc_docs"))
def q_tok_encode(spark, sf):
    e = enc_docs(v.Tables(spark, sf), specials=True)
    return e.select("doc_id", arr_str("ids").alias("ids"))


@register("T02_tok_decode", with_views("""SELECT e.doc_id, coalesce(string_agg(v.token, ' ' ORDER BY u.pos), '') AS text
  FROM enc_docs e LEFT JOIN (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM enc_docs) u ON u.doc_id = e.doc_id
  LEFT JOIN vocab v ON v.id = u.id GROUP BY e.doc_id""", "enc_docs"))
def q_tok_decode(spark, sf):
    t = v.Tables(spark, sf)
    e = enc_docs(t, specials=True)
    return tk.decode(e, ["doc_id"], "ids", v.vocab(t))


@register("T03_vocab_build", with_views(
    "SELECT token, id, count, ((ceil((SELECT count(*) FROM vocab) / 64)) * 64)::BIGINT AS padded_size FROM vocab",
    "vocab"))
def q_vocab_build(spark, sf):
    voc = v.vocab(v.Tables(spark, sf))
    n = voc.select(F.count(F.lit(1))).scalar()
    return voc.withColumn("padded_size", padded_vocab_size(n))


# --- T05, T06, T08 -------------------------------------------------------------------

@register("T05_truncate_budget", with_views(
    f"SELECT pair_id, {sql_trunc('source_text', BUDGET_INSTR)} AS source_text, "
    f"{sql_trunc('target_text', BUDGET_INSTR)} AS target_text FROM pairs", "pairs"))
def q_truncate_budget(spark, sf):
    p = v.pairs(v.Tables(spark, sf))
    return p.select("pair_id", tx.truncate_tokens("source_text", BUDGET_INSTR).alias("source_text"),
                    tx.truncate_tokens("target_text", BUDGET_INSTR).alias("target_text"))


@register("T06_pad_truncate", with_views(
    "SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask "
    "FROM truncated", "truncated"))
def q_pad_truncate(spark, sf):
    e = v.truncated_examples(v.Tables(spark, sf))
    return e.select("doc_id", arr_str("input_ids").alias("input_ids"), arr_str("attention_mask").alias("attention_mask"))


@register("T08_pair_encode_only_first", with_views(f"""SELECT p.doc_id, p.labels,
  CASE WHEN {BLOCK} - 4 - len(h.ids) >= 0 THEN array_to_string({sql_pad(
      f"([0] || list_slice(p.ids, 1, {BLOCK} - 4 - len(h.ids)) || [2, 2] || h.ids || [2])", BLOCK)}, ' ') END AS input_ids,
  ({BLOCK} - 4 - len(h.ids) < 0) AS rejected
  FROM (SELECT e.doc_id, e.ids, n.labels FROM enc_p e JOIN nli n ON n.doc_id = e.doc_id) p
  JOIN enc_h h ON h.doc_id = p.doc_id""", "nli", "vocab",
    extra=[sql_encode("enc_p", "nli", "doc_id", "premise"), sql_encode("enc_h", "nli", "doc_id", "hypothesis")]))
def q_pair_encode(spark, sf):
    t = v.Tables(spark, sf)
    n = tk.materialize(v.nli(t))  # both sides are encoded from it
    voc = v.vocab(t)
    # at most BLOCK-4 premise tokens can be used, and BLOCK-3 hypothesis tokens already
    # mean "does not fit": encode no more than that (bounded groups, same result)
    prem = tk.encode(n, ["doc_id", "labels"], "premise", voc, max_tokens=BLOCK - 4, add_specials=False, out="p_ids")
    hyp = tk.encode(n, ["doc_id"], "hypothesis", voc, max_tokens=BLOCK - 3, add_specials=False, out="h_ids")
    j = prem.join(hyp, "doc_id")
    ids = tk.pair_encode_only_first("p_ids", "h_ids", BLOCK)
    padded, _ = tk.pad_truncate(ids, BLOCK)
    return j.select("doc_id", "labels", F.when(ids.isNotNull(), arr_str(padded)).alias("input_ids"),
                    ids.isNull().alias("rejected"))


# --- T14-T17: names and templates ------------------------------------------------------

NAMED_SQL = ("named", f"""SELECT p.pair_id, {sql_title('s.name')} AS source_name, {sql_title('t.name')} AS target_name,
  p.source_text, p.target_text FROM pairs p JOIN lang_map s ON p.source_lang = s.code
  JOIN lang_map t ON p.target_lang = t.code""")


def named_pairs(spark, sf):
    p = v.pairs(v.Tables(spark, sf)).select("pair_id", "source_lang", "target_lang", "source_text", "target_text")
    lm = v.lang_map(spark)
    j = pr.lookup_lang_name(pr.filter_lang_allowlist(p, lm), lm)
    return j.select("pair_id", tx.lang_display("source_lang").alias("source_name"),
                    tx.lang_display("target_lang").alias("target_name"), "source_text", "target_text")


@register("T14_lang_display", with_views("SELECT pair_id, source_name, target_name FROM named", "pairs", "lang_map",
                                         extra=[NAMED_SQL]))
def q_lang_display(spark, sf):
    return named_pairs(spark, sf).select("pair_id", "source_name", "target_name")


@register("T15_strip_newlines", f"SELECT doc_id, replace(text, {'chr(10)'}, '') AS text FROM documents")
def q_strip_newlines(spark, sf):
    d = v.Tables(spark, sf)["documents"]
    return d.select("doc_id", tx.strip_newlines("text").alias("text"))


def _sql_instruction(s_name, t_name, s_text, t_text, eos):
    head = tp.INSTRUCTION_PREAMBLE + " \n\n" + tp.INSTRUCTION_HEADER + "\nRender the passage below from "
    return (f"({sq(head)} || {s_name} || ' to ' || {t_name} || '.' || chr(10) || replace({s_text}, chr(10), '') || "
            f"{sq(chr(10) + chr(10) + tp.RESPONSE_HEADER + chr(10))} || replace({t_text}, chr(10), '') || {sq(eos)})")


PROMPT_SQL = ("prompts", f"""SELECT pair_id, {_sql_instruction('source_name', 'target_name',
    sql_trunc('source_text', BUDGET_INSTR), sql_trunc('target_text', BUDGET_INSTR), SPECIALS[2])} AS prompt FROM named""")


def prompts(spark, sf):
    n = named_pairs(spark, sf)
    return n.select("pair_id", tp.template_instruction(
        "source_name", "target_name", tx.truncate_tokens("source_text", BUDGET_INSTR),
        tx.truncate_tokens("target_text", BUDGET_INSTR)).alias("prompt"))


@register("T16_template_instruction", with_views("SELECT pair_id, prompt FROM prompts", "pairs", "lang_map",
                                                 extra=[NAMED_SQL, PROMPT_SQL]))
def q_template_instruction(spark, sf):
    return prompts(spark, sf)


def _sql_sections(s_name, t_name, s_text, t_text):
    a = (tp.SECTIONS_PREAMBLE + "\n\n" + tp.SECTIONS_INSTRUCTION + "\nAlihbahasakan kalimat di bawah ini dari bahasa ")
    b = ".\n\n" + tp.SECTIONS_INPUT + "\n"
    c = "\n\n" + tp.SECTIONS_RESPONSE + "\n"
    return (f"({sq(a)} || {s_name} || ' ke bahasa ' || {t_name} || {sq(b)} || {s_text} || {sq(c)} || {t_text} "
            "|| ' </s>')")


@register("T17_template_sections_id", with_views(
    f"""SELECT pair_id, {_sql_sections(sql_title("replace(source_lang, '_', ' ')"), sql_title("replace(target_lang, '_', ' ')"),
    sql_trunc('source_text', BUDGET_SECT), sql_trunc('target_text', BUDGET_SECT))} AS prompt FROM pairs""", "pairs"))
def q_template_sections(spark, sf):
    p = v.pairs(v.Tables(spark, sf))
    return p.select("pair_id", tp.template_sections(
        tx.lang_display("source_lang"), tx.lang_display("target_lang"),
        tx.truncate_tokens("source_text", BUDGET_SECT), tx.truncate_tokens("target_text", BUDGET_SECT)).alias("prompt"))


# --- T18-T21: labels and chat ---------------------------------------------------------------

def _sql_chat(messages: str, trim: int = 2) -> str:
    s = (f"array_to_string(list_transform({messages}, lambda m: {sq(CHAT_START)} || m.role || chr(10) || m.content || "
         f"{sq(CHAT_END)} || chr(10)), '')")
    return f"substr({s}, 1, greatest(length({s}) - {trim}, 0))"


@register("T19_template_chat", with_views(f"SELECT conv_id, {_sql_chat('messages')} AS text FROM chat", "chat"))
def q_template_chat(spark, sf):
    c = v.chat(v.Tables(spark, sf))
    return c.select("conv_id", tp.render_chat("messages").alias("text"))


MASK_SQL = f"""SELECT doc_id, copy_id::INTEGER AS copy_id, input_ids,
  list_transform(input_ids, lambda x, i: md5(concat_ws('#', doc_id::VARCHAR, copy_id::VARCHAR, '0', (i - 1)::VARCHAR))) AS h
  FROM examples, range({MLM_COPIES}) AS r(copy_id)"""


@register("T18_mask_mlm", with_views("""SELECT doc_id, copy_id,
  len(list_filter(lab, lambda y: y <> -100))::BIGINT AS n_picked,
  len(list_filter(list_zip(lab, new), lambda z: z[1] <> -100 AND z[2] = 4))::BIGINT AS n_masked,
  list_sum(new)::BIGINT AS sum_ids, list_sum(lab)::BIGINT AS sum_labels
  FROM (SELECT doc_id, copy_id,
    list_transform(list_zip(input_ids, h), lambda z: CASE WHEN z[1] >= 5 AND substr(z[2], 1, 8) < '26666666'
      THEN z[1] ELSE -100 END) AS lab,
    list_transform(list_zip(input_ids, h), lambda z: CASE
      WHEN NOT (z[1] >= 5 AND substr(z[2], 1, 8) < '26666666') THEN z[1]
      WHEN substr(z[2], 9, 8) < 'cccccccc' THEN 4
      WHEN substr(z[2], 9, 8) < 'e6666666' THEN (('0x' || substr(z[2], 17, 8))::BIGINT % (vs - 5) + 5)::INTEGER
      ELSE z[1] END) AS new
    FROM masked, (SELECT count(*) AS vs FROM vocab) s)""", "examples", "vocab", extra=[("masked", MASK_SQL)]))
def q_mask_mlm(spark, sf):
    t = v.Tables(spark, sf)
    ex = v.examples(t)
    vs = v.vocab(t).select(F.count(F.lit(1))).scalar()
    dup = pr.duplicate_n(ex, MLM_COPIES).withColumn("copy_id", F.col("copy_id").cast("int")).withColumn("_vs", vs)
    draws = lb.position_draws("input_ids", "doc_id", "copy_id", F.lit(0))
    key = ["doc_id", "copy_id"]
    return lb.mask_totals(lb.apply_position_mask("input_ids", draws, F.col("_vs"), rows=dup, keep=key), key)


CHUNK_EX_SQL = CHUNK_SQL_CTES + [
    ("chunk_texts", "SELECT doc_id || ':' || chunk_no AS chunk_id, text FROM chunks"),
    sql_encode("enc_chunks", "chunk_texts", "chunk_id", "text", MLM_LENGTH - 2),
    ("chunk_ex", f"""SELECT chunk_id, copy_id::INTEGER AS copy_id, epoch::INTEGER AS epoch, input_ids,
  list_transform(input_ids, lambda x, i: substr(d[(i - 1) // 4 + 1], (i - 1) % 4 * 8 + 1, 8)) AS h
  FROM (SELECT chunk_id, copy_id, epoch, input_ids,
    list_transform(range((len(input_ids) + 3) // 4), lambda g: md5(concat_ws('#', chunk_id, copy_id::VARCHAR, epoch::VARCHAR, g::VARCHAR))) AS d
    FROM (SELECT chunk_id, {sql_pad("([0] || ids || [2])", MLM_LENGTH)} AS input_ids FROM enc_chunks), range(2) AS r(copy_id), range(2) AS e(epoch))"""),
]


@register("T18_chunk_examples", with_views("""SELECT chunk_id, copy_id, epoch, len(list_filter(input_ids, lambda x: x <> 1))::BIGINT AS n_ids,
  list_sum(list_transform(list_zip(input_ids, h), lambda z: CASE
    WHEN z[1] < 5 OR z[2] >= '228f5c28' THEN z[1]
    WHEN z[2] < '1eb851eb' THEN 4
    ELSE (('0x' || z[2])::BIGINT % (vs - 5) + 5)::INTEGER END))::BIGINT AS sum_ids,
  list_sum(list_transform(list_zip(input_ids, h), lambda z: CASE WHEN z[1] >= 5 AND z[2] < '26666666' THEN z[1] ELSE -100 END))::BIGINT AS sum_labels
  FROM chunk_ex, (SELECT count(*) AS vs FROM vocab) s""", "vocab", extra=CHUNK_EX_SQL))
def q_chunk_examples(spark, sf):
    """Chunks -> ids of 512 -> two copies, two epochs, each with masks of its own."""
    t = v.Tables(spark, sf)
    c = ch.chunk_documents(t["documents"], keep=("doc_id",))
    c = c.select(F.concat_ws(":", "doc_id", "chunk_no").alias("chunk_id"), "text")
    ids, _ = tk.pad_truncate("ids", MLM_LENGTH)
    e = tk.encode(c, ["chunk_id"], "text", v.vocab(t), max_tokens=MLM_LENGTH - 2).select("chunk_id", ids.alias("input_ids"))
    vs = v.vocab(t).select(F.count(F.lit(1))).scalar()
    e = bt.epoch_expand(pr.duplicate_n(e, 2), 2).withColumns({"copy_id": F.col("copy_id").cast("int"), "epoch": F.col("epoch").cast("int"), "_vs": vs})
    e = e.withColumn("_draws", lb.mlm_draws("input_ids", "chunk_id", "copy_id", F.col("epoch")))
    masked, labels = lb.apply_mask("input_ids", "_draws", F.col("_vs"))
    e = e.select("chunk_id", "copy_id", "epoch", "input_ids", masked.alias("new"), labels.alias("lab"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.select("chunk_id", "copy_id", "epoch", F.size(F.filter("input_ids", lambda x: x != 1)).cast("bigint").alias("n_ids"),
                    total(F.col("new")).alias("sum_ids"), total(F.col("lab")).alias("sum_labels"))


@register("T20_labels_copy", with_views("""SELECT doc_id, array_to_string(input_ids, ' ') AS labels,
  array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END), ' ') AS labels_no_pad
  FROM examples""", "examples"))
def q_labels_copy(spark, sf):
    e = v.examples(v.Tables(spark, sf))
    return e.select("doc_id", arr_str(lb.labels_copy("input_ids")).alias("labels"),
                    arr_str(lb.labels_copy("input_ids", ignore_pad=True)).alias("labels_no_pad"))


# the marker inside a string of tokens that chr(31) stands before and after
MARKER_SQL = "(chr(31) || " + " || chr(31) || ".join(sq(x) for x in tp.RESPONSE_MARKER) + " || chr(31))"


@register("T21_labels_completion_only", with_views(f"""SELECT e.pair_id,
  array_to_string(list_transform({sql_pad(f"([0] || e.ids || [2])", BLOCK)},
    lambda x, i: CASE WHEN i <= coalesce(m.mend, {BLOCK}) OR x = 1 THEN -100 ELSE x END), ' ') AS labels,
  (m.mend IS NULL) AS marker_missing
  FROM enc_pr e JOIN (SELECT pair_id,
    CASE WHEN contains(al, {MARKER_SQL}) THEN {len(tp.RESPONSE_MARKER)} + length(before) - length(replace(before, chr(31), '')) END AS mend
    FROM (SELECT pair_id, al, regexp_extract(al, '(?s)^(.*)' || {MARKER_SQL}, 1) AS before
          FROM (SELECT pair_id, chr(31) || array_to_string(['<s>'] || list_slice(regexp_extract_all(prompt, {sq(TOK)}), 1, {BLOCK - 2})
                  || ['</s>'], chr(31)) || chr(31) AS al
          FROM prompts))) m ON m.pair_id = e.pair_id""",
    "pairs", "lang_map", "vocab", extra=[NAMED_SQL, PROMPT_SQL, sql_encode("enc_pr", "prompts", "pair_id", "prompt", BLOCK - 2)]))
def q_labels_completion(spark, sf):
    t = v.Tables(spark, sf)
    p = prompts(spark, sf)
    # tokens are cut once; they and the aligned ones are projected, as the marker search refers to them inside a lambda
    p = p.select("pair_id", tx.tokens_head("prompt", BLOCK - 2).alias("_toks"))
    p = p.withColumn("_al", F.concat(F.array(F.lit(SPECIALS[0])), "_toks", F.array(F.lit(SPECIALS[2]))))
    p = p.withColumn("mend", lb.marker_end("_al", tp.RESPONSE_MARKER)).drop("_al")
    e = tk.encode(p, ["pair_id", "mend"], "prompt", v.vocab(t), max_tokens=BLOCK - 2, add_specials=True, toks=F.col("_toks"))
    ids, _ = tk.pad_truncate("ids", BLOCK)
    # the padded ids and the marker's end are read for every position: both are projected first
    e = e.select("pair_id", "mend", ids.alias("_ids"), F.coalesce("mend", F.lit(BLOCK)).alias("_end"))
    return e.select("pair_id", arr_str(lb.labels_after("_ids", "_end")).alias("labels"), F.col("mend").isNull().alias("marker_missing"))
