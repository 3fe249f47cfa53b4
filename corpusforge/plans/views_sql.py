"""DuckDB twins of the fixture views, written independently as plain SQL.

``with_views(body, names)`` prefixes a query body with the CTEs it needs
(dependencies included, in order).
"""

from __future__ import annotations

import itertools
import re

from corpusforge.functions.rules import MLM_LENGTH, SENTENCE_RE, TOKEN_RE
from corpusforge.plans.views import LANG_MAP, LANGS, LEXICON_PIVOT, NEXT_LANG, PIECE_KEY

TOK = TOKEN_RE
SENT = SENTENCE_RE
NL = "chr(10)"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _split(digit: str, names=("train", "dev", "test")) -> str:
    return (f"CASE WHEN {digit} < 'c' THEN '{names[0]}' WHEN {digit} < 'e' THEN '{names[1]}' "
            f"ELSE '{names[2]}' END")


_pairs_union = "\n  UNION ALL ".join(
    f"SELECT src, row_id, '{a}' AS source_lang, '{b}' AS target_lang, {a} AS source_text, {b} AS target_text FROM wide"
    for a, b in itertools.permutations(LANGS, 2)
)

_pivot = ", ".join(f"max(CASE WHEN lang = '{x}' THEN text END) AS {x}" for x in LANGS)
_lang_map_rows = ", ".join(f"({sq(k)}, {sq(v)})" for k, v in sorted(LANG_MAP.items()))
_next_case = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NEXT_LANG.items()) + " END"



def _enc(table: str) -> str:
    """Token ids with begin and end marks, of every whole text of a (doc_id, text) table."""
    return f"""SELECT d.doc_id,
  [0] || coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) || [2] AS ids
  FROM {table} d LEFT JOIN (SELECT doc_id, unnest(tk) AS token, unnest(range(1, 1 + len(tk))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, {sq(TOK)}) AS tk FROM {table})) t ON d.doc_id = t.doc_id
  LEFT JOIN vocab v ON v.token = t.token
  GROUP BY d.doc_id"""


VIEWS: dict[str, tuple[list[str], str]] = {
    "texts": ([], "SELECT doc_id, lang, source, text FROM documents"),
    "wide": (["texts"], f"""SELECT source AS src, row_id, {_pivot}
  FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS row_id FROM texts)
  GROUP BY source, row_id"""),
    "pairs0": (["wide"], _pairs_union),
    "pairs": (["pairs0"], f"""SELECT concat_ws(':', src, row_id::VARCHAR, source_lang, target_lang) AS pair_id,
  src, row_id, source_lang, target_lang, source_text, target_text,
  {_split("substr(md5(concat_ws('#', src, row_id::VARCHAR)), 1, 1)")} AS data_split, src AS data_source
  FROM pairs0"""),
    "lang_map": ([], f"SELECT * FROM (VALUES {_lang_map_rows}) AS t(code, name)"),
    "token_counts": ([], f"""SELECT lang, token, count(*) AS n
  FROM (SELECT lang, unnest(regexp_extract_all(text, {sq(TOK)})) AS token FROM documents) GROUP BY lang, token"""),
    "ranked_tokens": (["token_counts"], f"""SELECT * FROM (SELECT lang, token, n,
  row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS lex_rank FROM token_counts)"""),
    "lexicon": (["ranked_tokens"], f"""SELECT o.lang, o.lex_rank, p.token AS src_word, o.token AS trg_word
  FROM ranked_tokens o JOIN ranked_tokens p ON p.lang = '{LEXICON_PIVOT}' AND o.lex_rank = p.lex_rank
  WHERE o.lang <> '{LEXICON_PIVOT}'"""),
    "sent": (["texts"], f"""SELECT f.doc_id, f.lang, f.source, f.text,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label_text,
  {_split("substr(md5(concat_ws('#', f.doc_id::VARCHAR, 'sent')), 1, 1)", ("train", "valid", "test"))} AS split
  FROM texts f JOIN labels l ON f.doc_id = l.doc_id"""),
    "nli_base": ([], f"""SELECT doc_id, lang, text AS premise,
  regexp_extract_all(text, {sq(SENT)})[1] AS s1, regexp_extract_all(text, {sq(SENT)})[2] AS s2,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM documents"""),
    "nli": (["nli_base"], f"""SELECT b.doc_id, b.lang, b.premise,
  CASE WHEN b.doc_id % 3 = 0 THEN coalesce(b.s2, b.s1) ELSE p.s1 END AS hypothesis, (b.doc_id % 3)::INTEGER AS labels
  FROM (SELECT *, CASE doc_id % 3 WHEN 1 THEN lang WHEN 2 THEN {_next_case} END AS t_lang FROM nli_base) b
  LEFT JOIN (SELECT lang, max(n) AS n_next FROM nli_base GROUP BY lang) c ON c.lang = b.t_lang
  LEFT JOIN nli_base p ON p.lang = b.t_lang
   AND p.idx = CASE b.doc_id % 3 WHEN 1 THEN (b.idx + 1) % b.n WHEN 2 THEN b.idx % c.n_next END
  WHERE (CASE WHEN b.doc_id % 3 = 0 THEN coalesce(b.s2, b.s1) ELSE p.s1 END) IS NOT NULL"""),
    "chat": ([], """SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id"""),
    "vocab_words": ([], f"""SELECT token, count(*) AS count
  FROM (SELECT unnest(regexp_extract_all(text, {sq(TOK)})) AS token FROM documents) GROUP BY token"""),
    "vocab": (["vocab_words"], """SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 4)::INTEGER AS id,
  count::BIGINT AS count FROM vocab_words
  UNION ALL SELECT * FROM (VALUES ('<s>', 0, 0::BIGINT), ('<pad>', 1, 0), ('</s>', 2, 0), ('<unk>', 3, 0),
  ('<mask>', 4, 0)) AS s(token, id, count)"""),
    "enc_docs": (["vocab"], _enc("documents")),
    "pieces": ([], f"""SELECT doc_id * {PIECE_KEY} + i AS doc_id,
  coalesce(array_to_string(list_slice(tk, i * {MLM_LENGTH - 2} + 1, (i + 1) * {MLM_LENGTH - 2}), ' '), '') AS text
  FROM (SELECT doc_id, tk, unnest(range(greatest(1, (len(tk) + {MLM_LENGTH - 3}) // {MLM_LENGTH - 2}))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, {sq(TOK)}) AS tk FROM documents))"""),
    "enc": (["vocab", "pieces"], _enc("pieces")),
    "truncated": (["enc_docs"], f"""SELECT doc_id, ids || list_transform(range({MLM_LENGTH} - len(ids)), lambda x: 1) AS input_ids,
  list_transform(range(len(ids)), lambda x: 1) || list_transform(range({MLM_LENGTH} - len(ids)), lambda x: 0) AS attention_mask
  FROM (SELECT doc_id, CASE WHEN len(ids) > {MLM_LENGTH} THEN list_slice(ids, 1, {MLM_LENGTH - 1}) || [2] ELSE ids END AS ids FROM enc_docs)"""),
    "examples": (["enc"], f"""SELECT doc_id, ids || list_transform(range({MLM_LENGTH} - len(ids)), lambda x: 1) AS input_ids,
  list_transform(range(len(ids)), lambda x: 1) || list_transform(range({MLM_LENGTH} - len(ids)), lambda x: 0)
    AS attention_mask FROM enc"""),
    "preds": (["sent"], """SELECT doc_id, [""" + ", ".join(
        f"((('0x' || substr(md5(concat_ws('#', doc_id::VARCHAR, '{i}')), 1, 4))::BIGINT - 32768) / 4096.0::DOUBLE)"
        for i in range(3)) + """] AS logits,
  (CASE label_text WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END)::INTEGER AS label
  FROM sent"""),
    "runs": ([], """SELECT run, (step // 16)::BIGINT AS epoch, step, batch_rows,
  (('0x' || substr(md5(concat_ws('#', run, step::VARCHAR)), 1, 6))::BIGINT / 4194304.0::DOUBLE) AS val_loss
  FROM (SELECT lang AS run, (doc_id // 8)::BIGINT AS step, count(*) AS batch_rows FROM documents GROUP BY 1, 2)"""),
}


def _resolve(names, out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        _resolve(VIEWS[n][0], out)
        if n not in out:
            out.append(n)


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []
    _resolve(names, order)
    named = [(n, VIEWS[n][1]) for n in order] + list(extra or [])
    if not named:
        return body
    texts = [q for _, q in named] + [body]

    def cte(n: str, q: str) -> str:  # one that is read more than once is worked out once
        uses = sum(len(re.findall(rf"\b(?:FROM|JOIN|,)\s*{n}\b", t)) for t in texts)
        return f"{n} AS {'MATERIALIZED ' if uses > 1 else ''}(\n  {q}\n)"

    return "WITH " + ",\n".join(cte(n, q) for n, q in named) + "\n" + body
