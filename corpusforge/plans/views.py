"""Fixture views built from the driver tables (Spark side).

Each view turns the generic driver tables into inputs shaped like the
reference's: parallel pairs, lexicons, sentiment and NLI rows, chats,
token examples and model scores. The DuckDB twins are in ``views_sql``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.functions.rules import MLM_LENGTH, NLI_LABELS, SENTIMENT_LABELS, TOKEN_RE
from corpusforge.operators import pairs as pr
from corpusforge.operators import tokens as tk
from corpusforge.operators.index import range_index

# Languages of the driver's documents; pairs are all ordered pairs of them.
LANGS = ["de", "en", "es", "fr"]
# Fixture dictionary: es is left out on purpose (the allowlist removes rows);
# two codes share one name (same-name pairs after mapping).
LANG_MAP = {"de": "west_germanic", "en": "west_germanic", "fr": "north_french"}
# NLI "other language" partner: the next language in LANGS order.
NEXT_LANG = {"de": "en", "en": "es", "es": "fr", "fr": "de"}
LEXICON_PIVOT = "en"


# Text tables whose rows carry long strings and feed CPU-heavy regex work.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


class Tables:
    """Lazy access to the driver's parquet tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            key = TEXT_TABLES.get(name)
            self.frames[name] = spread(df, key) if key else df
        return self.frames[name]

    @functools.cached_property
    def vocab(self) -> DataFrame:
        """The vocabulary of the documents: built once for these files, then read by every query."""
        return tk.stored(self["documents"], tk.vocab_build, "vocab", TOKEN_RE)


SPREAD_CONF = "corpusforge.spreadPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a text table by its key into the number of partitions that ``SPREAD_CONF`` names.

    Off by default: the file splits of a large corpus give every core work. A
    local session on one small file sets it, whatever the table's size."""
    n = int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(n, key) if n > 0 else df


def hash_digit(*parts) -> Column:
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.md5(F.concat_ws("#", *cols)), 1, 1)


def texts(t: Tables) -> DataFrame:
    """Whole document texts with their language and source."""
    return t["documents"].select("doc_id", "lang", "source", "text")


def wide(t: Tables) -> DataFrame:
    """Rank documents in each (source, lang) by doc_id; pivot on lang (one aggregate: texts are shuffled once for it)."""
    ranked = range_index(t["documents"].select("doc_id", "lang", "source"), order=["doc_id"], partition_by=["source", "lang"], name="row_id")
    cells = [F.first(F.when(F.col("lang") == x, F.col("text")), ignorenulls=True).alias(x) for x in LANGS]
    return ranked.join(t["documents"].select("doc_id", "text"), "doc_id").groupBy(F.col("source").alias("src"), "row_id").agg(*cells)


def split_of(digit: Column, names=("train", "dev", "test")) -> Column:
    return F.when(digit < "c", names[0]).when(digit < "e", names[1]).otherwise(names[2])


def pairs(t: Tables) -> DataFrame:
    """U03 over wide; split from md5(src#row_id); data_source = src."""
    return pairs_of(wide(t))


def pairs_of(wide_rows: DataFrame) -> DataFrame:
    """The pairs of rows of ``wide``, where those rows are: no shuffle."""
    p = pr.unpivot_ordered_pairs(wide_rows, LANGS, keep=["src", "row_id"])
    return p.select(
        F.concat_ws(":", "src", F.col("row_id").cast("string"), "source_lang", "target_lang").alias("pair_id"),
        "src", "row_id", "source_lang", "target_lang", "source_text", "target_text",
        split_of(hash_digit("src", "row_id")).alias("data_split"),
        F.col("src").alias("data_source"),
    )


def pair_head() -> Column:
    """With what the ids of a wide row's pairs begin: source, number and a colon."""
    return F.concat_ws(":", "src", F.col("row_id").cast("string"), F.lit(""))


def dealt_pairs(t: Tables, wide_rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Pairs in range partitions of pair_id, unsorted there.

    Rows are dealt by ``pair_head`` while they are wide and hold each text once. Without a null source or one with a
    colon no head is the beginning of another, so heads order rows as the ids order pairs; with one, the pairs are dealt."""
    n = () if partitions is None else (partitions,)
    odd = t["documents"].select("source").where(F.coalesce(F.contains("source", F.lit(":")), F.lit(True)))
    if odd.isEmpty():
        return pairs_of(wide_rows.repartitionByRange(*n, pair_head()))
    return pairs_of(wide_rows).repartitionByRange(*n, "pair_id")


def lang_map(spark: SparkSession) -> DataFrame:
    return pr.lang_table(spark, LANG_MAP)


def token_counts(t: Tables) -> DataFrame:
    docs = t["documents"]
    return (
        docs.select("lang", F.explode(tx.tokens("text")).alias("token"))
        .groupBy("lang", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked_tokens(t: Tables) -> DataFrame:
    """Every token of a language with its rank (from 1) by (count desc, token)."""
    r = range_index(token_counts(t), order=[F.col("n").desc(), F.col("token")], partition_by=["lang"], name="_r")
    return r.select("lang", "token", "n", (F.col("_r") + 1).cast("int").alias("lex_rank"))


def lexicon(t: Tables) -> DataFrame:
    """(lang, lex_rank, src_word, trg_word): pivot-language tokens matched by rank."""
    top = ranked_tokens(t)
    piv = top.where(F.col("lang") == LEXICON_PIVOT).select("lex_rank", F.col("token").alias("src_word"))
    oth = top.where(F.col("lang") != LEXICON_PIVOT).select("lang", "lex_rank", F.col("token").alias("trg_word"))
    return oth.join(piv, "lex_rank", "inner").select("lang", "lex_rank", "src_word", "trg_word")


def sent(t: Tables) -> DataFrame:
    fl = texts(t)
    lab = t["labels"]
    label_text = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    )
    return fl.join(lab, "doc_id", "inner").select(
        "doc_id", "lang", "source", "text", label_text.alias("label_text"),
        split_of(hash_digit("doc_id", F.lit("sent")), ("train", "valid", "test")).alias("split"),
    )


def nli(t: Tables) -> DataFrame:
    docs = t["documents"]
    s = tx.sentences_head("text", 2)
    base = docs.select(
        "doc_id", "lang", F.col("text").alias("premise"),
        F.try_element_at(s, F.lit(1)).alias("s1"), F.try_element_at(s, F.lit(2)).alias("s2"),
    )
    keys = range_index(docs.select("doc_id", "lang"), order=["doc_id"], partition_by=["lang"], name="idx", total_name="n")
    ranked = base.join(keys.drop("lang"), "doc_id")
    per_lang = ranked.groupBy("lang").agg(F.max("n").alias("n_next"))  # one row per language
    nxt = F.create_map(*[x for kv in NEXT_LANG.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    lab = (F.col("doc_id") % 3).cast("int")
    tgt = ranked.withColumn("labels", lab).withColumn(
        "t_lang", F.when(F.col("labels") == 1, F.col("lang")).when(F.col("labels") == 2, nxt[F.col("lang")])
    )
    tgt = tgt.join(F.broadcast(per_lang.withColumnRenamed("lang", "t_lang")), "t_lang", "left").withColumn(
        "t_idx",
        F.when(F.col("labels") == 1, (F.col("idx") + 1) % F.col("n"))
        .when(F.col("labels") == 2, F.col("idx") % F.col("n_next")),
    )
    partner = ranked.select(F.col("lang").alias("t_lang"), F.col("idx").alias("t_idx"), F.col("s1").alias("p_s1"))
    j = tgt.join(partner, ["t_lang", "t_idx"], "left")
    hyp = F.when(F.col("labels") == 0, F.coalesce("s2", "s1")).otherwise(F.col("p_s1"))
    return j.select("doc_id", "lang", "premise", hyp.alias("hypothesis"), "labels").where(
        F.col("hypothesis").isNotNull()
    )


def chat(t: Tables) -> DataFrame:
    c = t["conversations"]
    msgs = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(msgs.alias("_m")).select(
        "conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def vocab(t: Tables) -> DataFrame:
    return t.vocab


# pieces of one document have doc_id * PIECE_KEY + 0, 1, 2, ... as their key
PIECE_KEY = 1_000_000


def pieces(t: Tables, length: int = MLM_LENGTH) -> DataFrame:
    """Documents cut into consecutive pieces of ``length`` - 2 tokens, so that no token is lost: (doc_id, text).

    doc_id is the piece's key. A document without tokens is one empty piece."""
    size = length - 2
    d = t["documents"].select("doc_id", tx.tokens("text").alias("_t"))
    n = F.greatest(F.ceil(F.size("_t") / size), F.lit(1)).cast("int")
    d = d.select("doc_id", "_t", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    text = F.array_join(F.slice("_t", F.col("_i") * size + 1, F.lit(size)), " ")
    return d.select((F.col("doc_id") * PIECE_KEY + F.col("_i")).alias("doc_id"), text.alias("text"))


def examples(t: Tables, length: int = MLM_LENGTH) -> DataFrame:
    """T06 over all pieces with the built vocabulary: (doc_id, input_ids, attention_mask)."""
    return padded(tk.encode(pieces(t, length), ["doc_id"], "text", vocab(t)), length)


def truncated_examples(t: Tables, length: int = MLM_LENGTH) -> DataFrame:
    """T06 on whole documents, where cutting at ``length`` is the feature."""
    return padded(tk.encode(t["documents"], ["doc_id"], "text", vocab(t), max_tokens=length - 2), length)


def padded(enc: DataFrame, length: int) -> DataFrame:
    ids, mask = tk.pad_truncate("ids", length)
    return enc.select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"))


def score(key: Column, i: int) -> Column:
    """A deterministic score in [-8, 8) from md5 hex digits (exact in binary)."""
    h = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(i))))
    return (F.conv(F.substring(h, 1, 4), 16, 10).cast("bigint") - 32768) / F.lit(4096.0)


def preds(t: Tables) -> DataFrame:
    """3 scores per labelled document plus the sentiment label id."""
    sv = sent(t)
    lab = pr._map_literal(SENTIMENT_LABELS)[F.col("label_text")].cast("int")
    return sv.select("doc_id", F.array(*[score(F.col("doc_id"), i) for i in range(3)]).alias("logits"),
                     lab.alias("label"))


def token_preds(ex: DataFrame) -> Column:
    """Per-token prediction: the label itself when an md5 digit is below 'a', else label + 1;
    ignored positions (-100) draw nothing and predict -100."""
    return F.transform(
        "labels",
        lambda y, i: F.when(y == -100, y).when(
            F.substring(F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), i.cast("string"))), 1, 1) < "a", y
        ).otherwise(y + 1),
    )


def runs(t: Tables) -> DataFrame:
    """(run, epoch, step, val_loss): run = language, step = doc_id div 8."""
    d = t["documents"].select(F.col("lang").alias("run"), F.floor(F.col("doc_id") / 8).cast("bigint").alias("step"))
    d = d.groupBy("run", "step").agg(F.count(F.lit(1)).alias("batch_rows"))
    h = F.md5(F.concat_ws("#", "run", F.col("step").cast("string")))
    return d.select(
        "run", (F.floor(F.col("step") / 16)).cast("bigint").alias("epoch"), "step", "batch_rows",
        (F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint") / F.lit(float(1 << 22))).alias("val_loss"),
    )


NLI_LABEL_IDS = NLI_LABELS
