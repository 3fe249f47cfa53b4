"""Registry entries: S01-S14, S16. Each query writes data Spark derives from the
driver tables into a fresh folder under the shared checkpoint folder, reads it
back with the source under test, and returns what it read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.functions.rules import ALIGNED_LANGS, ALIGNED_SPLITS, ALIGNED_SUBSETS, LEXICON_PIVOT_COLUMN
from corpusforge.operators import metrics as mt
from corpusforge.operators.index import range_index
from corpusforge.operators.sampling import head_split_capped
from corpusforge.operators.tokens import materialize
from corpusforge.plans import views as v
from corpusforge.plans.q_core import arr_str
from corpusforge.plans.q_text import _sql_sections, sql_encode, sql_pad, sql_title, sql_trunc
from corpusforge.plans.registry import register
from corpusforge.plans.views_sql import sq, with_views
from corpusforge.session import drop_scratch, scratch_path, shuffles_cleaned
from corpusforge.sources import corpus as cp
from corpusforge.sources import files as fl
from corpusforge.streaming import stream as st

PAIR6 = "source_lang, target_lang, source_text, target_text, data_split, data_source"
CSV_W = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _pairs(spark, sf):
    return v.pairs(v.Tables(spark, sf))


@register("S12_sink_table", with_views(f"SELECT pair_id, {PAIR6} FROM pairs", "pairs"))
def q_sink_table(spark, sf):
    path = fl.write_table(_pairs(spark, sf).drop("src", "row_id"), scratch_path(spark, "pairs"))
    return fl.read_split(spark, path)


@register("S01_src_table", with_views(f"SELECT pair_id, {PAIR6} FROM pairs WHERE data_split = 'dev'", "pairs"))
def q_src_table(spark, sf):
    path = fl.write_table(_pairs(spark, sf).drop("src", "row_id"), scratch_path(spark, "pairs"))
    return fl.read_split(spark, path, "dev")


@register("S02_src_by_extension", with_views(
    "SELECT source_lang, target_lang, source_text, target_text, 'train' AS data_split FROM pairs", "pairs"))
def q_src_by_extension(spark, sf):
    path = scratch_path(spark, "pairs") + ".json"
    with shuffles_cleaned(spark):
        _pairs(spark, sf).select(*fl.PAIR4).write.json(path, compression="gzip")
    df = fl.read_by_extension(spark, path)
    return df.select(*fl.PAIR4, "data_split")


def _in_file_order(df, *order):
    """Parts in the order of ``order``: the position of a row in the files (by path) is its rank."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _pairs_in_file_order(spark, sf):
    """``_in_file_order`` by pair_id, dealt out while the rows are wide and hold each text once."""
    t = v.Tables(spark, sf)
    return v.dealt_pairs(t, v.wide(t)).select("pair_id", *fl.PAIR4).sortWithinPartitions("pair_id")


@register("S02_src_csv", with_views("SELECT pair_id, source_lang, target_lang, source_text, target_text, 'train' AS data_split, "
                                    "(row_number() OVER (ORDER BY pair_id) - 1)::BIGINT AS pos FROM pairs", "pairs"))
def q_src_csv(spark, sf):
    path = scratch_path(spark, "pairs") + ".csv"
    with shuffles_cleaned(spark):
        _pairs_in_file_order(spark, sf).write.options(**CSV_W, compression="gzip").csv(path)
    df = fl.read_by_extension(spark, path)
    places = range_index(df.select("file", "line_no"), ["file", "line_no"], name="pos")  # (file, line_no) is a row's place: unique
    return df.join(places, ["file", "line_no"]).select("pair_id", *fl.PAIR4, "data_split", "pos")


@register("S02_src_txt", """SELECT doc_id || ' ' || lang AS text, 'train' AS data_split,
  (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos FROM documents""")
def q_src_txt(spark, sf):
    path = scratch_path(spark, "docs") + ".txt"
    d = _in_file_order(v.Tables(spark, sf)["documents"].select("doc_id", "lang"), "doc_id")
    d.select(F.concat_ws(" ", "doc_id", "lang")).write.text(path)
    df = range_index(fl.read_by_extension(spark, path, required=["text"]), ["file", "line_no"], name="pos")
    return df.select("text", "data_split", "pos")


@register("S02_validation_file_only", with_views(
    "SELECT source_lang, target_lang, source_text, target_text, 'validation' AS data_split FROM pairs", "pairs"))
def q_src_validation_only(spark, sf):
    path = scratch_path(spark, "pairs") + ".json"
    with shuffles_cleaned(spark):
        _pairs(spark, sf).select(*fl.PAIR4).write.json(path, compression="gzip")
    return fl.read_by_extension(spark, validation_file=path).select(*fl.PAIR4, "data_split")


CLM_BLOCK, CLM_TRAIN, CLM_EVAL = 1024, 500, 50
CLM_SQL = ("clm", f"""SELECT pair_id, data_split, {_sql_sections(sql_title("replace(source_lang, '_', ' ')"), sql_title("replace(target_lang, '_', ' ')"),
    sql_trunc('source_text', (CLM_BLOCK - 100) // 2), sql_trunc('target_text', (CLM_BLOCK - 100) // 2))} AS prompt FROM (
  SELECT * EXCLUDE (data_split), CASE WHEN pos < cut THEN 'validation' ELSE 'train' END AS data_split FROM (
    SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS pos, floor(5 * count(*) OVER () / 100 + 0.5) AS cut FROM pairs)
  WHERE (pos < cut AND pos < {CLM_EVAL}) OR (pos >= cut AND pos - cut < {CLM_TRAIN}))""")


@register("S02_clm_examples", with_views(f"""SELECT e.pair_id, p.data_split, array_to_string({sql_pad(f"([0] || list_slice(e.ids, 1, {CLM_BLOCK - 2}) || [2])", CLM_BLOCK)}, ' ') AS labels
  FROM enc_clm e JOIN clm p ON p.pair_id = e.pair_id""", "pairs", "vocab",
    extra=[CLM_SQL, sql_encode("enc_clm", "clm", "pair_id", "prompt", CLM_BLOCK - 2)]))
def q_clm_examples(spark, sf):
    """File -> head split -> template -> ids -> caps: csv, 5 % validation, blocks of 1,024, first 500 and 50 rows."""
    path = scratch_path(spark, "pairs") + ".csv"
    with shuffles_cleaned(spark):
        _pairs_in_file_order(spark, sf).write.options(**CSV_W, compression="gzip").csv(path)
    df = fl.read_by_extension(spark, path).drop("data_split")
    places = head_split_capped(df.select("file", "line_no"), ["file", "line_no"], 5, CLM_TRAIN, CLM_EVAL)
    df = df.join(F.broadcast(places), ["file", "line_no"])  # places: at most the two caps
    ex = st.sections_examples(df, v.vocab(v.Tables(spark, sf)), CLM_BLOCK, key=("pair_id", "data_split"))
    return ex.select("pair_id", "data_split", arr_str("labels").alias("labels"))


@register("S03_src_text_linebreaks", "SELECT unnest(string_split(text, chr(10))) || chr(10) AS text FROM documents")
def q_src_text_linebreaks(spark, sf):
    path = scratch_path(spark, "docs-text")
    v.Tables(spark, sf)["documents"].select("text").write.text(path)
    return fl.read_text_lines(spark, path, keep_linebreaks=True)


@register("S04_src_headerless_tsv", with_views(
    "SELECT source_lang, target_lang, data_split FROM pairs", "pairs"))
def q_src_headerless_tsv(spark, sf):
    p = _pairs(spark, sf)
    out = []
    for split in ("train", "dev", "test"):
        path = scratch_path(spark, f"{split}.id")
        cols = ["data_source", "source_lang", "target_lang"] if split == "train" else ["source_lang", "target_lang"]
        p.where(F.col("data_split") == split).select(F.concat_ws("\t", *cols)).write.text(path)
        out.append(fl.read_id_file(spark, path, split).withColumn("data_split", F.lit(split)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("S05_src_line_file", """SELECT (row_number() OVER (ORDER BY doc_id, i) - 1)::BIGINT AS line_no, text FROM (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def q_src_line_file(spark, sf):
    path = scratch_path(spark, "lines")
    _in_file_order(v.Tables(spark, sf)["documents"].select("doc_id", "text"), "doc_id").select("text").write.text(path)
    return fl.read_line_file(spark, path, across=True).select("line_no", "text")


def _dealt_pairs(wide):
    """Pairs with subset and split, in range partitions of (subset, split, pair_id), dealt out while the rows are wide.

    In one source no head of a row's pair ids is the beginning of another, so heads order rows as the ids order pairs."""
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = wide.repartitionByRange(n, F.col("src"), v.split_of(v.hash_digit("src", "row_id")), v.pair_head())
    return v.pairs_of(rows).withColumns({"subset": F.col("src"), "split": F.col("data_split")})


def _aligned(spark, sf):
    root = scratch_path(spark, "aligned")
    fl.write_aligned(_dealt_pairs(v.wide(v.Tables(spark, sf))), root, order="pair_id", dealt=True)
    return fl.read_aligned(spark, root, layout="partitioned")


@register("S06_src_aligned_lines", with_views("""SELECT
  (row_number() OVER (PARTITION BY src, data_split ORDER BY pair_id) - 1)::BIGINT AS line_no,
  source_lang, target_lang, regexp_replace(coalesce(source_text, ''), '[\r\n]', ' ', 'g') AS source_text,
  regexp_replace(coalesce(target_text, ''), '[\r\n]', ' ', 'g') AS target_text,
  data_split, 'tatoeba-' || src AS data_source FROM pairs""", "pairs"))
def q_src_aligned_lines(spark, sf):
    pairs, _ = _aligned(spark, sf)
    return pairs


_expected = ", ".join(f"({sq(s)}, {sq(p)})" for s in ALIGNED_SUBSETS for p in ALIGNED_SPLITS)


@register("S07_src_manifest_status", with_views(f"""SELECT 'tatoeba-' || s AS data_source, p AS data_split,
  'rejected' AS status, 'missing files' AS reason, NULL::BIGINT AS n_rows FROM (VALUES {_expected}) AS e(s, p)
  UNION ALL SELECT 'tatoeba-' || src, data_split, 'loaded', NULL,
  count(*) FILTER (WHERE coalesce(source_text, '') <> '' AND coalesce(target_text, '') <> ''
                   AND source_lang <> target_lang)::BIGINT
  FROM pairs GROUP BY src, data_split""", "pairs"))
def q_src_manifest_status(spark, sf):
    pairs, status = _aligned(spark, sf)
    return fl.manifest_counts(pairs, status)


@register("S08_src_wide_csv_dir", with_views(f"""SELECT src, row_id, de, en, es, fr,
  CASE WHEN substr(md5(concat_ws('#', src, row_id::VARCHAR)), 1, 1) < 'c' THEN 'train'
       WHEN substr(md5(concat_ws('#', src, row_id::VARCHAR)), 1, 1) < 'e' THEN 'dev' ELSE 'test' END AS data_split,
  'nusax-mt' AS data_source FROM wide""", "wide"))
def q_src_wide_csv_dir(spark, sf):
    root = scratch_path(spark, "wide")
    w = v.wide(v.Tables(spark, sf))
    w = w.withColumn("_split", v.split_of(v.hash_digit("src", "row_id")))
    for split in ("train", "dev", "test"):
        part = w.where(F.col("_split") == split).select(F.lit(0).alias("Unnamed: 0"), "src", "row_id", *v.LANGS)
        part.write.options(**CSV_W).csv(f"{root}/{split}.csv")
    df = fl.read_wide_csv_dir(spark, root)
    return df.withColumn("row_id", F.col("row_id").cast("bigint"))


@register("S09_src_lexicon_dir", with_views(f"""SELECT '{LEXICON_PIVOT_COLUMN}' AS source_lang, lang AS target_lang,
  src_word AS source_text, trg_word AS target_text, 'nusax-lexicon' AS data_source, 'train' AS data_split
  FROM lexicon""", "lexicon"))
def q_src_lexicon_dir(spark, sf):
    root = scratch_path(spark, "lexicon")
    _write_lexicons(v.lexicon(v.Tables(spark, sf)), root)
    return fl.read_lexicon_dir(spark, root, split="train")


def _write_lexicons(lx, root):
    for lang in [x for x in v.LANGS if x != v.LEXICON_PIVOT]:
        lx.where(F.col("lang") == lang).select(F.col("src_word").alias(LEXICON_PIVOT_COLUMN),
                                               F.col("trg_word").alias(lang)).write.options(**CSV_W, compression="gzip").csv(
            f"{root}/{lang}.csv")


#: stand-in codes of the test languages: one code the dictionary lacks, two codes of one name
CODES = {"de": "ban", "en": "eng", "es": "zlm_Latn", "fr": "zsm_Latn"}
UNKNOWN_CODE = "zlm"


def _sql_code(c):
    return f"CASE WHEN {c} = 'de' AND row_id % 3 = 0 THEN '{UNKNOWN_CODE}' ELSE CASE {c} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in CODES.items()) + " END END"


@register("S06_corpus_build", with_views(f"""SELECT a.name AS source_lang, b.name AS target_lang, source_text, target_text, data_split, 'tatoeba-' || src AS data_source
  FROM (SELECT src, data_split, {_sql_code('source_lang')} AS s, {_sql_code('target_lang')} AS t,
    regexp_replace(coalesce(source_text, ''), '[\r\n]', ' ', 'g') AS source_text, regexp_replace(coalesce(target_text, ''), '[\r\n]', ' ', 'g') AS target_text FROM pairs)
  JOIN names a ON a.code = s JOIN names b ON b.code = t WHERE source_text <> '' AND target_text <> '' AND s <> t
  UNION ALL SELECT source_lang, target_lang, source_text, target_text, data_split, 'nusax-mt' FROM pairs
  UNION ALL SELECT '{LEXICON_PIVOT_COLUMN}', lang, src_word, trg_word, 'train', 'nusax-lexicon' FROM lexicon""", "pairs", "lexicon",
    extra=[("names", "SELECT * FROM (VALUES " + ", ".join(f"({sq(k)}, {sq(n)})" for k, n in ALIGNED_LANGS.items()) + ") AS t(code, name)")]))
def q_corpus_build(spark, sf):
    """Aligned lines, wide CSV and lexicon files -> filters, dictionary, ordered pairs -> one stored table."""
    t = v.Tables(spark, sf)
    rows, words = materialize(v.wide(t)), materialize(v.lexicon(t))  # each is written to several files
    aligned, wide, lexicon = (scratch_path(spark, f"build-{x}") for x in ("aligned", "wide", "lexicon"))
    named = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    code = lambda c: F.when((F.col(c) == "de") & (F.col("row_id") % 3 == 0), UNKNOWN_CODE).otherwise(named[F.col(c)])
    p = _dealt_pairs(rows).withColumns({"source_lang": code("source_lang"), "target_lang": code("target_lang")})
    with shuffles_cleaned(spark):
        fl.write_aligned(p, aligned, order="pair_id", dealt=True)
        w = rows.withColumn("_split", v.split_of(v.hash_digit("src", "row_id")))
        for split in ("train", "dev", "test"):
            w.where(F.col("_split") == split).select(F.col("row_id").alias("Unnamed: 0"), *v.LANGS).write.options(**CSV_W, compression="gzip").csv(f"{wide}/{split}.csv")
        _write_lexicons(words, lexicon)
        drop_scratch(spark, *rows.inputFiles(), *words.inputFiles())  # all that is read from here on are the three kinds of files
        out = cp.build_pair_corpus(spark, scratch_path(spark, "build-out"), aligned, wide, lexicon, layout="partitioned")[0]
    drop_scratch(spark, aligned, wide, lexicon)
    return out


@register("S10_src_nested_dir", with_views(
    "SELECT doc_id, text, label_text, lang AS language, split FROM sent", "sent"))
def q_src_nested_dir(spark, sf):
    root = scratch_path(spark, "sentiment")
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "text", "label_text", "lang", "split")
    s.write.partitionBy("lang", "split").options(**CSV_W).csv(root + "-staging")
    # reshape the staging table into <lang>/<split>.csv folders with one rename per folder
    fs, _ = fl._fs(spark, root)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root))
    for lang_dir in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root + "-staging")):
        name = lang_dir.getPath().getName()
        if not name.startswith("lang="):
            continue
        lang = name.split("=", 1)[1]
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/{lang}"))
        for split_dir in fs.listStatus(lang_dir.getPath()):
            split = split_dir.getPath().getName().split("=", 1)[1]
            fs.rename(split_dir.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/{lang}/{split}.csv"))
    df = fl.read_nested_dir(spark, root)
    return df.select(F.col("doc_id").cast("bigint"), "text", "label_text", "language", "split")


@register("S11_src_gzip_text", """SELECT doc_id, (unnest(range(len(l))))::BIGINT AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def q_src_gzip_text(spark, sf):
    """Lines with their order; a line ``#doc <id>`` before each document lets the numbers be told per document."""
    path = scratch_path(spark, "gz")
    d = v.Tables(spark, sf)["documents"].select("doc_id", "text").sortWithinPartitions("doc_id")
    d.select(F.concat(F.lit("#doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))).write.option("compression", "gzip").text(path)
    lines = fl.read_gzip_lines(spark, path)
    mark = F.when(F.col("text").rlike("^#doc [0-9]+$"), F.struct(F.substring("text", 6, 20).cast("bigint").alias("doc_id"), F.col("line_no").alias("at")))
    up = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))
    return lines.withColumn("m", up).where(F.col("line_no") > F.col("m.at")).select(
        "m.doc_id", (F.col("line_no") - F.col("m.at") - 1).alias("line_no"), "text")


@register("S13_sink_csv_index", with_views("""SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_index,
  doc_id, text, label_text FROM sent""", "sent"))
def q_sink_csv_index(spark, sf):
    path = scratch_path(spark, "sent-csv")
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "text", "label_text")
    fl.write_csv_with_index(s, path, ["doc_id"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("`Unnamed: 0`").cast("bigint").alias("row_index"), F.col("doc_id").cast("bigint"),
                       "text", "label_text")


@register("S14_sink_guard", with_views("SELECT doc_id, text, label_text, split FROM sent", "sent"))
def q_sink_guard(spark, sf):
    path = scratch_path(spark, "guarded")
    s = v.sent(v.Tables(spark, sf)).select("doc_id", "text", "label_text", "split")
    fl.guarded_write(s, path)
    return fl.guarded_write(s, path, reuse=True)  # second call reuses the complete result


@register("S16_sink_metrics", with_views("""SELECT 'sentiment' AS run, 'eval' AS phase,
  'perplexity_' || label::VARCHAR AS metric, round(exp(avg(loss)), 6) AS value
  FROM (SELECT label, (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))
        - logits[label + 1] AS loss FROM preds) GROUP BY label""", "preds"))
def q_sink_metrics(spark, sf):
    p = v.preds(v.Tables(spark, sf)).withColumn("loss", mt.cross_entropy("logits", "label"))
    g = p.groupBy("label").agg(F.round(mt.perplexity(F.avg("loss")), 6).alias("value"))
    rows = g.select(F.lit("sentiment").alias("run"), F.lit("eval").alias("phase"),
                    F.concat(F.lit("perplexity_"), F.col("label").cast("string")).alias("metric"), "value")
    return fl.append_metrics(spark, rows, scratch_path(spark, "metrics"))
