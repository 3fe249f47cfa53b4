"""Steps that move each text as few times as the job allows, with the rows they gave before."""

import glob

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.operators import models as md
from corpusforge.operators import pairs as pr
from corpusforge.plans import q_streaming as qs
from corpusforge.plans import views as v
from corpusforge.sources import files as fl

DOCS = [(i, f"text {i}. more\nlines", lang, src) for i, (lang, src) in enumerate((x, s) for s in ("a", "a:1", "5", None) for _ in range(12) for x in v.LANGS)]


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, root, docs=DOCS):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    return v.Tables(spark, str(root))


def test_lines_are_numbered_where_they_lie(spark, tmp_path, no_auto_broadcast):
    (tmp_path / "f.txt").write_text("a\nb\nc\n")
    got = fl.read_line_file(spark, str(tmp_path / "f.txt"))
    assert "SortMergeJoin" not in plan(got)
    assert sorted((r.line_no, r.text) for r in got.collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_zip_shuffles_both_sides_once(spark, no_auto_broadcast):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (1, None), (70, "d")], "line_no long, x string")
    right = spark.createDataFrame([(0, "A", 1), (1, "B", 2), (70, "D", None), (70, "E", 3)], "line_no long, y string, z int")
    got = pr.zip_tables(left, right)
    assert got.columns == ["line_no", "x", "y", "z"] and plan(got).count("Exchange") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(0, "a", "A", 1), (1, "b", "B", 2), (1, None, "B", 2), (70, "d", "D", None), (70, "d", "E", 3)], key=str)
    with pytest.raises(Exception, match="differ in length"):  # a null number has no partner
        pr.zip_tables(left.unionByName(spark.createDataFrame([(None, "n")], left.schema)), right.unionByName(spark.createDataFrame([(None, "N", 0)], right.schema))).collect()


def test_wide_rows_take_one_aggregate(spark, tmp_path):
    t = tables(spark, tmp_path, [*DOCS, (1000, "x", "it", "only"), (1001, "y", None, "none"), (1002, None, "de", "empty")])
    w = v.wide(t)
    assert "pivotfirst" not in plan(w)
    rows = {(r.src, r.row_id): (r.de, r.en, r.es, r.fr) for r in w.collect()}
    assert len(rows) == 4 * 12 + 3 and rows["only", 0] == rows["none", 0] == rows["empty", 0] == (None,) * 4
    assert rows["a", 0] == tuple(f"text {i}. more\nlines" for i in range(4))


@pytest.mark.parametrize("sources", [("a", "a:1", "5", None), ("a", "5")])
def test_drops_are_in_the_order_of_their_keys(spark, tmp_path, sources):
    t = tables(spark, tmp_path, [d for d in DOCS if d[3] in sources])
    folder = str(tmp_path / "drops")
    qs.write_drops(v.dealt_pairs(t, v.wide(t), 7).select(*qs.PAIR5), folder)
    files = sorted(glob.glob(folder + "/part-*"))
    got = [r.pair_id for f in files for r in spark.read.parquet(f).select("pair_id", F.col("_metadata.row_index").alias("k")).orderBy("k").collect()]
    drop = {r.pair_id: r.d for r in spark.createDataFrame([(x,) for x in got], "pair_id string").select("pair_id", F.substring(F.md5("pair_id"), 1, 1).alias("d")).collect()}
    assert len(got) == len(sources) * 12 * 12 and got == sorted(got, key=lambda x: ((drop[x] >= "6") + (drop[x] >= "b"), x))
    times = [r.t for r in spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().orderBy("f").collect()]
    assert times == sorted(set(times))


def test_aligned_files_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("s", "dev", f"{i:03d}", "en", "fr", f"x\n{i}", None, "d") for i in range(150)],
                                 "subset string, split string, k string, source_lang string, target_lang string, source_text string, target_text string, data_source string")
    fl.write_aligned(rows, str(tmp_path / "r"), order="k")
    assert glob.glob(str(tmp_path / "r") + "/kind=src/*/*/*.gz")
    got, _ = fl.read_aligned(spark, str(tmp_path / "r"), layout="partitioned")
    assert sorted((r.line_no, r.source_text, r.target_text, r.source_lang, r.target_lang) for r in got.collect()) == [(i, f"x {i}", "", "en", "fr") for i in range(150)]


def test_first_sentences(spark):
    texts = ["", None, "...", "a", "a. b! c?", " .x\n\n?y..z", "one\ntwo\nthree", "?!a.b", "a\r\n b", "é. ü", "a... b. c"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for k in (1, 2):
        got = df.select(tx.sentences_head("text", k).alias("h"), F.slice(tx.sentences("text"), 1, k).alias("w")).collect()
        assert [r.h for r in got] == [r.w for r in got]


def test_pair_tokens_are_cut_once(spark):
    df = spark.createDataFrame([("a b a", "b c"), (None, "x"), ("", None)], "premise string, hypothesis string")
    got = md.pair_buckets(md.pair_features(md.pair_words(df)))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert got.columns == ["premise", "hypothesis", "overlap", "jaccard", "len_ratio", "_buckets"]
    apart = md.pair_buckets(md.pair_features(df))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in apart.collect()]
    assert got.first().overlap == 1.0 and got.first().len_ratio == 2 / 3
