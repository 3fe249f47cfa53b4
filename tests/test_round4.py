"""Findings of round 4: plans that must not grow back, and results at the edges the old plans missed or paid for."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.llm import ngram_join
from corpusforge.llm.tables import Scratch
from corpusforge.operators import tokens as tk
from corpusforge.plans import q_sources as qso
from corpusforge.plans import q_streaming as qs
from corpusforge.plans import q_text as qt
from corpusforge.plans import views as v
from corpusforge.session import CLEAN_SHUFFLES
from corpusforge.sources import files as fl

SF = "/root/testdata/sf0.001"


def test_completion_labels_read_ids_once(spark):
    """Padding is not worked out anew for every position of a row without a marker; tokens are cut once."""
    plan = qt.q_labels_completion(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    labels = plan.splitlines()[0]
    assert not re.search(r"lambdafunction\(.*\bsize\(", labels)
    assert plan.count(",254}+, 0)") == 1
    # a pair without a text has no prompt, and so no marker: all its labels are ignored
    rows = [r for r in qt.q_labels_completion(spark, SF).collect() if r.marker_missing]
    assert rows and all(set(r.labels.split(" ")) == {"-100"} for r in rows)


def test_csv_records_of_batches_cut_anywhere():
    """Records are the same wherever Arrow cuts the lines; a text with line ends is joined without a loop over its lines."""
    lines = ["id,text", '1,"a', "", 'b ""x"" c"', "2,plain", '3,"open', "4,still in 3", '"', "5,é", '6,"never closed', "last"]
    want = [(-1 + i, x, True) for i, x in enumerate(["head of a record", "id,text", '1,"a\n\nb ""x"" c"', "2,plain", '3,"open\n4,still in 3\n"', "5,é"])]
    want.append((5, '6,"never closed\nlast', False))
    rows = [("f", 7, 1, x.count('"'), x) for x in ['head of a record', *lines]]
    rows[0] = ("f", 7, 1, 1, "head of a record")  # its closing quote ends a record begun in the block before
    rows += [("g", 0, 0, 0, "x"), ("g", 0, 0, 2, '"y"')]
    kinds = {"file": pa.string(), "block": pa.int64(), "odd": pa.int64(), "q": pa.int32(), "value": pa.string()}
    for step in (1, 2, 3, 5, len(rows)):
        cut = [rows[i:i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds.values())], list(kinds)) for part in cut]
        got = [tuple(r.values()) for b in fl._block_records(iter(batches)) for r in b.to_pylist()]
        assert [r[2:] for r in got if r[:2] == ("f", 7)] == want
        assert [r[2:] for r in got if r[:2] == ("g", 0)] == [(0, "x", True), (1, '"y"', True)]
        starts = [tuple(r.values()) for b in fl._block_starts(iter([x.select(["file", "block", "q"]) for x in batches])) for r in b.to_pylist()]
        even = sum(sum(r[3] for r in rows[:i]) % 2 == 0 for i in range(12))
        assert starts == [("f", 7, sum(r[3] for r in rows[:12]), 12, even), ("g", 0, 2, 2, 2)]
    plain = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[("f", 0, 0, 0, f"line {i}") for i in range(9)]), kinds.values())], list(kinds))
    out = [b for b in fl._block_records(iter([plain])) if b.num_rows]
    assert len(out) == 1 and out[0].column(3).buffers()[2].address == plain.column(4).buffers()[2].address  # lines that are records are not copied


def test_long_heads_need_no_stack(spark):
    """The span of a thousand tokens is found on a thread with little stack; heads are those of the whole extraction."""
    jvm = spark._jvm
    matcher = jvm.java.util.regex.Pattern.compile(tx.head_span_re(1000)).matcher("a, b\n" * 1000)
    assert matcher.find() and matcher.end() == 5 * 333 + 1
    loop = matcher.pattern().toString()
    assert loop.endswith("{0,1000}+")
    texts = ["", None, "  ", "one", "a b  c", "x,y;z\n" * 700, " é1 _ü" * 400, "end "]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for k in (0, 1, 2, 254, 1022):
        got = df.select(tx.tokens_head("text", k).alias("h"), F.slice(tx.tokens("text"), 1, k).alias("w")).collect()
        assert [r.h for r in got] == [r.w for r in got]


def test_json_drops_are_packed_and_leave_no_shuffle(spark, tmp_path, monkeypatch):
    """What a query writes for its source is packed, and the shuffle behind a written table goes with the write."""
    at = []
    monkeypatch.setattr(qso, "scratch_path", lambda s, name: at.append(str(tmp_path / f"{name}{len(at)}")) or at[-1])
    assert qso.q_src_by_extension(spark, SF).count() == qso.q_src_validation_only(spark, SF).count() > 0
    files = [f for a in at for f in os.listdir(a + ".json") if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    seen = []
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, **k: seen.append(self._spark.conf.get(CLEAN_SHUFFLES)) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        tk.materialize(spark.range(1))
    assert seen == ["true"] and spark.conf.get(CLEAN_SHUFFLES, "false") == "false"


def test_corpus_build_keeps_its_result_alone(spark, monkeypatch):
    """Tables and files that only the build reads are gone when it is done, and aligned lines are kept nowhere."""
    at, dropped = {}, []
    make, drop = qso.scratch_path, qso.drop_scratch
    monkeypatch.setattr(qso, "scratch_path", lambda s, name: at.setdefault(name, make(s, name)))
    monkeypatch.setattr(qso, "drop_scratch", lambda s, *paths: dropped.extend(paths) or drop(s, *paths))
    out = qso.q_corpus_build(spark, SF)
    assert {at["build-aligned"], at["build-wide"], at["build-lexicon"]} <= set(dropped) and at["build-out"] not in dropped
    assert not any(os.listdir(at[x]) for x in ("build-aligned", "build-wide", "build-lexicon") if os.path.isdir(at[x]))
    assert out.count() > 0


def test_few_unknown_words_do_not_move_the_vocabulary(spark):
    """Few tokens beyond the sent part are sent to the rest of the vocabulary; many are joined. Both give the same."""
    docs = spark.createDataFrame([(i, f"w1 w{i % 50} w{i * 7 % 90} nowhere") for i in range(200)], "doc_id long, text string")
    voc = tk.materialize(spark.createDataFrame([(f"w{i:d}", i + 5) for i in range(60)], "token string, id int"))
    few = tk.encode(docs, ["doc_id"], "text", voc, map_bytes=200)
    sent = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    want = {i: [0, 6] + [x + 5 if x < 60 else 3 for x in (i % 50, i * 7 % 90)] + [3, 2] for i in range(200)}
    assert {r.doc_id: r.ids for r in few.collect()} == want
    old, tk.ASKED_SENT = tk.ASKED_SENT, 0
    try:
        many = tk.encode(docs, ["doc_id"], "text", voc, map_bytes=200)
        assert {r.doc_id: r.ids for r in many.collect()} == want
        assert sent(few) == 1 and sent(many) == 0
    finally:
        tk.ASKED_SENT = old


def test_drops_are_few_files(spark):
    """A stream's files grow with the documents, not with the number of shuffle partitions, and there are no more than the cores can use."""
    t = v.Tables(spark, SF)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert qs.drop_partitions(t) == min(500, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_large_family_is_sent_in_waves(spark, monkeypatch):
    """Texts go to their units in parts whose shuffle files go one after another; the groups are those of one wave."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: 58 - i % 3], f"x{i}"])) for i in range(60)] + [(100 + i, " ".join(f"y{i}z{j}" for j in range(30 + i))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join._waves(0, 0) == 1 and ngram_join._waves(1 << 40, 1 << 40) == 2 and ngram_join._waves(1 << 26, 5) == 1
    want = {tuple(r) for r in ngram_join.near_duplicate_groups(spark, df, 3, 80, block_sets=8).collect()}
    assert len({r[2] for r in want}) == 6
    links = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, x, label: links.append(label) or keep(self, x, label))
    monkeypatch.setattr(ngram_join, "WAVE_TOKENS", 1000)
    assert {tuple(r) for r in ngram_join.near_duplicate_groups(spark, df, 3, 80, block_sets=8).collect()} == want
    assert sum(x.startswith("links") for x in links) > 1
