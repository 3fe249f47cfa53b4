"""T18, T20, T21 labels and A02-A06 metrics: edge cases from the reference's guards."""

import hashlib
import math

from pyspark.sql import functions as F

from corpusforge.functions.rules import IGNORE_INDEX, MASK_ID, PAD_ID
from corpusforge.operators import labels as lb
from corpusforge.operators import metrics as mt
from corpusforge.operators import templates as tp


def test_completion_only_marker_last_occurrence(spark):
    toks = ["<s>", "a", "#", "#", "#", "Response", ":", "b", "#", "#", "#", "Response", ":", "c", "</s>", "<pad>"]
    ids = list(range(10, 10 + len(toks) - 1)) + [PAD_ID]
    df = spark.createDataFrame([(ids, toks)], "ids array<int>, toks array<string>")
    out = df.select(lb.labels_completion_only("ids", "toks", tp.RESPONSE_MARKER).alias("l")).first().l
    # everything up to the end of the second marker (position 13) is ignored, and the pad
    assert out[:13] == [IGNORE_INDEX] * 13
    assert out[13:15] == ids[13:15]
    assert out[15] == IGNORE_INDEX


def test_completion_only_marker_missing_all_ignored(spark):
    df = spark.createDataFrame([([5, 6, 7], ["a", "b", "c"])], "ids array<int>, toks array<string>")
    out = df.select(lb.labels_completion_only("ids", "toks", tp.RESPONSE_MARKER).alias("l")).first().l
    assert out == [IGNORE_INDEX] * 3


def test_labels_copy_keeps_pads_by_default(spark):
    df = spark.createDataFrame([([0, 9, 2, PAD_ID],)], "ids array<int>")
    assert df.select(lb.labels_copy("ids")).first()[0] == [0, 9, 2, PAD_ID]
    assert df.select(lb.labels_copy("ids", ignore_pad=True)).first()[0] == [0, 9, 2, IGNORE_INDEX]


def test_mask_rate_and_specials(spark):
    n_rows, length = 300, 200
    rows = [(i, [0] + [5 + (i * 7 + j) % 900 for j in range(length - 2)] + [2]) for i in range(n_rows)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    masked, labels = lb.mask_mlm("ids", "k", F.lit(0), F.lit(0), 1000)
    out = df.select("ids", masked.alias("m"), labels.alias("y")).collect()
    picked = sum(sum(1 for y in r.y if y != IGNORE_INDEX) for r in out)
    rate = picked / (n_rows * (length - 2))
    assert abs(rate - 0.15) < 0.01
    for r in out:
        assert r.y[0] == IGNORE_INDEX and r.y[-1] == IGNORE_INDEX and r.m[0] == 0 and r.m[-1] == 2
    n_mask = sum(sum(1 for m, y in zip(r.m, r.y) if y != IGNORE_INDEX and m == MASK_ID) for r in out)
    assert 0.75 < n_mask / picked < 0.85


def test_mask_differs_per_copy(spark):
    df = spark.createDataFrame([(1, list(range(5, 400)))], "k long, ids array<int>")
    a = df.select(lb.mask_mlm("ids", "k", F.lit(0), F.lit(0), 1000)[1]).first()[0]
    b = df.select(lb.mask_mlm("ids", "k", F.lit(1), F.lit(0), 1000)[1]).first()[0]
    assert a != b


def test_masked_accuracy_zero_guard(spark):
    df = spark.createDataFrame([([1, 2], [IGNORE_INDEX, IGNORE_INDEX])], "p array<int>, y array<int>")
    c, t = mt.masked_counts("p", "y")
    r = df.select(c.alias("c"), t.alias("t")).first()
    assert (r.c, r.t) == (0, 0)
    assert df.select(mt.masked_accuracy(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_perplexity_overflow_is_infinity(spark):
    df = spark.createDataFrame([(1000.0,)], "loss double")
    assert math.isinf(df.select(mt.perplexity("loss")).first()[0])


def test_cross_entropy_is_shift_stable(spark):
    df = spark.createDataFrame([([1000.0, 999.0, 998.0], 0)], "s array<double>, y int")
    v = df.select(mt.cross_entropy("s", "y")).first()[0]
    ref = -(1000.0 - (1000.0 + math.log(1 + math.exp(-1) + math.exp(-2))))
    assert abs(v - ref) < 1e-9


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert df.select(mt.argmax("s")).first()[0] == 1


def test_accum_factor_error():
    import pytest

    from corpusforge.operators.batches import accum_factor

    assert accum_factor(2048, 32) == 8 and accum_factor(2048, 16) == 16
    with pytest.raises(ValueError):
        accum_factor(2048, 512)


def test_pair_encode_reject_boundary(spark):
    from corpusforge.operators.tokens import pair_encode_only_first

    df = spark.createDataFrame([(list(range(5, 305)), list(range(5, 5 + h))) for h in (10, 252, 253)],
                               "p array<int>, h array<int>")
    out = [r[0] for r in df.select(pair_encode_only_first("p", "h", 256)).collect()]
    assert len(out[0]) == 256 and out[0][1:243] == list(range(5, 247))  # premise cut to 256-4-10
    assert len(out[1]) == 256 and out[1][:3] == [0, 2, 2]  # no room left for the premise
    assert out[2] is None  # hypothesis alone too long: rejected


def test_count_store_merges_a_phase_once(spark, tmp_path):
    from corpusforge.operators import models as md

    df = lambda rows: spark.createDataFrame(rows, "a int, b int, count bigint")
    store = md.CountStore(spark, str(tmp_path / "counts"))
    assert store.version() == 0 and store.phases() == []
    store.merge("one", df([(1, 2, 3), (1, None, 1)]))
    store.merge("two", df([(1, 2, 4), (2, 2, 1)]))
    before = store.read(1)
    for _ in range(2):
        assert store.merge("one", df([(9, 9, 9)])) == 2 and store.merge("two", df([(9, 9, 9)])) == 2
    assert {tuple(r) for r in store.read().collect()} == {(1, 2, 7), (1, None, 1), (2, 2, 1)}
    assert {tuple(r) for r in before.collect()} == {(1, 2, 3), (1, None, 1)} and store.phases() == ["one", "two"]
    # a merge that died before its marker is no version, and is done again whole
    df([(5, 5, 5)]).write.parquet(str(tmp_path / "counts" / "v3" / "counts"))
    assert store.version() == 2 and store.merge("three", df([(2, 2, 1)])) == 3
    assert {tuple(r) for r in store.read().collect()} == {(1, 2, 7), (1, None, 1), (2, 2, 2)}


def test_gloss_by_map_and_by_join_agree(spark):
    from corpusforge.operators import models as md

    docs = spark.createDataFrame([(1, "de", "ja nein, ja"), (2, "fr", "ja oui"), (3, "de", ""), (4, "de", None)], "doc_id long, lang string, text string")
    lex = spark.createDataFrame([("de", "ja", "yes"), ("fr", "oui", "yes"), ("de", "nein", "no")], "lang string, trg_word string, src_word string")
    small, large = (sorted(tuple(r) for r in md.lexicon_gloss(docs, lex, map_bytes=b).collect()) for b in (1 << 20, 0))
    assert small == large == [(1, "de", "yes no , yes", 4, 3), (2, "fr", "ja yes", 2, 1), (3, "de", "", 0, 0), (4, "de", "", 0, 0)]


def test_dictionary_is_sent_along_only_if_small(spark, monkeypatch):
    from corpusforge.operators import pairs as pr

    p = spark.createDataFrame([("de", "en"), ("de", "xx")], "source_lang string, target_lang string")
    d = pr.lang_table(spark, {"de": "german", "en": "english"})
    for most in (100, 1):
        monkeypatch.setattr(pr, "DICTIONARY_MAX", most)
        got = pr.lookup_lang_name(pr.filter_lang_allowlist(p, d), d)
        assert [tuple(r) for r in got.collect()] == [("german", "english")]


def test_every_masked_position_has_a_digest_of_its_own(spark):
    ids = [0, *range(5, 60), 2, 1]
    df = spark.createDataFrame([(7, ids)], "k long, ids array<int>").withColumn("d", lb.position_draws("ids", "k", F.lit(2), F.lit(0)))
    m, y = lb.apply_position_mask("ids", "d", 1000)
    r = df.select("d", m.alias("m"), y.alias("y")).first()
    for i, x in enumerate(ids):
        h = hashlib.md5(f"7#2#0#{i}".encode()).hexdigest()
        picked = x >= 5 and h[:8] < "26666666"
        new = x if not picked or h[8:16] >= "e6666666" else 4 if h[8:16] < "cccccccc" else int(h[16:24], 16) % 995 + 5
        assert (r.d[i], r.y[i], r.m[i]) == (h if x >= 5 else None, x if picked else IGNORE_INDEX, new)


def test_draws_of_any_length_and_key_equal_hashlib(spark):
    """Long messages, numbers of several widths, pads, empty lists and null keys; a whole batch is drawn at once, with no expression a position."""
    keys = ["k", "é" * 30, None, "x" * 60, "5"]
    rows = [(k, [0, *range(5, 5 + 230 * j), 2, 1]) for j, k in enumerate(keys)] + [("none", [])]
    df = spark.createDataFrame(rows, "k string, ids array<int>")
    d = df.withColumn("d", lb.position_draws("ids", "k", F.lit(3), F.lit(1)))
    assert "transform(" not in d._jdf.queryExecution().toString()
    m, y = lb.apply_position_mask("ids", "d", 1000)
    at_once = lb.apply_position_mask("ids", lb.position_draws("ids", "k", F.lit(3), F.lit(1)), 1000)
    both = d.select(m.alias("m"), y.alias("y"), at_once[0].alias("m1"), at_once[1].alias("y1"))
    assert both.where("m <=> m1 and y <=> y1").count() == len(rows)
    got = lb.mask_totals(d.select("k", "ids", "d", m.alias("m"), y.alias("y")), ["k", "ids", "d", "m", "y"], "m", "y").collect()
    table = lb.apply_position_mask("ids", lb.position_draws("ids", "k", F.lit(3), F.lit(1)), 1000, rows=df, keep=["k"])
    assert sorted(table.collect(), key=str) == sorted(d.select("k", m.alias("new"), y.alias("lab")).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        want = [hashlib.md5("#".join([*([] if r.k is None else [r.k]), "3", "1", str(i)]).encode()).hexdigest() if x >= 5 else None for i, x in enumerate(r.ids)]
        assert r.d == want
        picked = [h is not None and h[:8] < "26666666" for h in want]
        assert r.y == [x if p else IGNORE_INDEX for x, p in zip(r.ids, picked)]
        assert r.m == [x if not p or h[8:16] >= "e6666666" else 4 if h[8:16] < "cccccccc" else int(h[16:24], 16) % 995 + 5 for x, p, h in zip(r.ids, picked, want)]
        assert tuple(r[5:]) == (sum(picked), sum(p and x == 4 for p, x in zip(picked, r.m)), sum(r.m), sum(r.y))
