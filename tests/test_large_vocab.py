"""A vocabulary that the tasks can hold only in part: encoding, decoding and streams give what they give with all of it."""

import pytest

from corpusforge.operators import tokens as tk
from corpusforge.plans import q_streaming as qs
from corpusforge.plans import q_text as qt

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [0, 60, 120, 1 << 20])
def test_part_of_the_vocabulary_in_the_tasks(spark, limit):
    docs = spark.createDataFrame(
        [(1, "a a b zz a c"), (1, "c b a"), (2, ""), (3, None), (None, "zz c c d"), (4, "a a"), (5, "unknown b unknown")], "doc_id long, text string")
    words = [("a", 5), ("b", 6), ("c", 7), ("d", 8)]
    voc = tk.materialize(spark.createDataFrame([*[(x, i) for i, x in enumerate(tk.SPECIALS)], *words], "token string, id int"))
    enc = tk.encode(docs, ["doc_id"], "text", voc, add_specials=False, map_bytes=limit)
    want = {1: [[5, 5, 6, 3, 5, 7], [7, 6, 5]], 2: [[]], 3: [[]], None: [[3, 7, 7, 8]], 4: [[5, 5]], 5: [[3, 6, 3]]}
    got = {}
    for r in enc.collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(x) for k, x in got.items()} == want
    assert sorted(r.text for r in tk.decode(enc, ["doc_id"], "ids", voc, map_bytes=limit).collect()) == sorted(
        ["a a b <unk> a c", "c b a", "", "", "<unk> c c d", "a a", "<unk> b <unk>"])


def test_the_smallest_ids_are_sent(spark):
    voc = tk.materialize(spark.createDataFrame([(f"w{i:02d}", i) for i in range(50)], "token string, id int"))
    sent, rest = tk.vocab_map(voc, 19 * 20)
    assert sent is not None and sorted(r.id for r in rest.collect()) == list(range(20, 50))
    assert tk.vocab_map(voc, 19 * 50)[1] is None


@pytest.mark.parametrize("query", [qs.q_stream_examples, qt.q_tok_decode])
def test_queries_with_a_large_vocabulary(spark, monkeypatch, query):
    want = rows(query(spark, SF))
    monkeypatch.setattr(tk, "MAP_VOCAB_MAX_BYTES", 4000)
    assert rows(query(spark, SF)) == want
