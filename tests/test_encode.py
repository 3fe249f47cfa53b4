"""Vocabulary and encoding against a plain-Python model, on both lookup paths."""

import random
import re
from collections import Counter

import pytest

from corpusforge.functions.rules import BOS_ID, EOS_ID, N_SPECIALS, UNK_ID
from corpusforge.operators import tokens as tk

def py_tokens(text):
    # letters/marks/digits runs or one other non-space char (ASCII-only fixture)
    return re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", text)


@pytest.mark.parametrize("limit", [tk.MAP_VOCAB_MAX_BYTES, 0])  # broadcast path, shuffle-join path
def test_vocab_and_encode_match_python(spark, limit):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "dd", "e", "ff", "g", "hh", ",", ".", "!", "x1", "y2"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    voc = tk.materialize(tk.vocab_build(df))
    counts = Counter(t for _, text in docs for t in py_tokens(text))
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode()))
    want_vocab = {t: N_SPECIALS + i for i, (t, _) in enumerate(ranked)}
    got_vocab = {r.token: r.id for r in voc.collect() if r.id >= N_SPECIALS}
    assert got_vocab == want_vocab
    enc = tk.encode(df, ["doc_id"], "text", voc, max_tokens=10, map_bytes=limit)
    got = {r.doc_id: r.ids for r in enc.collect()}
    for i, text in docs:
        want = [BOS_ID] + [want_vocab.get(t, UNK_ID) for t in py_tokens(text)[:10]] + [EOS_ID]
        assert got[i] == want
    dec = tk.decode(enc, ["doc_id"], "ids", voc, map_bytes=limit)
    for r in dec.collect():
        toks = py_tokens(dict(docs)[r.doc_id])[:10]
        assert r.text == " ".join(["<s>"] + toks + ["</s>"])


def test_stored_vocabulary_is_built_once_per_input(spark, tmp_path):
    path, built = str(tmp_path / "docs"), []

    def build(df):
        built.append(1)
        return tk.vocab_build(df)

    def words():
        return {r.token for r in tk.stored(spark.read.parquet(path), build, "vocab-test", "rule").collect()}

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(path)
    assert {"a", "b"} <= words() and {"a", "b"} <= words() and len(built) == 1
    spark.createDataFrame([(2, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    assert "c" in words() and len(built) == 2  # changed input
    tk.stored(spark.read.parquet(path), build, "vocab-test", "other rule")
    tk.stored(spark.read.parquet(path).where("doc_id > 1"), build, "vocab-test", "rule")
    assert len(built) == 4
    tk.stored(spark.createDataFrame([(1, "a")], "doc_id long, text string"), build, "vocab-test", "rule")
    assert len(built) == 5
