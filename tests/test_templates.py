"""T14-T19 column functions against plain-Python definitions."""

import pytest

from corpusforge.functions import text as tx
from corpusforge.operators import templates as tp


@pytest.mark.parametrize("name", ["malaysian_malay", "north maluku malay", "o'brien-x2y", "ENGLISH", "zsm_Latn"])
def test_lang_display_matches_python_title(spark, name):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(tx.lang_display("n")).first()[0] == name.replace("_", " ").title()


def test_strip_newlines(spark):
    df = spark.createDataFrame([("a\nb\n",)], "t string")
    assert df.select(tx.strip_newlines("t")).first()[0] == "ab"


def test_chat_trim(spark):
    df = spark.createDataFrame([("hi", "yo")], "u string, a string")
    msgs = tp.translation_messages("u", "a", "u", "a")
    full = df.select(tp.render_chat(msgs, trim_chars=0)).first()[0]
    cut = df.select(tp.render_chat(msgs)).first()[0]
    assert full.endswith(tp.CHAT_END + "\n") and cut == full[:-2]


def test_instruction_template_ends_once_with_eos(spark):
    df = spark.createDataFrame([("A", "B", "x\ny", "z\n")], "s string, t string, a string, b string")
    p = df.select(tp.template_instruction("s", "t", "a", "b")).first()[0]
    assert p.endswith("z</s>") and p.count("</s>") == 1 and "\nxy\n" in p
    assert tp.RESPONSE_HEADER in p


def test_sections_template_keeps_newlines(spark):
    df = spark.createDataFrame([("A", "B", "x\ny", "z")], "s string, t string, a string, b string")
    p = df.select(tp.template_sections("s", "t", "a", "b")).first()[0]
    assert "x\ny" in p and p.endswith("z </s>")


def test_truncate_budget(spark):
    df = spark.createDataFrame([("one, two three.",)], "t string")
    assert df.select(tx.truncate_tokens("t", 3)).first()[0] == "one , two"


@pytest.mark.parametrize("k", [1, 2, 5, 88, 2000])
@pytest.mark.parametrize("fast", [False, True])
def test_tokens_head_equals_sliced_tokens(spark, k, fast):
    from pyspark.sql import functions as F

    rows = [("  a,,b  c\t\n d!!e",), ("",), ("   ",), (None,), ("ÉtÉ naïve — x1y2 , .",), ("w " * 3000,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(tx.tokens_head("t", k, fast).alias("h"), F.slice(tx.tokens("t", fast), 1, k).alias("s")).collect()
    assert all(r.h == r.s for r in got)


def test_zip_arrays_equal_and_unequal(spark):
    from corpusforge.operators.pairs import zip_arrays

    ok = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(r) for r in ok.select(zip_arrays("x", "y")).first()[0]] == [(1, "a"), (2, "b")]
    bad = spark.createDataFrame([([1, 2], ["a"])], "x array<int>, y array<string>")
    with pytest.raises(Exception):
        bad.select(zip_arrays("x", "y")).collect()
