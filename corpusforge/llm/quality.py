"""Operator 8: quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (-1), the last where its measure
lies between its two limits or can't be taken. Nobody knows how reliable the rules
are; expectation-maximisation estimates, for good and for bad documents, how often
each rule votes which way, and the share of good ones. No rate is bounded: a prior
of PRIOR of the rows (and one row more) at the starting rates keeps them off 0 and
1 and good the class that rules seldom vote against, also where a defect is rare.
So a vote against can be outweighed by votes for, and weak votes can add up. Votes
are counted by pattern first, so the iterations run over at most 3**rules rows and
only the model's few numbers come to the driver. A document is kept if its
posterior probability of being good is at least one half and the fixed base rule
has not failed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
ROUNDS = 100  # at most; EM ends when no rate moves by 1e-6
PRIOR = 0.005  # share of the rows that the prior counts as
FLOOR = 0.01  # the estimated share of good rows stays this far from 0 and 1

RULES = ("long_enough", "word_length", "few_symbols", "mostly_letters", "few_copied_lines", "few_repeats", "few_capitals", "line_ends")


def _covered(starts: Column) -> Column:
    """Words covered by windows at the given ordered starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_ended)."""
    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("w", F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)))
    t = t.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    at = F.sequence(F.lit(0), F.size("w") - WINDOW)
    t = t.withColumn(
        "h",
        F.when(F.size("w") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>")),
    )
    # windows that occur again: neighbours in the order of their names; each array is a column of its own, as a
    # lambda would compute what it refers to once per element
    t = t.withColumn("o", F.sort_array("h"))
    again = F.exists(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.get("o", i) == F.get("o", i - 1))
    t = t.withColumn("p", F.when((F.size("o") > 1) & again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.get("p", i - 1)["h"].eqNullSafe(x["h"]) | F.get("p", i + 1)["h"].eqNullSafe(x["h"])
    t = t.withColumn("starts", F.sort_array(F.transform(F.filter("p", same), lambda x: x["i"])))
    length = lambda c: F.char_length(c).cast("long")
    return t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        length(F.translate("t", SPACES, "")).alias("word_chars"),
        (length(F.col("t")) - length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.size(F.filter("lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", ":", '"', ";"))).cast("long").alias("n_ended"),
    )


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), -1).when(bad, 0).when(good, 1).otherwise(-1)


def votes(c: DataFrame) -> DataFrame:
    """``c`` with one column per rule. Without words only ``long_enough`` votes; rules about lines need five of them to vote against."""
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    mean, symbols, letters = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_letters", "word_chars")
    copied, ended = share("n_dup_lines", "n_lines"), share("n_ended", "n_lines")
    repeats, upper = share("n_repeat_words", "n_words"), share("n_upper", "n_letters")
    n, lines = F.col("n_words"), F.col("n_lines") >= 5
    rules = {
        "long_enough": _vote(n, n >= 2 * MIN_WORDS, n < MIN_WORDS),
        "word_length": _vote(mean, mean.between(4, 8), (mean < 3) | (mean > 10)),
        "few_symbols": _vote(symbols, symbols <= 0.02, symbols > 0.1),
        "mostly_letters": _vote(letters, letters >= 0.9, letters < 0.75),
        "few_copied_lines": _vote(copied, copied <= 0.1, (copied > 0.3) & lines),
        "few_repeats": _vote(repeats, repeats <= 0.2, repeats > 0.5),
        "few_capitals": _vote(upper, upper <= 0.2, upper > 0.5),
        "line_ends": _vote(ended, ended > 0.6, (ended < 0.1) & lines),
    }
    return c.withColumns(rules)


def posterior(model: dict) -> Column:
    """Probability of good given the votes, under the estimated model."""
    odds = F.lit(0.0) + F.log(F.lit(model["good"] / (1 - model["good"])))
    for r in RULES:
        good, bad = model[r]
        for vote in (1, 0, -1):
            odds += F.when(F.col(r) == vote, F.log(F.lit(good[vote] / bad[vote]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


#: where EM starts and what its prior rows vote, for good and for bad documents
START = ({1: 0.85, 0: 0.03, -1: 0.12}, {1: 0.4, 0: 0.35, -1: 0.25})
GOOD = 0.8  # the share of good rows at the start


def fit_votes(patterns: DataFrame) -> dict:
    """EM over (rules..., n): the share of good rows and, per rule and class, how often it votes 1, 0 or abstains."""
    model = {"good": GOOD} | {r: START for r in RULES}
    for _ in range(ROUNDS):
        p = patterns.withColumn("p", posterior(model))
        weight = {"g": F.col("n") * F.col("p"), "b": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum("n").alias("n"), F.sum(weight["g"]).alias("good")]
        sums += [F.sum(F.when(F.col(r) == v, w)).alias(f"{r}{v}{c}") for r in RULES for v in (1, 0, -1) for c, w in weight.items()]
        s = p.agg(*sums).first()
        if not s["n"]:
            break
        new = {"good": min(max(s["good"] / s["n"], FLOOR), 1 - FLOOR)}
        for r in RULES:
            prior = 1 + PRIOR * s["n"]
            got = [{v: (s[f"{r}{v}{c}"] or 0.0) + prior * start[v] for v in (1, 0, -1)} for c, start in zip("gb", START)]
            new[r] = tuple({v: x / sum(g.values()) for v, x in g.items()} for g in got)
        moved = max(abs(new["good"] - model["good"]), *(abs(new[r][k][v] - model[r][k][v]) for r in RULES for k in (0, 1) for v in (1, 0)))
        model = new
        if moved < 1e-6:
            break
    return model


def judge_quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, votes, p_good, base_failed and kept.

    Null text counts as empty: no words, base_failed. base_failed: fewer than
    50 words, or more than half of them in repeated 3-word windows. An empty
    table gives an empty table. Only doc_id and text are read.
    """
    scratch = Scratch(spark, "quality")
    cast = scratch.keep(votes(text_counts(docs)), "votes")
    patterns = scratch.keep(cast.groupBy(*RULES).agg(F.count("*").alias("n")), "patterns")
    model = fit_votes(patterns.coalesce(1))
    out = cast.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("p_good", F.round(posterior(model), 6))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
