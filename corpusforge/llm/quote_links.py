"""Operator 6: conversations from messages with quotes, by quotation linking.

A message's lines are its own (level 0) or quoted (level = number of leading
``>``). Quoted passages are normalised (marks gone, white space folded, lower
case) and hashed, line by line and as whole runs of one level, and joined to
messages of the same conversation that hold the same passage as their own text.
The join is an as-of step inside a window: each quoted passage finds the latest
earlier message with that passage, so no pairs are made however often a line
recurs. A message replies to the message that holds most of its least deeply
quoted passages (of equals the latest); without a match it goes on from the
message before it.

Replies make a conversation a tree. A message continues the branch of the one it
replies to if it is the first to reply to it, and starts a branch otherwise, so
a branch is a line of talk and carries its first turn as its name. Ordered by
(branch, turn), which ``position`` numbers, branches stand in one piece and
every message comes after the one it replies to; ``depth`` counts the replies
from the conversation's first message. Stretches of turns that each reply to
the one before are one node; between these, branch and depth are found by
pointer doubling, in rounds that grow with the logarithm of the nodes in a row.
Running values over a conversation are taken in slices of turns and carried
over from slice to slice, so a very long conversation isn't one task's work.

Lines inside a code fence (from a line of ``` or ~~~ to the next such line, or
to the end) are never quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch, null_safe_join
from corpusforge.operators.index import range_index

SLICE = 1024  # turns per slice of a conversation

_LEVEL = r"^\s{0,3}(?:>[ \t]?)+"
_FENCE = r"(?md)^([^\S\n]{0,3}(?:`{3,}[^`\n]*|~{3,}[^\n]*))$"
_INSIDE, _CUT = "\x01", "\x02"


def _lines(text: Column) -> Column:
    """Lines of a text; those that look quoted but stand in a code fence begin with ``_INSIDE``. Both marks are taken out of the text first."""
    parts = F.split(F.regexp_replace(F.translate(text, _INSIDE + _CUT, ""), _FENCE, _CUT + "$1"), _CUT, -1)
    inside = lambda s: F.regexp_replace(s, r"(?md)^(?=[^\S\n]{0,3}>)", _INSIDE)
    return F.split(F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, inside(s)).otherwise(s)), ""), "\n", -1)


def _shown(line: Column) -> Column:
    return F.translate(line, _INSIDE, "")


def _normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, level, line) of every line; level 0 is the message's own text."""
    t = messages.select("conv_id", "turn", F.posexplode(_lines(F.coalesce("text", F.lit("")))).alias("pos", "raw"))
    mark = F.regexp_extract("raw", _LEVEL, 0)
    level = F.char_length(F.regexp_replace(mark, "[^>]", ""))
    line = _shown(F.substring(F.col("raw"), F.char_length(mark) + 1, F.lit(2**31 - 1)))
    return t.select("conv_id", "turn", "pos", level.alias("level"), line.alias("line"))


def _passages(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, name): hashes of single lines and of whole runs of one level; one without letter or digit links nothing."""
    single = lines.select("conv_id", "turn", "level", _normal(F.col("line")).alias("p"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("conv_id", "turn", "level").orderBy("pos"))
    whole = lines.withColumn("run", run).groupBy("conv_id", "turn", "level", "run")
    whole = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("p"))
    # own text is also one whole over all its runs, as a reply quotes it without what it quoted itself
    own = lines.where("level = 0").groupBy("conv_id", "turn")
    own = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("p"))
    every = single.unionByName(whole.select("conv_id", "turn", "level", _normal(F.col("p")).alias("p")))
    every = every.unionByName(own.select("conv_id", "turn", F.lit(0).alias("level"), _normal(F.col("p")).alias("p")))
    return every.where(F.col("p").rlike(r"[\p{L}\p{N}]")).select("conv_id", "turn", "level", F.xxhash64("p").alias("name")).distinct()


def quote_parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, quote_turn, matched): the message that a message quotes most."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + _LEVEL)).select("conv_id").distinct()
    there = null_safe_join(messages, quoting, ["conv_id"])
    p = _passages(quoted_lines(there))
    before = Window.partitionBy("conv_id", "name").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = p.withColumn("at", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)).where("level > 0 and at is not null")
    votes = found.groupBy("conv_id", "turn", "level", "at").agg(F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "n", "at"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.at").alias("quote_turn"), F.col("b.n").alias("matched"))


def _carried(df: DataFrame, total, value: str, out: str) -> DataFrame:
    """``total`` (F.max or F.sum) of ``value`` over the conversation's earlier slices."""
    top = df.groupBy("conv_id", "slice").agg(total(value).alias("__v"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select("conv_id", "slice", total("__v").over(earlier).alias(out))
    return null_safe_join(df, top, ["conv_id", "slice"], "left")


def reply_order(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, turn, branch, depth, position) from (conv_id, turn, slice, previous, reply_to).

    Turns are distinct within their conversation, replies go to earlier turns
    of it, only its first turn replies to nothing."""
    starts = F.col("previous").isNull() | (F.col("reply_to") != F.col("previous"))
    t = scratch.keep(turns.withColumns({"starts": F.when(starts, F.col("turn")), "one": F.lit(1).cast("long")}), "replies")
    t = _carried(_carried(t, F.max, "starts", "run0"), F.sum, "one", "at0")
    so_far = Window.partitionBy("conv_id", "slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select(
        "conv_id", "turn", "reply_to", F.coalesce(F.max("starts").over(so_far), F.col("run0")).alias("run"),
        (F.sum("one").over(so_far) + F.coalesce("at0", F.lit(0))).alias("at"),
    )
    t = scratch.keep(t, "runs")
    ends = t.groupBy("conv_id", "run").agg(F.max("turn").alias("end"), F.min("at").alias("first"))
    heads = t.where("turn = run").select("conv_id", "run", F.col("reply_to").alias("turn"))
    earliest = heads.groupBy("conv_id", "turn").agg(F.min("run").alias("earliest"))
    to = null_safe_join(t.select("conv_id", "turn", F.col("run").alias("up"), "at"), earliest, ["conv_id", "turn"])
    to = null_safe_join(to, ends.withColumnRenamed("run", "up"), ["conv_id", "up"])
    goes_on = F.when(F.col("turn") == F.col("end"), F.col("earliest"))  # the run that continues the branch, if one does
    to = to.select("conv_id", "turn", "up", (F.col("at") - F.col("first") + 1).alias("steps"), goes_on.alias("heir"))
    nodes = null_safe_join(heads, to, ["conv_id", "turn"], "left")
    nodes = nodes.select(
        "conv_id", "run", F.coalesce("up", "run").alias("up"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.when(F.col("heir") == F.col("run"), F.col("up")).otherwise(F.col("run")).alias("top"),
    )
    nodes, r = scratch.keep(nodes, "nodes0"), 0
    moving = not nodes.where("up <> run").isEmpty()
    while moving:
        far = nodes.select("conv_id", F.col("run").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        over = nodes.select("conv_id", F.col("run").alias("top"), F.col("top").alias("top2"))
        step = null_safe_join(null_safe_join(nodes, far, ["conv_id", "up"]), over, ["conv_id", "top"])
        moved = (F.col("up2") != F.col("up")) | (F.col("top2") != F.col("top"))
        step = step.select("conv_id", "run", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("top2").alias("top"), moved.alias("moved"))
        r += 1
        step = scratch.keep(step, f"nodes{r}")
        scratch.drop(nodes)
        nodes, moving = step, not step.where("moved").isEmpty()
    node = null_safe_join(nodes, ends, ["conv_id", "run"]).select("conv_id", "run", "steps", "first", F.col("top").alias("branch"))
    out = null_safe_join(t, node, ["conv_id", "run"])
    out = out.select("conv_id", "turn", "branch", (F.col("at") - F.col("first") + F.col("steps")).alias("depth"))
    return range_index(out, ["branch", "turn"], ["conv_id"], "position")


def link_conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, linked_by, matched, branch, depth, position, text, unmatched, formatted), one row per distinct message.

    text is the message without quotes, trimmed; formatted has it between chat
    marks. linked_by is ``quote``, ``previous`` or ``first``. unmatched holds the
    quoted lines, as they stand, of a message none of whose quotes was found
    earlier (else empty), so that no text is lost. Null text counts as empty, a
    null role as ``user``; rows with a null conv_id are one conversation, rows
    with a null turn come first in theirs. Repeated rows become one; rows that
    share a turn but differ are both kept and share their place.
    """
    scratch = Scratch(spark, "quotes")
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    m = scratch.keep(m, "messages")
    turns = m.select("conv_id", "turn").distinct().withColumn("slice", F.floor(F.col("turn") / SLICE))
    turns = _carried(turns, F.max, "turn", "carry")
    last = F.lag("turn").over(Window.partitionBy("conv_id", "slice").orderBy("turn"))
    turns = turns.withColumn("previous", F.coalesce(last, F.col("carry"))).drop("carry")
    turns = null_safe_join(turns, quote_parents(m), ["conv_id", "turn"], "left")
    turns = scratch.keep(turns.withColumn("reply_to", F.coalesce("quote_turn", "previous")), "links")
    order = reply_order(scratch, turns.select("conv_id", "turn", "slice", "previous", "reply_to"))
    how = F.when(F.col("quote_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous").otherwise("first")
    turns = turns.select("conv_id", "turn", "reply_to", how.alias("linked_by"), F.coalesce("matched", F.lit(0)).alias("matched"))
    turns = null_safe_join(turns, order, ["conv_id", "turn"])

    m = m.withColumn("lines", _lines(F.col("text")))
    own = _shown(F.array_join(F.filter("lines", lambda x: ~x.rlike(_LEVEL)), "\n"))
    m = m.withColumns({"text": F.regexp_replace(own, r"^\s+|\s+$", ""), "quoted": F.array_join(F.filter("lines", lambda x: x.rlike(_LEVEL)), "\n")})
    out = null_safe_join(m, turns, ["conv_id", "turn"])
    chat = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    unmatched = F.when(F.col("linked_by") == "quote", "").otherwise(F.col("quoted"))
    return out.select(
        "conv_id", "turn", "role", "reply_to", "linked_by", "matched", "branch", "depth", "position", "text", unmatched.alias("unmatched"), chat.alias("formatted")
    )
