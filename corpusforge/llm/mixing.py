"""Operator 1: mixing sources to target weights by entropy balancing, in DataFrame operations only.

A mix takes each document at a rate r. Among all rates that give every source
its target number of words, entropy balancing takes those closest (in relative
entropy) to taking everything once; with a ceiling of 3 this is
r = min(3, exp(lambda_source * size)), and lambda is the root of a monotone
function per source, the gradient of the convex dual. Newton steps solve it,
each one an aggregate over Spark tables; a step that leaves the bracket halves
it instead. Rates depend on (source, size) only, so after one scan of the texts
everything works on that histogram.

Rates become whole copies in two steps: cumulative rounding from the largest
size down keeps the words near the target (the error is below one largest
document), and a second pass adds or takes copies from the smallest sizes up
until the rest is below the next size. Neither leaves the two whole numbers
around a document's rate: a document of rate 0.7 is taken once or not at all,
one of rate 2.2 twice or three times. The copies of a (source, size) group go
to its documents by hash rank, in slices of about 1,000 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch, null_safe_join

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CEILING = 3
ROUNDS = 60
TOLERANCE = 1e-9
SLICE = 1000
_UNIT = 1_000_000  # rates are whole millionths when summed, so that sums do not depend on order


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. All words
    are shared by weight; a target stops at ``ceiling`` times its source's
    size and the excess is reshared, which ends at min(ceiling * size, level *
    weight) for one level. With sources ordered by ceiling / weight the
    stopped ones come first, so the level follows from two running sums. The
    table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place.cast("int"))
    t = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * float(ceiling))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _balance(scratch: Scratch, hist: DataFrame, targets: DataFrame, ceiling: int) -> DataFrame:
    """(source, lam): the dual solution; null where the target is the ceiling itself."""
    scale = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    stopped = (F.col("target") >= F.col("source_size") * (ceiling * (1 - 1e-12))) | (F.col("source_size") == 0)
    state = null_safe_join(targets, scale, ["source"], "left")
    start = F.log(F.col("target") / F.col("source_size"))
    state = state.where("source_size > 0").select(
        "source", "target", "scale", stopped.alias("done"), F.when(~stopped, start).alias("lam"),
        F.lit(-1e4).alias("lo"), F.lit(1e7).alias("hi"),
    )
    state = scratch.keep(state, "dual0")
    for r in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        at = state.where("not done").select("source", "lam", "scale")
        x = F.col("size") / F.col("scale")
        e = F.exp(F.least(F.col("lam") * x, F.lit(10.0)))
        rate = F.least(F.lit(float(ceiling)), e)
        words = F.col("n") * F.col("size")
        slope = F.when(e < ceiling, words * x * e).otherwise(0.0)
        got = null_safe_join(hist, at, ["source"]).groupBy("source").agg(F.sum(words * rate).alias("f"), F.sum(slope).alias("g"))
        both = null_safe_join(state, got, ["source"], "left")
        miss = F.col("f") - F.col("target")
        good = F.col("done") | (F.abs(miss) <= F.col("target") * TOLERANCE + 1e-9) | (F.col("hi") - F.col("lo") < 1e-12)
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        both = both.select("source", "target", "scale", good.alias("done"), "lam", lo.alias("lo"), hi.alias("hi"), miss.alias("miss"), "g")
        newton = F.col("lam") - F.col("miss") / F.col("g")
        inside = (F.col("g") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        # outside the bracket: halve it, or step out while one end is still far away
        half = F.when(F.col("lo") <= -1e4, F.least(F.col("lam") * 2, F.lit(-1.0))).when(F.col("hi") >= 1e7, F.greatest(F.col("lam") * 2, F.lit(1.0)))
        step = F.when(inside, newton).otherwise(F.coalesce(half, (F.col("lo") + F.col("hi")) / 2))
        state = both.select("source", "target", "scale", "done", F.when(F.col("done"), F.col("lam")).otherwise(step).alias("lam"), "lo", "hi")
        state = scratch.keep(state, f"dual{r + 1}")
    return state.select("source", "lam", "scale")


def mix_sources(
    spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING
) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    size counts words; null or empty text has size 0 and is taken 0 times. A
    null source is a source of its own, last in order. Repeated rows are
    documents of their own. Columns of these names in ``docs`` are replaced;
    text stays out of the result, other columns stay. An empty table gives an
    empty table. Ties in rank go by doc_id, so reruns agree.
    """
    scratch = Scratch(spark, "mix")
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in (*added, "text", "source", "doc_id")]
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *kept)
    sizes = scratch.keep(sizes, "sizes")
    hist = scratch.keep(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    total = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = scratch.keep(source_targets(total, weights, ceiling), "targets")
    dual = _balance(scratch, hist, targets, ceiling)

    # copies of each (source, size) group
    plan = null_safe_join(null_safe_join(hist, targets, ["source"]), dual, ["source"], "left")
    rate = F.coalesce(F.least(F.lit(float(ceiling)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(10.0)))), F.lit(float(ceiling)))
    plan = plan.withColumn("unit", F.when(F.col("size") > 0, F.round(rate * _UNIT).cast("long")).otherwise(0))
    plan = plan.withColumn("units", F.col("n") * F.col("unit"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum("units").over(down.rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("upto", upto)
    nearest = lambda c: F.floor((c + _UNIT // 2) / _UNIT)
    plan = plan.withColumn("k", nearest(F.col("upto")) - nearest(F.col("upto") - F.col("units")))
    least, most = F.col("n") * F.floor(F.col("unit") / _UNIT), F.col("n") * F.ceil(F.col("unit") / _UNIT)
    rest = F.col("target") - F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("source"))
    plan = plan.withColumn("rest", F.round(rest).cast("long"))
    room = F.when(F.col("rest") > 0, most - F.col("k")).otherwise(F.col("k") - least) * F.col("size")
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("room", room)
    left = F.least(F.greatest(F.abs("rest") - F.coalesce(F.sum("room").over(up), F.lit(0)), F.lit(0)), F.col("room"))
    more = F.when(F.col("size") > 0, F.floor(left / F.col("size")) * F.signum("rest")).otherwise(0).cast("long")
    plan = plan.withColumn("k", (F.col("k") + more).cast("long"))
    plan = scratch.keep(plan.select("source", "size", "n", "source_size", "target", "k"), "plan")

    # to the documents of a group: all get k div n, the first k mod n by hash rank one more
    rows = null_safe_join(sizes, plan, ["source", "size"])
    slices = F.ceil(F.col("n") / SLICE).cast("long")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(7)), slices))
    dealt = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("k").alias("k"))
    seen = F.sum("m").over(Window.partitionBy("source", "size").orderBy("slice"))
    extra = F.pmod("k", F.col("n"))
    share = F.floor(seen * extra / F.col("n")) - F.floor((seen - F.col("m")) * extra / F.col("n"))
    rows = null_safe_join(rows, dealt.select("source", "size", "slice", share.alias("share")), ["source", "size", "slice"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    copies = (F.floor(F.col("k") / F.col("n")) + (rank <= F.col("share")).cast("long")).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", *kept, "size", "source_size", "target", "copies", "taken")
