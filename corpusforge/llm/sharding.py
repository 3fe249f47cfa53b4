"""Operator 11: shards of near equal bytes through fixed virtual slots, in DataFrame operations only.

Records are hashed into ``SLOTS`` virtual slots; that hash never changes. Which
shard holds a slot is said by a small map (one row per slot), stored as one
immutable folder per version. Version 0 deals slots out in turn. Rebalancing
edits the map: bytes are summed per slot, every shard above the mean gives up
its smallest slots until it is not above it any more, and the given-up slots go,
largest first, each to the shard with the fewest bytes. All other slots, and so
most records, stay where they are. Adding shards is the same edit with new
shards that hold nothing yet.

The map and the sums have one row per slot whatever the size of the corpus;
only they meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch
from corpusforge.session import scratch_path

SLOTS = 8192
SHARDS = 40
#: bytes of a record besides its text
OVERHEAD = 16
#: equal records are dealt to slots in blocks of so many
BLOCK = 256


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record key."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, shard): version 0, slots dealt out in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map; an existing version is never changed (the write fails)."""
    at = f"{path}/v{version}"
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("errorifexists").parquet(at)
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/v{version}")


def rebalanced(slot_map: DataFrame, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited for ``weights`` (virtual_slot, bytes) over shards 0 to ``shards`` - 1.

    Slots without a weight weigh nothing and stay. Slots of shards that are no
    more (>= ``shards``) are given up whole. Ties go by slot and shard number.
    """
    t = slot_map.join(weights.select("virtual_slot", "bytes"), "virtual_slot", "left")
    t = t.select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    own = Window.partitionBy("shard")
    upto = F.sum("bytes").over(own.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    # given up, smallest first, while what is left of the shard is above the mean
    left = F.sum("bytes").over(own) - F.coalesce(upto, F.lit(0))
    gone = (F.col("shard") >= shards) | ((F.col("bytes") > 0) & (left > mean))
    t = t.withColumn("moves", gone)
    slot = F.struct((-F.col("bytes")).alias("order"), F.col("virtual_slot"))
    one = t.agg(
        F.sort_array(F.collect_list(F.when(F.col("moves"), slot))).alias("moving"),
        F.collect_list(F.when(~F.col("moves"), F.struct("shard", "bytes"))).alias("staying"),
    )
    loads = F.aggregate(
        "staying",
        F.array_repeat(F.lit(0).cast("long"), shards),
        lambda acc, s: F.transform(acc, lambda x, i: x + F.when(i == s["shard"], s["bytes"]).otherwise(0)),
    )
    one = one.select("moving", loads.alias("loads"))

    def place(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        put = F.transform(F.array(to), lambda k: F.struct(  # one element: ``k`` is worked out once
            F.transform(acc["loads"], lambda x, i: F.when(i == k, x - slot["order"]).otherwise(x)).alias("loads"),
            F.concat(acc["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), k.alias("shard")))).alias("placed"),
        ))
        return put[0]

    start = F.struct(F.col("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("placed"))
    placed = one.select(F.explode(F.aggregate("moving", start, place)["placed"]).alias("p")).select("p.virtual_slot", "p.shard")
    return t.where("not moves").select("virtual_slot", "shard").unionByName(placed)


def shard_records(
    spark: SparkSession, docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS,
    map_path: str | None = None, version: int | None = None,
) -> DataFrame:
    """Rows of ``docs`` (text left out) with size, text_crc32, virtual_slot, shard, slot and map_version.

    size is the UTF-8 bytes of the text (null: none) plus 16; slot is the row's
    place in its shard, gapless from 0. Without ``version`` a map is begun
    under ``map_path`` (a new folder of the scratch space if none is given) as
    version 0 and its edit for this corpus stored as version 1; with it, that
    version under ``map_path`` is edited and stored as the next one.

    A null doc_id is a value like others. Rows that agree in all columns are
    counted, dealt to slots in blocks of 256 and written out again, so no key
    is too frequent for a slot. Columns of the added names are replaced;
    others are kept and must be comparable. An empty table gives an empty one.
    """
    scratch = Scratch(spark, "shards")
    added = ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version", "text")
    keys = ["doc_id", "size", "text_crc32", *[c for c in docs.columns if c not in (*added, "doc_id")]]
    body = utf8(F.col("text"))
    rows = docs.drop(*[c for c in added if c != "text"]).withColumns(
        {"size": F.octet_length(body).cast("long") + OVERHEAD, "text_crc32": F.crc32(body)}
    )
    rows = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    # blocks of equal records; __m rows each
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK)))
    rows = rows.withColumn("__block", block)
    rows = rows.withColumn("__m", F.least(F.col("__n") - F.col("__block") * BLOCK, F.lit(BLOCK)))
    rows = rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("__block"), slots=slots)).drop("__n")
    rows = scratch.keep(rows, "records")

    weights = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("__m")).alias("bytes"), F.sum("__m").alias("rows"))
    weights = scratch.keep(weights, "weights")
    path = map_path or scratch_path(spark, "slot-map")
    if version is None:
        version, current = 0, save_map(first_map(spark, shards, slots), path, 0)
    else:
        current = load_map(spark, path, version)
    current = save_map(rebalanced(current, weights, shards), path, version + 1)

    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = weights.join(current, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(offsets), "virtual_slot")  # one row per slot
    at = Window.partitionBy("virtual_slot").orderBy(*keys, "__block").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__m").over(at), F.lit(0)))
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))
    return out.select(*keys, "virtual_slot", "shard", (F.col("__before") + F.col("__i")).cast("long").alias("slot"), F.lit(version + 1).alias("map_version"))
