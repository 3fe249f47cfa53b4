"""Intermediate tables in the shared checkpoint folder, and connected components over an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import scratch_path, shuffles_cleaned


class Scratch:
    """Tables written by one operator call. ``keep`` cuts lineage; ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back; the shuffle files behind it go with the end of the write, as the table is all that is read."""
        path = scratch_path(self.spark, f"{self.name}-{label}")
        with shuffles_cleaned(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads. Without a JVM gateway they stay."""
        jvm = getattr(self.spark, "_jvm", None)
        if jvm is None:
            return
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the key columns are those of the left side."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return left.join(right, same, how).drop(*[f"__{c}" for c in on])


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): random contraction.

    Each round every node points to the neighbour (or itself) with the smallest
    hash of that round; edges are rewritten to the pointed-to nodes and loops
    and repeats go. The number of edges falls by a constant factor per round
    whatever the shape of the graph, hot nodes only meet partial aggregates,
    and nothing is collected.
    """
    live = scratch.keep(edges.where("a <> b").distinct(), "edges0")
    label, r = scratch.keep(live.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), "label"), 0
    first = True
    while not live.isEmpty():
        if r >= max_rounds:
            raise RuntimeError("contraction did not end")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(r)).alias("h"), F.col("a").alias("v"))
        near = F.struct(F.xxhash64(F.col("b"), F.lit(r)).alias("h"), F.col("b").alias("v"))
        point = both.groupBy("a").agg(F.min(F.least(own, near)).alias("m")).select("a", F.col("m.v").alias("to"))
        point = scratch.keep(point, f"point{r}")
        if first:
            after = point.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            step = point.select(F.col("a").alias("root"), "to")
            after = label.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        after, first = scratch.keep(after, f"label{r}"), False
        scratch.drop(label)
        label = after
        pa_, pb_ = point.withColumnsRenamed({"to": "a2"}), point.withColumnsRenamed({"a": "b", "to": "b2"})
        rest = live.join(pa_, "a").join(pb_, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        rest = scratch.keep(rest.where("a <> b").distinct(), f"edges{r + 1}")
        scratch.drop(live, point)
        live, r = rest, r + 1
    scratch.drop(live)
    return label
