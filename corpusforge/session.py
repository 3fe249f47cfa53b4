"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cores: int | str = "*", app: str = "corpusforge", memory: str = "16g") -> SparkSession:
    """Local session for tests and benches; on a cluster use the provided session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small shuffles here feed heavy per-row text work (regex, explode x12):
        # do not merge them below 64 KB per task (no effect on large inputs)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # one small file feeds all cores of a local session (see plans.views.spread)
        .config("corpusforge.spreadPartitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}  # application id -> our own folder, for local sessions without the setting


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it, as executors and driver share no local folder;
    only a local session without the setting gets one of our own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.conf.get("spark.app.id", "local")
        path = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="corpusforge-ckpt-")
        _own[app] = path
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # sessions without a local SparkContext use the conf alone
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


#: Spark's setting that removes a query's shuffle files once the query has ended
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: the written table is all that is read later."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders of ``scratch_path`` that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
