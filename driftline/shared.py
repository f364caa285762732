"""Folders that all executors share, for tables that outlive a stage: indexes, streams' state, intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a session of one machine (tests) gets a
    temporary folder; on a cluster that would lose tables, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in it; what is there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, where: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that no one holds any more, which it does when the driver's JVM collects them:
    between two steps that each shuffle much."""
    spark._jvm.System.gc()


@atexit.register
def _clear_at_exit() -> None:
    try:
        for spark, path in _made:
            delete(spark, path)
    except Exception as e:  # the JVM may be gone before this program
        print(f"shared folders stay: {type(e).__name__}")
