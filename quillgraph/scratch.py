"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where the setting is absent, a temporary folder
is used in local mode (tests); on a cluster that is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def scratch_dir(spark: SparkSession) -> str:
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _local_dir


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows once and reads them back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if (held := _held.get()) is not None:
        held.append(out)
    return out


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes within the block, for whoever knows when nothing reads them any more."""
    held: list[DataFrame] = []
    token = _held.set(held)
    try:
        yield held
    finally:
        _held.reset(token)


def discard(*frames: DataFrame) -> None:
    """Removes tables written by ``materialize`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished, unreferenced jobs."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
