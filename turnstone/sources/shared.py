"""The folder that the driver and all executors share, and small questions to a file system."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder will do for a session that runs in one process; a cluster's
    executors would each write to their own disks, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _private_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _private_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="turnstone-")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: computed once for several uses, and it survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _located(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _located(spark, path)
    files.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder; one that stands in its place goes first."""
    files, at = _located(spark, path)
    _, end = _located(spark, to)
    files.delete(end, True)
    files.mkdirs(end.getParent())
    if not files.rename(at, end):
        raise OSError(f"{path} could not be moved to {to}")


def children(spark: SparkSession, path: str) -> list[str]:
    files, at = _located(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def input_bytes(df) -> int:
    """Stored bytes of the tables that a DataFrame reads, as the planner knows them; an unknown size counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    return sum(n for n in sizes if n < 1 << 62)
