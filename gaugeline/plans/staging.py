"""Tables between steps: Parquet under a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under the session's checkpoint folder, a local one only in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"{name}-")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Written and read again: what follows sees one and the same table however often it is read, and no lineage before it."""
    path = f"{folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """Staged for as long as it is used. Spark's cache keeps arrays as they are, so that a large batch fills it; a table
    has them compressed."""
    path = folder(df.sparkSession, name)
    try:
        df.write.parquet(f"{path}/rows")
        yield df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    finally:
        delete(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern of folder names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(s.getPath().toString() for s in found) if found else []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
