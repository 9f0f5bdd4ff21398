"""What the operators share: reading tables, cutting lineage, Arrow batches in slices."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: Arrow batches of the default size would take hundreds of MB beside the heap, in JVM and workers."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a folder of this machine's in local mode; an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _freed(spark: SparkSession) -> None:
    """Lets the cleaner remove the shuffle files that only plans no longer held need: seen from the second collection on."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.1)


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet under the checkpoint folder and read again: smaller than a checkpoint, and columns can be left out."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    _freed(spark)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint()
    del df
    _freed(spark)
    return out


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def slices(batches, rows: int = 256):
    """Smaller record batches, so that a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def share(bound: int, n: int) -> int:
    """The number that a 63-bit hash must stay below for `bound` of n rows to be expected; exact for any n, at least 1."""
    return max(1, min(1 << 63, (bound << 63) // max(1, n)) - 1)


def sample_by_id(df: DataFrame, id_col: str, bound: int, salt: int = 17) -> DataFrame:
    """About `bound` rows, all if there are no more: those whose hash of the id is low, the same wherever they lie."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.xxhash64(F.col(id_col), F.lit(salt)).bitwiseAND((1 << 63) - 1) < F.lit(share(bound, n)))


def sample_of_each(df: DataFrame, group: str, id_col: str, bound: int, salt: int = 17) -> DataFrame:
    """As sample_by_id, of each value of `group`. One number for each value goes through the driver."""
    sizes = [(r[0], share(bound, r[1])) for r in df.groupBy(group).count().collect() if r[1] > bound]
    if not sizes:
        return df
    limits = df.sparkSession.createDataFrame(sizes, df.select(F.col(group).alias("_group")).schema.add("_limit", "long"))
    joined = df.join(limits, F.col(group) == F.col("_group"), "left")
    low = F.xxhash64(F.col(id_col), F.lit(salt)).bitwiseAND((1 << 63) - 1) < F.col("_limit")
    return joined.filter(F.col("_limit").isNull() | low).drop("_group", "_limit")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def as_strings(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]
