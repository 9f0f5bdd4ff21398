"""The four tables as partitioned Parquet: writing, schema steps, retention, replays."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import utc_partition
from ..schemas import LAYOUT, TABLES
from .staging import exists

PARTITION, WRITE = "event_date", "write_id"
_CUT = {"message": 4000, "stack": 32000, "name": 500}
_NOT_NEGATIVE = {"input_tokens", "output_tokens", "request_count", "error_count", "session_count"}
# The ids under which databases have recorded these steps.
#: Steps after the first layout: id, table, columns added. Appended to, never changed.
MIGRATIONS = (
    ("0001-baseline", None, ()),
    ("0002-occurrences-aggregation-columns", "error_occurrences", ("severity", "message_normalized", "top_frames", "first_frame", "route_normalized", "method")),
    ("0003-compress-fat-columns", None, ()),
    ("0004-llm-calls", "llm_calls", tuple(c for c, _, _ in TABLES["llm_calls"])),
)


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T._parse_datatype_string(t) if t.startswith("array") else T._parse_datatype_string(t)) for c, t, _ in TABLES[table]])


def _default(value) -> Column:
    return F.array().cast("array<string>") if value == () else F.lit(value)


def conform(df: DataFrame, table: str, tenant: dict[str, str] | None = None) -> DataFrame:
    """The table's columns in order: defaults for nulls and absent ones, texts cut, counts rounded and not below 0.

    A tenant, where given, replaces whatever the rows say.
    """
    out = []
    for name, kind, default in TABLES[table]:
        c = F.col(name) if name in df.columns else F.lit(None)
        if name == "ingested_at" and name not in df.columns:
            c = F.current_timestamp()
        if tenant and name in tenant:
            c = F.lit(tenant[name])
        if name in _NOT_NEGATIVE:
            c = F.greatest(F.lit(0), F.floor(c.cast("double") + 0.5)) if name not in df.columns or dict(df.dtypes)[name] not in ("bigint", "int") else F.greatest(F.lit(0), c)
        c = c.cast(kind)
        if name in _CUT and not (table == "error_occurrences" and name == "name"):
            c = F.substring(c, 1, _CUT[name])
        if default is not None:
            c = F.coalesce(c, _default(default).cast(kind))
        out.append(c.alias(name))
    return df.select(*out)


def append(df: DataFrame, path: str, table: str, tenant: dict[str, str] | None = None, write_id: str | None = None) -> None:
    """Adds rows, in day or month partitions, sorted within files so that readers skip row groups.

    A write's rows lie in folders of their own. A write that names itself replaces what an earlier try of it left there.
    """
    keys, at, form = LAYOUT[table]
    rows = conform(df, table, tenant).withColumn(PARTITION, utc_partition(F.col(at), form))
    # one shuffle by partition and tenant; a large day is split by adaptive execution
    rows = rows.hint("rebalance", PARTITION, "org_id").sortWithinPartitions(PARTITION, *keys)
    rows = rows.withColumn(WRITE, F.lit(write_id or uuid.uuid4().hex))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    if table == "error_occurrences":
        writer = writer.option("parquet.bloom.filter.enabled#occurrence_id", "true")  # for lookups of single ids
    writer.partitionBy(PARTITION, WRITE).parquet(f"{path}/{table}")


def not_stored(df: DataFrame, path: str, write_id: str, id_: str = "occurrence_id") -> DataFrame:
    """The occurrences that no other write has stored, each once: for deliveries that are repeated long after the first.

    An occurrence's id holds its instant, so a repeated one lies in its own day's partition: no others are read. The names of
    the batch's days come to the driver. What an earlier try of this very write has left doesn't count as stored.
    """
    _, at, form = LAYOUT["error_occurrences"]
    once = df.dropDuplicates([id_])
    if not exists(df.sparkSession, f"{path}/error_occurrences"):
        return once
    days = [r[0] for r in df.select(utc_partition(F.col(at), form)).distinct().collect()]
    from .parts import read_live

    stored = read_live(df.sparkSession, path, "error_occurrences").filter(F.col(PARTITION).isin(days) & (F.col(WRITE) != write_id))
    return once.join(stored.select(id_), id_, "left_anti")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of live parts (plans.parts); files written before a column was added give its default."""
    from .parts import read_live, unmerged

    stored = T.StructType([*schema(table).fields, T.StructField(PARTITION, T.StringType()), T.StructField(WRITE, T.StringType())])
    # nothing was ever merged: the folder as a whole, also where its files lie otherwise
    df = spark.read.schema(stored).parquet(f"{path}/{table}") if unmerged(spark, path, table) else read_live(spark, path, table)
    return df.select(*[F.coalesce(c, _default(d).cast(k)).alias(c) if d is not None else F.col(c) for c, k, d in TABLES[table]], PARTITION)


def for_tenant(df: DataFrame, table: str, org: str, repository: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One tenant's rows, of a time range with its partitions named so that others aren't read."""
    _, at, form = LAYOUT[table]
    out = df.filter((F.col("org_id") == org) & (F.col("repository_id") == repository))
    if start is not None:
        out = out.filter((F.col(at) >= start) & (F.col(PARTITION) >= utc_partition(start, form)))
    if end is not None:
        out = out.filter((F.col(at) < end) & (F.col(PARTITION) <= utc_partition(end, form)))
    return out


def unexpired(df: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    return df.filter(F.col(at) + F.make_dt_interval(F.lit(days)) > as_of)


def expired_partitions(spark: SparkSession, path: str, table: str, days: int, as_of: str) -> list[str]:
    """Partitions whose rows have all expired at a date (yyyy-MM-dd); names of folders, not rows, come to the driver."""
    months = LAYOUT[table][2] == "yyyyMM"
    last = F.last_day(F.to_date(PARTITION, "yyyyMM")) if months else F.to_date(PARTITION)
    names = spark.read.parquet(f"{path}/{table}").select(F.col(PARTITION).cast("string").alias(PARTITION)).distinct()
    return sorted(r[0] for r in names.filter(F.date_add(last, days + 1) <= F.lit(as_of).cast("date")).collect())


def drop_expired(spark: SparkSession, path: str, table: str, days: int, as_of: str) -> list[str]:
    gone = expired_partitions(spark, path, table, days, as_of)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{PARTITION}={name}"), True)
    return gone


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the highest version: last write wins."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(whole, version).alias("_row")).select("_row.*")


def migrate(spark: SparkSession, path: str, at: str = "1970-01-01 00:00:00") -> list[str]:
    """Takes the steps that the registry lacks, registers them and returns their ids. Running it again does nothing.

    A step that adds a table writes it empty where there is none, so that it can be read; one that adds columns needs no
    rewriting, as `read` gives older files the columns' defaults; new files are compressed with zstd, old ones when rewritten.
    """
    registry = f"{path}/schema_migrations"
    folder = spark._jvm.org.apache.hadoop.fs.Path(registry)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    steps = spark.createDataFrame([(m[0],) for m in MIGRATIONS], "id string")
    if there:
        steps = steps.join(spark.read.parquet(registry).select("id").distinct(), "id", "left_anti")
    new = [r.id for r in steps.orderBy("id").collect()]
    for id_, table, columns in MIGRATIONS:
        if id_ in new and table and len(columns) == len(TABLES[table]):
            at_table = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
            if not at_table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at_table):
                append(spark.createDataFrame([], schema(table)), path, table, write_id=id_)
                if not at_table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at_table):
                    at_table.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at_table)
    if new:
        spark.createDataFrame([(i,) for i in new], "id string").withColumn("applied_at", F.lit(at).cast("timestamp")).write.mode("append").parquet(registry)
    return new


def replay(df: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Occurrences of a time range, each once although deliveries were retried."""
    return df.filter((F.col(at) >= start) & (F.col(at) < end)).dropDuplicates(["occurrence_id"])
