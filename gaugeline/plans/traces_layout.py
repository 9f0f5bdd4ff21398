"""Spans and occurrences dealt into the same buckets by trace, so that joins by trace move nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64
#: A bucket is written and read by one task: so many rows are some hundred MB at most.
BUCKET_ROWS = 500_000


def buckets_for(rows: int) -> int:
    """Buckets for so many rows, a power of two and eight at least, as tables are joined that have equally many."""
    return max(8, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


def save(df: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """A table of the catalog with this name, bucketed and sorted by trace_id. Rows without a trace are in a bucket too."""
    rows = df.repartition(buckets, "trace_id")  # one file for each bucket
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "trace_id").sortBy("trace_id").saveAsTable(table)


def errors_in_traces(spark: SparkSession, occurrences: str, spans: str) -> DataFrame:
    """Spans of traces in which an error occurred, from two such tables: without an exchange."""
    wanted = spark.table(occurrences).select("trace_id").distinct()
    return spark.table(spans).hint("merge").join(wanted.hint("merge"), "trace_id", "left_semi")
