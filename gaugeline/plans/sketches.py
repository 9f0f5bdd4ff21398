"""Sketches of durations and of distinct values for each route and day: small, merged on read, with a stated error.

A KLL sketch answers quantiles of any set of partitions from a few kB for each; what it says is a value whose rank is within
RANK_ERROR of the one asked for. An HLL sketch counts distinct values within COUNT_ERROR of their number. Both bounds hold for
far more than 99 in 100 answers; sketches of parts merge to the sketch of the whole, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import utc_partition
from .store import PARTITION

KLL_K, HLL_LG = 800, 14
RANK_ERROR, COUNT_ERROR = 0.01, 0.03
_KEY = ("org_id", "repository_id", "route")


def route_sketches(spans: DataFrame, count: str = "trace_id") -> DataFrame:
    """One row for each tenant, route and day: durations (a KLL sketch), counted (an HLL sketch), sampled. Null durations don't count."""
    rows = spans.withColumn(PARTITION, utc_partition(F.col("started_at"), "yyyy-MM-dd"))
    return rows.groupBy(*_KEY, PARTITION).agg(F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), KLL_K).alias("durations"), F.hll_sketch_agg(count, HLL_LG).alias("counted"), F.count("duration_ms").alias("sampled"))


def append(sketches: DataFrame, path: str, write_id: str) -> None:
    """Adds sketches in day partitions; a write of the same name replaces what it left. A day may have any number of rows for a route."""
    rows = sketches.withColumn("write_id", F.lit(write_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(PARTITION, "write_id").parquet(f"{path}/route_sketches")


def read(df: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Merged sketches of each group: sampled, distinct, and p50, p95, ... as asked."""
    merged = df.groupBy(*by).agg(F.kll_merge_agg_double("durations", KLL_K).alias("_kll"), F.hll_sketch_estimate(F.hll_union_agg("counted")).alias("distinct"), F.sum("sampled").alias("sampled"))
    at = lambda q: F.when(F.col("sampled") > 0, F.kll_sketch_get_quantile_double("_kll", F.lit(q)))
    return merged.select(*by, "sampled", "distinct", *[at(q).alias(f"p{q * 100:g}") for q in quantiles])


def rank_within(below: Column, up_to: Column, n: Column, q: float) -> Column:
    """Whether a value with so many values below it, and up to it, is an answer for a quantile within RANK_ERROR."""
    return (below / n <= q + RANK_ERROR) & (up_to / n >= q - RANK_ERROR)
