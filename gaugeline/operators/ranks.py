"""Places of rows within groups that may be of any size.

A window ranks a group in one task. Here rows are sorted by group and order over range partitions, so that a group with
half of all rows lies in half of the partitions; each partition ranks its part of a group, and what lies in the partitions
before it is added: an offset for each group that lies in several, of which there are no more than partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in its group by the order; rows that the order doesn't part come as they lie.

    `partitions`: how many ranges; the session's number of shuffle partitions if not given. Null keys are a group. Names that
    begin with _rank_ are this function's own.
    """
    if not df.columns or any(c.startswith("_rank_") for c in df.columns):
        raise ValueError("columns that begin with _rank_ are taken")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # staged, as ranges drawn anew would cut elsewhere
    rows = staged(dealt.withColumn("_rank_at", F.monotonically_increasing_id()).withColumn("_rank_part", F.spark_partition_id()), "ranks")
    parts = rows.groupBy(*keys, "_rank_part").agg(F.min("_rank_at").alias("_rank_first"), F.count("*").alias("_rank_n"))
    before = W.partitionBy(*keys).orderBy("_rank_part").rowsBetween(W.unboundedPreceding, -1)
    every = parts.withColumn("_rank_offset", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)))
    # a place is the row's distance from the first of its group in the partition, and what lies before that
    base = every.select(*[F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(keys)], F.col("_rank_part").alias("_rank_p"), (F.col("_rank_offset") - F.col("_rank_first")).alias("_rank_base"))
    same = F.col("_rank_part") == F.col("_rank_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_k{i}"))
    joined = rows.join(base, same)
    return joined.select(*df.columns, (F.col("_rank_at") + F.col("_rank_base") + 1).alias(name))


def first_of_each(df: DataFrame, keys: list[str], order: list[str], most: Column | int) -> DataFrame:
    """The rows with the first places of each group."""
    return ranked(df, keys, order, "_place").filter(F.col("_place") <= most).drop("_place")
