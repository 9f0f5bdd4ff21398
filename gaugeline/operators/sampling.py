"""Which spans are kept: head sampling by trace id, and whole traces kept for an error in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_TRACE = 256


def head_sampled(trace_id: Column, ratio: float = 0.01) -> Column:
    """The same for all spans of a trace: by the last eight hex digits of its id."""
    return F.conv(F.right(trace_id, F.lit(8)), 16, 10).cast("long") < F.lit(int(ratio * (1 << 32)))


def sample(spans: DataFrame, is_model: Column, ratio: float = 0.01) -> DataFrame:
    """All rows, with `sampled`: model calls always are."""
    return spans.withColumn("sampled", is_model | head_sampled(F.col("trace_id"), ratio))


def shows_error(spans: DataFrame, error: str = "is_error") -> Column:
    """Whether a span has failed or, where the table says, has an exception event."""
    failed = F.coalesce(F.col(error), F.lit(False))
    return failed | (F.coalesce(F.size("exceptions"), F.lit(0)) > 0) if "exceptions" in spans.columns else failed


def tail_retained(spans: DataFrame, *, trace: str = "trace_id", end: str = "ended_at", tie: str = "span_id", parent: str = "parent_span_id", error: str = "is_error", kept: int = PER_TRACE) -> DataFrame:
    """The unsampled spans that an error in their trace rescues, with tail_retained set.

    Spans come in order of their ends. From a trace's first error on all are kept, with up to `kept` before it. A root that
    ends without an error before it drops what came so far, so a later error rescues only what follows the root.
    """
    w = W.partitionBy(trace).orderBy(end, tie)
    before = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    bad, root = shows_error(spans, error).cast("int"), (F.col(parent) == "").cast("int")
    df = spans.withColumn("_bad", F.max(bad).over(before)).withColumn("_drop", (root == 1) & (F.col("_bad") == 0))
    # once retained nothing is dropped; before that each healthy root begins a new part after itself
    df = df.withColumn("_part", F.coalesce(F.sum(F.col("_drop").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    part = W.partitionBy(trace, "_part").orderBy(end, tie)
    df = df.withColumn("_last", F.max("_part").over(W.partitionBy(trace))).withColumn("_any", F.max(bad).over(W.partitionBy(trace)))
    df = df.withColumn("_k", F.row_number().over(part))
    keep = (F.col("_any") == 1) & (F.col("_part") == F.col("_last")) & ((F.col("_bad") == 1) | (F.col("_k") <= kept))
    return df.filter(keep).drop("_bad", "_drop", "_part", "_last", "_any", "_k").withColumn("tail_retained", F.lit(True))
