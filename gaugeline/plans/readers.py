"""The documented questions, as functions from stored tables to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_by_route(metrics: DataFrame, since: Column) -> DataFrame:
    return metrics.filter(F.col("bucket_at") > since).groupBy("service", "route").agg(F.sum("request_count").alias("requests"), F.sum("error_count").alias("errors"))


def recent(df: DataFrame, at: str, *ties: str, n: int = 10) -> DataFrame:
    """The latest rows; a top-n that no full sort precedes."""
    return df.orderBy(F.desc(at), *ties).limit(n)


def issue_groups(occurrences: DataFrame) -> DataFrame:
    g = occurrences.groupBy("org_id", "repository_id", "fingerprint")
    return g.agg(F.count("*").alias("occurrences"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.min("error_type").alias("error_type"), F.min("message_normalized").alias("message"))


def by_severity(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("severity").agg(F.count("*").alias("occurrences"), F.countDistinct("fingerprint").alias("issues"))


def by_endpoint(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("route_normalized", F.coalesce("method", F.lit("")).alias("method")).agg(F.count("*").alias("occurrences"))


def hotspots(occurrences: DataFrame) -> DataFrame:
    return occurrences.filter("first_frame != ''").groupBy("first_frame").agg(F.count("*").alias("occurrences"), F.countDistinct("fingerprint").alias("issues"))


def release_regressions(occurrences: DataFrame) -> DataFrame:
    """When and in which release each defect was first seen (of releases at that instant the first by name)."""
    first = F.min(F.struct("occurred_at", "release"))
    return occurrences.groupBy("fingerprint").agg(first.alias("f")).select("fingerprint", F.col("f.occurred_at").alias("first_seen"), F.col("f.release").alias("first_release"))


def span_percentiles(spans: DataFrame, exact: bool = True) -> DataFrame:
    """Median, 95th and 99th percentile of durations by route; the approximate form keeps bounded state for each route."""
    p = F.percentile if exact else F.percentile_approx
    q = [0.5, 0.95, 0.99]
    got = spans.groupBy("route").agg(p("duration_ms", q).alias("p"), F.count("*").alias("sampled"))
    return got.select("route", "sampled", *[F.col("p")[i].alias(f"p{int(100 * x)}") for i, x in enumerate(q)])


def slow_processes(metrics: DataFrame, spans: DataFrame) -> DataFrame:
    """How often a route ran, by the complete counts, and how long it took, by the sampled spans; aggregated before they are joined."""
    runs = metrics.groupBy("route").agg(F.sum("request_count").alias("runs"), F.sum("error_count").alias("errors"))
    return runs.join(span_percentiles(spans), "route")


def model_spend(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def unpriced(calls: DataFrame) -> DataFrame:
    return model_spend(calls.filter("cost_source = 'none'"), "provider", "model").drop("cost_usd")


def errors_in_traces(occurrences: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of traces in which an error occurred."""
    return spans.join(occurrences.select("trace_id").distinct(), "trace_id", "left_semi")


def signal_range(*signals: tuple[DataFrame, str]) -> DataFrame:
    """First and last instant over all signals: what a consumer that lost them would replay."""
    out = None
    for df, at in signals:
        part = df.select(F.col(at).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.min("at").alias("signals_from"), F.max("at").alias("signals_to"))
