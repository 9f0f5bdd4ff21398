"""Occurrences: defaults, templates and identities; and browser events as occurrences and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.instants import utc_minute
from ..schemas import METRIC_KEY, SEVERITIES


OCCURRENCE_TYPES = ("exception", "unhandled_rejection", "message")


def as_severity(value: Column, fallback: Column) -> Column:
    return F.when(value.isin(*SEVERITIES), value).otherwise(fallback)


def default_error_type(kind: Column) -> Column:
    return F.when(kind == "unhandled_rejection", "UnhandledRejection").when(kind == "message", "Message").otherwise("Error")


def default_severity(kind: Column) -> Column:
    return F.when(kind == "message", "warning").otherwise("error")


def identify(df: DataFrame) -> DataFrame:
    """Adds message_normalized, top_frames, first_frame, route_normalized, fingerprint and occurrence_id.

    Needs org_id, repository_id, source, service, error_type, message, stack, route, occurred_at, trace_id, session_id and
    batch_index. The templates are made once and the identities of them.
    """
    df = df.withColumns({"message_normalized": T.normalize_message(F.col("message")), "top_frames": T.stack_frames(F.col("stack")), "route_normalized": T.normalize_route(F.col("route"))})
    df = df.withColumn("first_frame", F.coalesce(F.get("top_frames", F.lit(0)), F.lit("")))
    df = df.withColumn("fingerprint", T.fingerprint_of(*(F.col(c) for c in ("source", "service", "error_type", "message_normalized", "top_frames", "route_normalized"))))
    return df.withColumn("occurrence_id", T.occurrence_id(*(F.col(c) for c in ("org_id", "repository_id", "fingerprint", "occurred_at", "trace_id", "session_id", "message", "batch_index"))))


def browser_events(payloads: DataFrame) -> DataFrame:
    """One row for each event of valid payloads (column payload), typed and named as the tables name them. batch_index counts
    the occurrences before it in its payload: sessions and tracked events have no place among them."""
    keep = [c for c in payloads.columns if c not in ("payload", "valid", "value")]
    p = payloads.filter("payload is not null")
    e = p.select(*keep, F.col("payload.service").alias("service"), F.col("payload.environment").alias("environment"), F.col("payload.release").alias("release"), F.col("payload.sessionId").alias("session_id"), F.posexplode("payload.events").alias("place", "e"), "payload.events")
    before = F.size(F.filter(F.slice("events", F.lit(1), F.col("place")), lambda x: x["type"].isin(*OCCURRENCE_TYPES)))
    filename = T.strip_query(F.col("e.filename"))
    attributes = F.struct(filename.alias("filename"), F.col("e.line").alias("line"), F.col("e.column").alias("column"))
    # the context is JSON already: it goes in as it is
    plain = F.to_json(attributes)
    context = F.col("e.context")
    opened = F.substring(plain, F.lit(1), F.length(plain) - 1)
    full = F.when(context.isNull(), plain).otherwise(F.concat(opened, F.when(plain == "{}", "").otherwise(","), F.lit('"context":'), context, F.lit("}")))
    return e.select(*keep, "service", "environment", "release", "session_id", "place", before.alias("batch_index"), F.col("e.type").alias("type"), F.to_timestamp("e.timestamp").alias("occurred_at"), F.col("e.severity").alias("severity"), F.coalesce("e.message", F.lit("")).alias("message"), F.col("e.name").alias("name"), F.col("e.stack").alias("stack"), F.col("e.errorType").alias("error_type"), F.col("e.route").alias("route"), full.alias("attributes"))


def browser_occurrences(events: DataFrame) -> DataFrame:
    """Exceptions, rejections and messages with their defaults; sessions and tracked events are no occurrences."""
    kind = F.col("type")
    out = events.filter(kind.isin(*OCCURRENCE_TYPES))
    return out.withColumns({
        "source": F.lit("browser"), "severity": as_severity(F.col("severity"), default_severity(kind)), "error_type": F.coalesce("error_type", default_error_type(kind)),
        "message": F.when(F.col("message") == "", "Unknown error").otherwise(F.col("message")), "route": T.strip_query(F.col("route")),
        "method": F.lit(None).cast("string"), "status_code": F.lit(None).cast("int"), "trace_id": F.lit(None).cast("string"),
    })


def browser_usage(events: DataFrame) -> DataFrame:
    """Usage of one-minute buckets: sessions on the empty route, tracked events on event:<name>, others on their raw path."""
    kind = F.col("type")
    name = F.substring(F.coalesce("name", "message"), 1, 200)
    route = F.when(kind == "session_start", "").when(kind == "track_event", F.concat(F.lit("event:"), name)).otherwise(F.coalesce(T.strip_query(F.col("route")), F.lit("")))
    bad = as_severity(F.col("severity"), default_severity(kind)).isin("fatal", "error")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    rows = events.filter((kind != "track_event") | (F.coalesce(name, F.lit("")) != "")).select(
        "org_id", "repository_id", "service", "environment", F.coalesce("release", F.lit("")).alias("release"), route.alias("route"), utc_minute(F.col("occurred_at")).alias("bucket_at"),
        one(kind != "session_start").alias("request_count"), one(~kind.isin("session_start", "track_event") & bad).alias("error_count"), F.lit(0.0).alias("duration_sum_ms"), one(kind == "session_start").alias("session_count"),
    )
    return merge_usage(rows)


def merge_usage(points: DataFrame) -> DataFrame:
    """Sums of equal keys: what a reader of partial sums sees."""
    return points.groupBy(*METRIC_KEY).agg(*[F.sum(c).alias(c) for c in ("request_count", "error_count", "duration_sum_ms", "session_count")])
