"""Schemas of what comes in and of the four stored tables."""

from __future__ import annotations

# Names and limits that senders and readers of the tables share, down to LAYOUT.
EVENT_TYPES = ("exception", "unhandled_rejection", "message", "session_start", "track_event")
SEVERITIES = ("fatal", "error", "warning", "info")

BROWSER = """version int, sessionId string, service string, environment string, release string,
 events array<struct<id:string,type:string,timestamp:string,severity:string,message:string,name:string,stack:string,
 errorType:string,filename:string,line:bigint,column:bigint,route:string,context:string>>"""

KV = "array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>>>"
TRACES = f"""resourceSpans array<struct<resource:struct<attributes:{KV}>,scopeSpans:array<struct<spans:array<struct<
 traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,
 attributes:{KV},status:struct<message:string,code:int>,
 events:array<struct<timeUnixNano:string,name:string,attributes:{KV}>>>>>>>>"""
METRICS = f"""resourceMetrics array<struct<resource:struct<attributes:{KV}>,scopeMetrics:array<struct<metrics:array<struct<
 name:string,unit:string,sum:struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{KV}>>>,
 histogram:struct<aggregationTemporality:int,dataPoints:array<struct<timeUnixNano:string,count:string,sum:double,attributes:{KV}>>>>>>>>>"""

#: Stored tables: columns in order, with the default of those that may be absent.
TABLES = {
    "error_occurrences": [
        ("org_id", "string", None), ("repository_id", "string", None), ("occurrence_id", "string", None), ("fingerprint", "string", None),
        ("source", "string", None), ("severity", "string", "error"), ("service", "string", None), ("environment", "string", None), ("release", "string", ""),
        ("error_type", "string", None), ("message", "string", None), ("message_normalized", "string", ""), ("stack", "string", ""), ("top_frames", "array<string>", ()),
        ("first_frame", "string", ""), ("route", "string", ""), ("route_normalized", "string", ""), ("method", "string", ""), ("status_code", "int", 0),
        ("trace_id", "string", ""), ("session_id", "string", ""), ("attributes", "string", "{}"), ("occurred_at", "timestamp", None), ("ingested_at", "timestamp", None),
    ],
    "spans": [
        ("org_id", "string", None), ("repository_id", "string", None), ("service", "string", None), ("environment", "string", None), ("release", "string", ""),
        ("trace_id", "string", None), ("span_id", "string", None), ("parent_span_id", "string", ""), ("name", "string", None), ("kind", "string", "internal"),
        ("status", "string", "ok"), ("route", "string", ""), ("status_code", "int", 0), ("duration_ms", "double", 0.0), ("attributes", "string", "{}"), ("started_at", "timestamp", None),
    ],
    "metrics_1m": [
        ("org_id", "string", None), ("repository_id", "string", None), ("service", "string", None), ("environment", "string", None), ("release", "string", ""),
        ("route", "string", ""), ("bucket_at", "timestamp", None), ("request_count", "bigint", 0), ("error_count", "bigint", 0), ("duration_sum_ms", "double", 0.0), ("session_count", "bigint", 0),
    ],
    "llm_calls": [
        ("org_id", "string", None), ("repository_id", "string", None), ("service", "string", None), ("environment", "string", None), ("release", "string", ""),
        ("trace_id", "string", ""), ("span_id", "string", ""), ("provider", "string", ""), ("model", "string", ""), ("operation", "string", ""),
        ("input_tokens", "bigint", 0), ("output_tokens", "bigint", 0), ("cost_usd", "double", 0.0), ("cost_source", "string", "none"), ("duration_ms", "double", 0.0),
        ("status", "string", "ok"), ("error_type", "string", ""), ("user_id", "string", ""), ("session_id", "string", ""), ("attributes", "string", "{}"),
        ("started_at", "timestamp", None), ("ingested_at", "timestamp", None),
    ],
}
METRIC_KEY = ("org_id", "repository_id", "service", "environment", "release", "route", "bucket_at")
MEASURES = ("request_count", "error_count", "duration_sum_ms", "session_count")
"""Sort keys within files, time column and its partition format."""
LAYOUT = {
    "error_occurrences": (("org_id", "repository_id", "fingerprint", "occurred_at"), "occurred_at", "yyyy-MM-dd"),
    "spans": (("org_id", "repository_id", "trace_id", "started_at"), "started_at", "yyyy-MM-dd"),
    "metrics_1m": (METRIC_KEY, "bucket_at", "yyyyMM"),
    "llm_calls": (("org_id", "repository_id", "started_at"), "started_at", "yyyy-MM-dd"),
}
