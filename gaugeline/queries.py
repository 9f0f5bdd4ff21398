"""Queries over the driver's tables, one for each operator or reader, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters as V
from .functions import text as T
from .operators import calls, gate, occurrences, sampling, traces
from .plans import readers, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _found(spark, d) -> DataFrame:
    """Occurrences with a batch index: each event is a payload of its own, so the index is 0."""
    rows = occurrences.browser_occurrences(V.browser_events(spark, d))
    return occurrences.identify(rows.withColumn("batch_index", F.lit(0)))


_O = f"""{V.EVENTS_SQL},
o1 AS (SELECT * REPLACE (coalesce(severity, CASE WHEN type = 'message' THEN 'warning' ELSE 'error' END) AS severity, coalesce(error_type, CASE type WHEN 'unhandled_rejection' THEN 'UnhandledRejection' WHEN 'message' THEN 'Message' ELSE 'Error' END) AS error_type,
 CASE WHEN message = '' THEN 'Unknown error' ELSE message END AS message, string_split(route, '?')[1] AS route) FROM e WHERE type IN ('exception', 'unhandled_rejection', 'message')),
o2 AS (SELECT *, {T.sql_message("message")} AS message_normalized, {T.sql_frames("stack")} AS top_frames, {T.sql_route("route")} AS route_normalized FROM o1),
o AS (SELECT *, coalesce(top_frames[1], '') AS first_frame, substring(sha256(array_to_string(list_concat(list_concat(['browser', service, error_type, message_normalized], top_frames), [route_normalized]), ' ')), 1, 32) AS fingerprint FROM o2)"""


@query("issue_groups", f"WITH {_O} SELECT org_id, repository_id, fingerprint, count(*) AS occurrences, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, min(error_type) AS error_type, min(message_normalized) AS message FROM o GROUP BY ALL")
def issue_groups(spark, d):
    return readers.issue_groups(_found(spark, d))


@query("occurrence_ids", f"WITH {_O} SELECT event_id, fingerprint, substring(sha256(concat('v1', chr(0), org_id, chr(0), repository_id, chr(0), fingerprint, chr(0), epoch_ms(occurred_at), chr(0), '', chr(0), session_id, chr(0), substring(message, 1, 1000), chr(0), 0)), 1, 32) AS occurrence_id FROM o")
def occurrence_ids(spark, d):
    return _found(spark, d).select("event_id", "fingerprint", "occurrence_id")


@query("browser_occurrences", f"WITH {_O} SELECT event_id, severity, error_type, message, message_normalized, array_to_string(top_frames, '|') AS frames, first_frame, route, route_normalized FROM o")
def browser_occurrences(spark, d):
    return _found(spark, d).select("event_id", "severity", "error_type", "message", "message_normalized", F.array_join("top_frames", "|").alias("frames"), "first_frame", "route", "route_normalized")


@query("normalize_messages", f"SELECT doc_id, {T.sql_message('text')} AS template FROM documents")
def normalize_messages(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.normalize_message(F.col("text")).alias("template"))


_PATH = "regexp_extract(url, '^https?://[^/]+(.*)$', 1)"


@query("normalize_routes", f"SELECT page_id, {T.sql_route(_PATH)} AS route FROM pages")
def normalize_routes(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.normalize_route(F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)).alias("route"))


@query("stack_frames", f"SELECT page_id, array_to_string({T.sql_frames('html')}, '|') AS frames FROM pages")
def stack_frames(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.array_join(T.stack_frames(F.col("html")), "|").alias("frames"))


_U = f"""{V.EVENTS_SQL},
r AS (SELECT org_id, repository_id, service, environment, release, CASE type WHEN 'session_start' THEN '' WHEN 'track_event' THEN concat('event:', name) ELSE string_split(route, '?')[1] END AS route, date_trunc('minute', occurred_at) AS bucket_at,
 type <> 'session_start' AS req, type IN ('exception', 'unhandled_rejection', 'message') AND coalesce(severity, CASE WHEN type = 'message' THEN 'warning' ELSE 'error' END) IN ('fatal', 'error') AS err, type = 'session_start' AS ses FROM e),
u AS (SELECT org_id, repository_id, service, environment, release, route, bucket_at, count(*) FILTER (req) AS request_count, count(*) FILTER (err) AS error_count, 0.0::DOUBLE AS duration_sum_ms, count(*) FILTER (ses) AS session_count FROM r GROUP BY ALL)"""


@query("browser_rollup_1m", f"WITH {_U} SELECT * FROM u")
def browser_rollup(spark, d):
    return occurrences.browser_usage(V.browser_events(spark, d))


@query("usage_by_route", f"WITH {_U} SELECT service, route, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(error_count) AS BIGINT) AS errors FROM u WHERE bucket_at > TIMESTAMP '2024-01-10' GROUP BY ALL")
def usage_by_route(spark, d):
    return readers.usage_by_route(occurrences.browser_usage(V.browser_events(spark, d)), F.to_timestamp(F.lit("2024-01-10")))


@query("recent_occurrences", f"WITH {_O} SELECT event_id, occurred_at, severity, message FROM o ORDER BY occurred_at DESC, event_id LIMIT 10")
def recent_occurrences(spark, d):
    return readers.recent(occurrences.browser_occurrences(V.browser_events(spark, d)).select("event_id", "occurred_at", "severity", "message"), "occurred_at", "event_id")


@query("severity_breakdown", f"WITH {_O} SELECT severity, count(*) AS occurrences, count(DISTINCT fingerprint) AS issues FROM o GROUP BY ALL")
def severity_breakdown(spark, d):
    return readers.by_severity(_found(spark, d))


@query("hotspot_frames", f"WITH {_O} SELECT first_frame, count(*) AS occurrences, count(DISTINCT fingerprint) AS issues FROM o WHERE first_frame <> '' GROUP BY ALL")
def hotspot_frames(spark, d):
    return readers.hotspots(_found(spark, d))


@query("errors_by_endpoint", f"WITH {V.EVENTS_SQL} SELECT concat('/shops/', CASE WHEN event_id % 4 = 3 THEN 'all' ELSE ':id' END, '/p', event_id % 6) AS route_normalized, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS method, count(*) AS occurrences FROM e WHERE type IN ('exception', 'unhandled_rejection', 'message') GROUP BY ALL")
def errors_by_endpoint(spark, d):
    """Routes with numbers and names, of three methods, one of them absent."""
    n = F.col("event_id")
    shop = F.when(n % 4 == 3, "all").otherwise(n.cast("string"))
    events = V.browser_events(spark, d).withColumn("route", F.concat(F.lit("/shops/"), shop, F.lit("/p"), (n % 6).cast("string"), F.lit("?q="), n.cast("string")))
    found = occurrences.identify(occurrences.browser_occurrences(events).withColumn("batch_index", F.lit(0)))
    return readers.by_endpoint(found.withColumn("method", F.when(n % 3 == 0, "GET").when(n % 3 == 1, "POST")))


@query("release_regression", f"WITH {_O} SELECT fingerprint, min({{'t': occurred_at, 'r': release}}).t AS first_seen, min({{'t': occurred_at, 'r': release}}).r AS first_release FROM o GROUP BY ALL")
def release_regression(spark, d):
    return readers.release_regressions(_found(spark, d))


@query("dedupe_replay", f"WITH {_O} SELECT event_id, fingerprint FROM o WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'")
def dedupe_replay(spark, d):
    found = _found(spark, d).select("event_id", "fingerprint", "occurrence_id", "occurred_at")
    twice = found.unionByName(found.filter("event_id % 3 = 0"))
    return store.replay(twice, "occurred_at", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("event_id", "fingerprint")


@query("retention_ttl", f"WITH {_O} SELECT event_id FROM o WHERE occurred_at + INTERVAL 14 DAY > TIMESTAMP '2024-01-30'")
def retention_ttl(spark, d):
    return store.unexpired(occurrences.browser_occurrences(V.browser_events(spark, d)), "occurred_at", 14, F.lit("2024-01-30").cast("timestamp")).select("event_id")


@query("rate_limit", f"WITH {V.EVENTS_SQL} SELECT event_id, row_number() OVER (PARTITION BY org_id, date_trunc('minute', occurred_at) ORDER BY occurred_at, event_id) <= 2 AS allowed FROM e")
def rate_limit(spark, d):
    return gate.limit_per_minute(V.browser_events(spark, d), ["org_id"], "occurred_at", 2, "event_id").select("event_id", "allowed")


@query("session_cap", f"WITH {V.EVENTS_SQL} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS k FROM e) WHERE k <= 20")
def session_cap(spark, d):
    return gate.session_cap(V.browser_events(spark, d), "session_id", "occurred_at", "event_id", 20).select("event_id")


_KEYS = [("key0", "org0", "repo0", "server", []), ("key1", "org1", "repo1", "client", []), ("key2", "org2", "repo2", "client", ["https://a.test"])]


@query("auth_gate", """WITH k AS (SELECT * FROM (VALUES ('key0', 'org0', 'server', CAST([] AS VARCHAR[])), ('key1', 'org1', 'client', CAST([] AS VARCHAR[])), ('key2', 'org2', 'client', ['https://a.test'])) k(key, org_id, scope, origins)),
r AS (SELECT event_id AS request_id, CASE WHEN user_id % 5 = 4 THEN NULL ELSE concat('key', user_id % 5) END AS key, CASE WHEN event_id % 2 = 0 THEN 'otlp' ELSE 'browser' END AS surface, CASE WHEN event_id % 3 = 0 THEN 'https://a.test' END AS origin, ts FROM events),
c AS (SELECT r.*, org_id, scope, CASE WHEN key IS NULL THEN 'missing ingest key' WHEN org_id IS NULL THEN 'invalid ingest key' WHEN scope = 'client' AND surface <> 'browser' THEN 'client keys cannot send OTLP — use a server key'
 WHEN scope = 'client' AND len(origins) > 0 AND NOT coalesce(list_contains(origins, origin), FALSE) THEN 'origin not allowed for this key' END AS no FROM r LEFT JOIN k USING (key)),
w AS (SELECT *, row_number() OVER (PARTITION BY key, no IS NULL, date_trunc('minute', ts) ORDER BY ts, request_id) AS n FROM c),
x AS (SELECT request_id, org_id, coalesce(no, CASE WHEN n > CASE WHEN scope = 'client' THEN 1 ELSE 2 END THEN 'rate limit exceeded' END) AS reason FROM w)
SELECT request_id, org_id, reason, CASE reason WHEN 'missing ingest key' THEN 401 WHEN 'invalid ingest key' THEN 401 WHEN 'rate limit exceeded' THEN 429 WHEN 'client keys cannot send OTLP — use a server key' THEN 403 WHEN 'origin not allowed for this key' THEN 403 ELSE 202 END AS status FROM x""")
def auth_gate(spark, d):
    u = F.col("user_id") % 5
    r = V.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.when(u != 4, F.concat(F.lit("key"), u.cast("string"))).alias("key"), F.when(F.col("event_id") % 2 == 0, "otlp").otherwise("browser").alias("surface"), F.when(F.col("event_id") % 3 == 0, "https://a.test").alias("origin"), F.col("ts").alias("at"))
    keys = spark.createDataFrame(_KEYS, "key string, org_id string, repository_id string, scope string, allowed_origins array<string>")
    return gate.gate(r, keys, server_limit=2, client_limit=1).select("request_id", "org_id", "reason", "status")


@query("span_rollup", f"""WITH {V.SPANS_SQL} SELECT org_id, {T.sql_route("route")} AS route, date_trunc('minute', started_at) AS bucket_at, count(*) AS request_count, count(*) FILTER (status_code >= 500 OR is_error) AS error_count, round(sum(duration_ms), 4) AS duration_sum_ms FROM s WHERE kind = 'server' AND NOT metrics_wired GROUP BY ALL""")
def span_rollup(spark, d):
    rows = V.spans(spark, d)
    none = rows.filter("false").withColumns({"occurred_at": F.col("started_at"), "severity": F.lit("error")})
    return occurrences.merge_usage(traces.span_usage(rows, none)).select("org_id", "route", "bucket_at", "request_count", "error_count", F.round("duration_sum_ms", 4).alias("duration_sum_ms"))


@query("span_percentiles", f"WITH {V.SPANS_SQL} SELECT concat('/', substring(trace_id, 1, 1)) AS route, count(*) AS sampled, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM s GROUP BY ALL")
def span_percentiles(spark, d):
    rows = V.spans(spark, d).select(F.concat(F.lit("/"), F.substring("trace_id", 1, 1)).alias("route"), "duration_ms")
    return readers.span_percentiles(rows).select("route", "sampled", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("slow_processes", f"WITH {V.SPANS_SQL}, a AS (SELECT *, concat('/', substring(trace_id, 1, 1)) AS r FROM s) SELECT r AS route, runs, errors, sampled, p50, p95, p99 FROM (SELECT r, count(*) AS runs, count(*) FILTER (is_error) AS errors FROM a GROUP BY r) JOIN (SELECT r, count(*) AS sampled, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM a WHERE kind = 'server' GROUP BY r) USING (r)")
def slow_processes(spark, d):
    rows = V.spans(spark, d).withColumn("route", F.concat(F.lit("/"), F.substring("trace_id", 1, 1)))
    metrics = rows.select("route", F.lit(1).cast("long").alias("request_count"), F.col("is_error").cast("int").cast("long").alias("error_count"))
    got = readers.slow_processes(metrics, rows.filter("kind = 'server'").select("route", "duration_ms"))
    return got.select("route", "runs", "errors", "sampled", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("errors_in_traces", f"WITH {V.SPANS_SQL} SELECT trace_id, count(*) AS spans FROM s WHERE trace_id IN (SELECT trace_id FROM s WHERE is_error) GROUP BY ALL")
def errors_in_traces(spark, d):
    rows = V.spans(spark, d).select("trace_id", "is_error")
    return readers.errors_in_traces(rows.filter("is_error"), rows).groupBy("trace_id").agg(F.count("*").alias("spans"))


@query("head_sampling", f"WITH {V.SPANS_SQL} SELECT trace_id, count(*) AS spans FROM s WHERE CAST(concat('0x', right(trace_id, 8)) AS BIGINT) < {int(0.01 * (1 << 32))} GROUP BY ALL")
def head_sampling(spark, d):
    rows = sampling.sample(V.spans(spark, d), F.lit(False))
    return rows.filter("sampled").groupBy("trace_id").agg(F.count("*").alias("spans"))


@query("tail_retention", f"""WITH {V.SPANS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ended_at, span_id) AS k FROM (SELECT DISTINCT trace_id, span_id, parent_span_id, is_error, ended_at FROM s)),
b AS (SELECT *, (SELECT min(k) FROM t x WHERE x.trace_id = t.trace_id AND x.is_error) AS bad FROM t),
r AS (SELECT *, (SELECT coalesce(max(k), 0) FROM t x WHERE x.trace_id = b.trace_id AND x.parent_span_id = '' AND NOT x.is_error AND x.k < b.bad) AS cut FROM b)
SELECT trace_id, span_id FROM r WHERE k > cut AND (k >= bad OR k <= cut + 256) AND bad IS NOT NULL""")
def tail_retention(spark, d):
    # moved once, by trace: repeated spans lie together then, as the windows need them
    rows = V.spans(spark, d).select("trace_id", "span_id", "parent_span_id", "is_error", "ended_at").repartition("trace_id").distinct()
    return sampling.tail_retained(rows).select("trace_id", "span_id")


_C = V.calls_sql()


@query("llm_calls", f"WITH {_C} SELECT * FROM c")
def llm_calls(spark, d):
    return calls.extract_calls(V.call_spans(spark, d)).select("span_id", "provider", "model", "input_tokens", "output_tokens", "cost_usd", "cost_source", "status", "error_type", "user_id", "started_at")


@query("llm_spend_by_model", f"WITH {_C} SELECT provider, model, user_id, strftime(started_at, '%Y-%m-%d') AS day, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM c GROUP BY ALL")
def llm_spend(spark, d):
    rows = calls.extract_calls(V.call_spans(spark, d)).withColumn("day", F.date_format("started_at", "yyyy-MM-dd"))
    return readers.model_spend(rows, "provider", "model", "user_id", "day").withColumn("cost_usd", F.round("cost_usd", 6))


@query("unpriced_volume", f"WITH {_C} SELECT provider, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM c WHERE cost_source = 'none' GROUP BY ALL")
def unpriced_volume(spark, d):
    return readers.unpriced(calls.extract_calls(V.call_spans(spark, d)))


@query("recent_llm_calls", f"WITH {_C} SELECT span_id, model, started_at FROM c ORDER BY started_at DESC, span_id LIMIT 10")
def recent_calls(spark, d):
    return readers.recent(calls.extract_calls(V.call_spans(spark, d)).select("span_id", "model", "started_at"), "started_at", "span_id")


@query("signal_range", f"WITH {_O}, {_C} SELECT min(t) AS signals_from, max(t) AS signals_to FROM (SELECT occurred_at AS t FROM o UNION ALL SELECT started_at FROM c)")
def signal_range(spark, d):
    return readers.signal_range((occurrences.browser_occurrences(V.browser_events(spark, d)), "occurred_at"), (calls.extract_calls(V.call_spans(spark, d)), "started_at"))


@query("latest_version", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_version(spark, d):
    return store.latest(V.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("payload_validate", """SELECT event_id, event_type <> 'signup' OR event_id % 2 = 0 AS valid FROM events""")
def payload_validate(spark, d):
    """A payload for each event; odd sign-ups have a null release, which an optional field may not be."""
    from .sources.browser import parse

    e = V.table(spark, d, "events")
    null = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 1), '"release":null,').otherwise("")
    value = F.concat(F.lit('{"version":1,"service":"web","environment":"production",'), null, F.lit('"events":[{"type":"exception","timestamp":"2024-01-01T00:00:00.000Z","message":"m'), F.col("event_id").cast("string"), F.lit('"}]}'))
    return parse(e.select("event_id", value.alias("value"))).select("event_id", "valid")


_HEAD = '{"version":1,"service":"web","environment":"production"'


@query("relay_sanitize", f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN concat('{_HEAD},"events":[{{"type":"message","timestamp":"t","message":"m', event_id, '","route":"/a"}}]}}')
 WHEN 1 THEN concat('{_HEAD},"release":"r', event_id, '","events":[]}}') WHEN 2 THEN concat('{{"version":1,"sessionId":"', repeat('s', 100), '","service":"web","environment":"production","events":[{{"type":"session_start","timestamp":"t","message":""}}]}}')
 WHEN 3 THEN concat('{_HEAD},"events":[{{"type":"exception","timestamp":"t","severity":"fatal","message":"x","name":"n","errorType":"', repeat('E', 200), '","filename":"/f.js","line":', event_id, ',"column":2}}]}}')
 WHEN 4 THEN concat('{_HEAD},"events":[{{"type":"track_event","timestamp":"t","message":"","name":"buy","context":{{"id":', event_id, '}}}},{{"type":"message","timestamp":"u","message":"', repeat('m', 4000), '"}}]}}') END AS clean FROM events""")
def relay_sanitize(spark, d):
    """Ten shapes of payloads: five that pass with what is listed of them, five that don't (a service that is no text, another
    version, an unknown type, too many events, no JSON)."""
    from .sources.browser import sanitize

    n = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    event = '{"type":"message","timestamp":"t"}'
    shapes = (
        text('{"version":1,"cookie":"x","service":"web","environment":"production","release":7,"events":[{"type":"message","severity":"loud","dom":[1],"timestamp":"t","message":"m', n, '","route":"/a?b=1"}]}'),
        text('{"environment":"production","service":"web","version":1.0,"release":"r', n, '","events":[]}'),
        text('{"version":1,"service":"web","sessionId":"', F.repeat(F.lit("s"), 120), '","environment":"production","events":[{"type":"session_start","timestamp":"t","message":5}]}'),
        text('{"version":1,"service":"web","environment":"production","events":[{"column":2,"line":', n, ',"filename":"/f.js?x","errorType":"', F.repeat(F.lit("E"), 300), '","name":"n","stack":9,"message":"x","severity":"fatal","type":"exception","timestamp":"t"}]}'),
        text('{"version":1,"service":"web","environment":"production","events":[{"type":"track_event","timestamp":"t","name":"buy","context":{"id":', n, '}},{"type":"message","timestamp":"u","context":"no","message":"', F.repeat(F.lit("m"), 4100), '"}]}'),
        text('{"version":1,"service":5,"environment":"production","events":[]}'),
        text('{"version":2,"service":"web","environment":"production","events":[]}'),
        text('{"version":1,"service":"web","environment":"production","events":[{"type":"click","timestamp":"t"}]}'),
        text('{"version":1,"service":"web","environment":"production","events":[', F.array_join(F.array_repeat(F.lit(event), 51), ","), "]}"),
        text('{"version":1,', n),
    )
    value = F.element_at(F.array(*shapes), (n % 10 + 1).cast("int"))
    return sanitize(V.table(spark, d, "events").select("event_id", value.alias("value"))).select("event_id", "clean")


@query("stored_browser_occurrences", """SELECT event_id, concat('r', user_id) AS release, concat('Error: x', chr(10), '    at f (a.js:', event_id, ':2)') AS stack, concat('{"filename":"/a.js","line":', event_id, CASE WHEN event_id % 2 = 0 THEN ',"column":7' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN concat(',"context":{"user":', user_id, '}') ELSE '' END, '}') AS attributes,
 4000 AS length, md5(substring(concat(repeat('m', 3990), event_id * 1000003), 1, 4000)) AS message_md5 FROM events WHERE event_type = 'error' AND length(CAST(event_id * 1000003 AS VARCHAR)) >= 10""")
def stored_browser_occurrences(spark, d):
    """Payloads with places, contexts, stacks and releases, stored and read back; messages longer than the store takes are cut."""
    from .plans.staging import folder
    from .sources.browser import parse

    n = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    e = V.table(spark, d, "events").filter("event_type = 'error' AND length(CAST(event_id * 1000003 AS STRING)) >= 10")
    context = F.when(n % 3 == 0, text(',"context":{"user":', F.col("user_id"), "}")).otherwise("")
    event = text('{"type":"exception","timestamp":"2024-01-01T00:00:00Z","message":"m","filename":"/a.js?v=1","line":', n, F.when(n % 2 == 0, ',"column":7').otherwise(""), context, ',"stack":"Error: x\\n    at f (a.js:', n, ':2)"}')
    value = text('{"version":1,"service":"web","environment":"p","release":"r', F.col("user_id"), '","sessionId":"', n, '","events":[', event, "]}")
    payloads = parse(e.select(value.alias("value"), F.lit("o").alias("org_id"), F.lit("r").alias("repository_id")))
    found = occurrences.identify(occurrences.browser_occurrences(occurrences.browser_events(payloads)))
    at = folder(spark, "stored")
    long = F.concat(F.repeat(F.lit("m"), 3990), (F.col("session_id").cast("long") * 1000003).cast("string"))
    store.append(found.withColumn("message", long), at, "error_occurrences")
    rows = store.read(spark, at, "error_occurrences")
    return rows.select(F.col("session_id").cast("long").alias("event_id"), "release", "stack", "attributes", F.length("message").alias("length"), F.md5(F.col("message").cast("binary")).alias("message_md5"))


@query("sink_envelopes", f"""WITH {_O}, {_U[_U.index("r AS (SELECT org_id"):]}, {_C},
w AS (SELECT org_id, repository_id, count(*) AS n FROM (SELECT org_id, repository_id FROM o UNION ALL SELECT org_id, repository_id FROM u UNION ALL SELECT 'org0', 'repo0' FROM c) GROUP BY ALL),
p AS (SELECT org_id, repository_id, concat('{{"service":"', service, '","environment":"', environment, '","release":"', release, '","route":"', route, '","bucket_at":"', strftime(bucket_at, '%Y-%m-%dT%H:%M:%S.000Z'), '","request_count":', request_count,
 ',"error_count":', error_count, ',"duration_sum_ms":0.0,"session_count":', session_count, '}}') AS row, bucket_at AS t FROM u),
h AS (SELECT *, CAST(concat('0x', substring(md5(concat('metrics:', row)), 1, 12)) AS BIGINT) % CAST(ceil(n / 500.0) AS BIGINT) AS part FROM p JOIN w USING (org_id, repository_id))
SELECT org_id, repository_id, substring(sha256(concat('replay-1', chr(0), org_id, chr(0), repository_id, chr(0), part)), 1, 32) AS batch_id, count(*) AS metrics, min(t) AS first, max(t) AS last, md5(string_agg(row, ',' ORDER BY row)) AS metrics_md5 FROM h GROUP BY org_id, repository_id, part""")
def sink_envelopes(spark, d):
    from .streaming.sink import envelopes

    found = store.conform(_found(spark, d), "error_occurrences").drop("ingested_at")
    usage = occurrences.browser_usage(V.browser_events(spark, d))
    made = calls.extract_calls(V.call_spans(spark, d))
    got = envelopes(found, usage, made, "replay-1")
    # of each body the metrics, as they stand in it; parts without any have none to show
    inner = F.regexp_extract("body", '"metrics":\\[(.*)\\],"llmCalls":', 1)
    times = F.transform(F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<struct<bucket_at:timestamp>>"), lambda m: m["bucket_at"])
    # looked at body by body: exploded, each metric would carry its body along
    each = got.select("org_id", "repository_id", "batch_id", F.md5(inner.cast("binary")).alias("metrics_md5"), times.alias("times"))
    return each.filter(F.size("times") > 0).select("org_id", "repository_id", "batch_id", "metrics_md5", F.size("times").cast("long").alias("metrics"), F.array_min("times").alias("first"), F.array_max("times").alias("last"))


@query("streaming_rollup", SQL["browser_rollup_1m"])
def streaming_rollup(spark, d):
    """The stored partial sums of a stream over the same events, read back."""
    from .streaming.jobs import append_usage

    from .plans.staging import folder as new_folder

    folder = new_folder(spark, "rollup")
    V.browser_events(spark, d).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    append_usage(stream, f"{folder}/store", f"{folder}/progress").awaitTermination()
    return occurrences.merge_usage(store.read(spark, f"{folder}/store", "metrics_1m"))
