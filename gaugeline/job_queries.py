"""Queries over jobs that keep state or tables from batch to batch, and over operators for groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as V
from . import request_queries as Q
from .config import Settings
from .operators import gate, occurrences, ranks
from .plans import parts, sketches, store, traces_layout
from .plans.staging import folder, staged
from .queries import SQL, query
from .sources import bodies
from .sources.issues import with_issues
from .streaming import delivery, ingest, jobs, state


#: Rows of a batch for each of its files: a few MB of what the jobs read, so that no task writes or reads a whole batch.
FILE_ROWS = 50_000
#: Files of one row each that a task writes.
BODIES = 1000


def dealt(df: DataFrame, path: str, batch, batches: int) -> DataFrame:
    """The rows as a stream of so many micro-batches: as many files for each value of `batch`, from 0 on, in that order."""
    sizes = dict(df.groupBy(batch.cast("int").alias("k")).count().collect())
    files = max(1, min(sizes.get(k, 0) for k in range(batches)) // FILE_ROWS)
    for k in range(batches):
        rows = df.filter(batch == k)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(spark: SparkSession, stream: DataFrame, at: str) -> DataFrame:
    """What a stream with keyed state gives, until its input ends."""
    writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
    state.start(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


# Limits across micro-batches.


@query("stream_rate_limit", SQL["rate_limit"])
def stream_rate_limit(spark, d):
    """The limit of rate_limit over the same events in six batches, in the order of time."""
    at = folder(spark, "limits")
    e = V.browser_events(spark, d).select("event_id", "org_id", "occurred_at")
    n = e.agg(F.max("event_id")).first()[0] + 1
    stream = dealt(e, f"{at}/in", F.floor(F.col("event_id") * 6 / n), 6)
    return finished(spark, state.limit_stream(stream, ["org_id"], "occurred_at", 2, "event_id"), at).select("event_id", "allowed")


@query("stream_rate_limit_arrivals", """WITH e AS (SELECT event_id, user_id % 3 AS k, event_id % 6 AS batch, date_trunc('day', ts) + to_seconds(event_id % 600) AS arrived FROM events)
SELECT event_id, row_number() OVER (PARTITION BY k, date_trunc('minute', arrived) ORDER BY batch, arrived, event_id) <= 3 + 2 * k AS allowed FROM e""")
def stream_rate_limit_arrivals(spark, d):
    """Six batches that each have some of every minute's requests: what came in earlier ones counts. Keys have limits of their own."""
    at = folder(spark, "limits")
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("k"), F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))) + F.col("event_id") % 600).alias("at"))
    stream = dealt(e, f"{at}/in", F.col("event_id") % 6, 6)
    return finished(spark, state.limit_stream(stream, ["k"], "at", F.lit(3) + 2 * F.col("k"), "event_id"), at).select("event_id", "allowed")


# Groups of any size.

_HOT = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"


@query("hot_rank", f"SELECT event_id, row_number() OVER (PARTITION BY {_HOT} ORDER BY ts, event_id) AS rank FROM events")
def hot_rank(spark, d):
    """Places in groups of which one has half of all rows."""
    e = V.table(spark, d, "events").select("event_id", "ts", F.expr(_HOT).alias("k"))
    return ranks.ranked(e, ["k"], ["ts", "event_id"]).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("hot_rate_limit", f"SELECT event_id, row_number() OVER (PARTITION BY {_HOT}, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def hot_rate_limit(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", F.expr(_HOT).alias("k"))
    return gate.limit_per_minute(e, ["k"], "ts", 1, "event_id", spread=True).select("event_id", "allowed")


@query("hot_session_cap", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {_HOT} ORDER BY ts, event_id) AS k FROM events) WHERE k <= 30")
def hot_session_cap(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", F.expr(_HOT).alias("k"))
    return gate.session_cap(e, "k", "ts", "event_id", 30, spread=True).select("event_id")


# From raw requests to stored rows and refusals.

_STATIC = """[{"key":"k0","orgId":"o0","repositoryId":"repo"},{"key":"k1","orgId":"o9","repositoryId":"repo"},
 {"key":"k1","orgId":"o1","repositoryId":"repo","scope":"client","allowedOrigins":["https://a.test"]},{"key":"k2","orgId":"o2","repositoryId":"repo","scope":"client"}]"""
#: What the validator knows: k3 is a server key, k4 is none.
_VALIDATED = "CASE WHEN key = 'k3' THEN 'o3' END"


def raw_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each event: keys in header, query or nowhere, both surfaces, bodies of which some are broken."""
    n, u = F.col("event_id"), F.col("user_id")
    text = Q._text
    key = F.when(u % 7 < 5, text("k", u % 7)).when(u % 7 == 5, "k5")
    surface = F.when(u % 7 == 0, "traces").when(n % 3 == 0, "traces").when(n % 3 == 1, "metrics").otherwise("browser")
    nanos = F.lit("1704067200000000000")
    span = text('{"traceId":"', F.md5(n.cast("string").cast("binary")), '","spanId":"', F.substring(F.md5(n.cast("string").cast("binary")), 1, 16), '","name":"job","kind":2,"startTimeUnixNano":"', nanos, '","endTimeUnixNano":"', nanos, '","status":{"code":', F.when(n % 4 == 0, "2").otherwise("1"), "}}")
    traces = text('{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"spans":[', span, "]}]}]}")
    event = text('{"type":"exception","timestamp":"2024-01-01T00:00:00.000Z","message":"event ', n, '"}')
    payload = text('{"version":', F.when(n % 5 == 0, "2").otherwise("1"), ',"service":"web","environment":"p","events":[', event, "]}")
    body = F.when(n % 11 == 0, text("{", n)).when(n % 13 == 0, F.rpad(text("{", n), 3000, " ")).when(surface == "traces", traces).when(surface == "metrics", "{}").otherwise(payload)
    e = V.table(spark, d, "events")
    return e.select(
        n.alias("request_id"), surface.alias("surface"), F.when(n % 2 == 0, text("Bearer ", key)).alias("authorization"), F.when((n % 4 == 1), key).alias("key_header"), F.when(n % 4 == 3, key).alias("key_query"),
        F.when(n % 8 < 6, "https://a.test").otherwise("https://b.test").alias("origin"), F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))) + n % 600).alias("received_at"), body.alias("body"),
    )


_RAW = """r AS (SELECT event_id AS n, user_id % 7 AS u, CASE WHEN user_id % 7 < 6 THEN concat('k', user_id % 7) END AS key, CASE WHEN user_id % 7 = 0 OR event_id % 3 = 0 THEN 'traces' WHEN event_id % 3 = 1 THEN 'metrics' ELSE 'browser' END AS surface, event_id % 8 < 6 AS from_a,
 date_trunc('day', ts) + to_seconds(event_id % 600) AS arrived, event_id % 3 AS batch FROM events),
f AS (SELECT *, CASE WHEN n % 11 <> 0 AND n % 13 = 0 THEN 'payload too large' WHEN surface <> 'browser' AND n % 11 = 0 THEN 'bad request' WHEN key IS NULL THEN 'missing ingest key' WHEN key IN ('k4', 'k5') THEN 'invalid ingest key'
 WHEN key IN ('k1', 'k2') AND surface <> 'browser' THEN 'client keys cannot send OTLP — use a server key' WHEN key = 'k1' AND NOT from_a THEN 'origin not allowed for this key' END AS no FROM r),
p AS (SELECT *, CASE WHEN no IS NULL THEN row_number() OVER (PARTITION BY key, no IS NULL, date_trunc('minute', arrived) ORDER BY batch, arrived, n) END AS k FROM f),
q AS (SELECT *, coalesce(no, CASE WHEN k > CASE WHEN key IN ('k1', 'k2') THEN 2 ELSE 4 END THEN 'rate limit exceeded' WHEN surface = 'browser' AND n % 11 = 0 THEN 'invalid json' WHEN surface = 'browser' AND n % 5 = 0 THEN 'invalid payload' END) AS reason FROM p)"""


def gated(spark: SparkSession, d: str, validator=None) -> str:
    """Runs the ingestion job over the raw requests in three batches that each have some of every minute's; its path."""
    at = folder(spark, "gated")
    made = raw_requests(spark, d)
    static = gate.parse_keys(spark.createDataFrame([(_STATIC,)], "value string"))

    def answers(keys: DataFrame) -> DataFrame:
        org = F.expr(_VALIDATED)
        return keys.select("key", F.lit(True).alias("reachable"), org.alias("org_id"), F.when(org.isNotNull(), "repo").alias("repository_id"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("array<string>").alias("allowed_origins"))

    stream = dealt(made, f"{at}/in", F.col("request_id") % 3, 3)
    ingest.ingest_requests(stream, f"{at}/store", f"{at}/progress", static=static, validator=validator or answers, settings=Settings(server_limit=4, client_limit=2, body_bytes=2000), count_hours=24 * 60).awaitTermination()
    return f"{at}/store"


_CODES = " ".join(f"WHEN '{reason}' THEN {code}" for reason, code in gate.REFUSALS.items())


@query("stream_gated_ingest", f"""WITH {_RAW} SELECT 'refused' AS kind, CAST(n AS VARCHAR) AS name, reason, CASE reason {_CODES} END AS status, CASE WHEN reason = 'invalid payload' THEN 'version:invalid_literal' END AS detail FROM q WHERE reason IS NOT NULL
UNION ALL SELECT 'span', md5(CAST(n AS VARCHAR)), NULL, NULL, concat('o', u) FROM q WHERE reason IS NULL AND surface = 'traces'
UNION ALL SELECT 'occurrence', CASE WHEN surface = 'browser' THEN concat('event ', n) ELSE 'job' END, NULL, NULL, concat('o', u) FROM q WHERE reason IS NULL AND (surface = 'browser' OR (surface = 'traces' AND n % 4 = 0))""")
def stream_gated_ingest(spark, d):
    """What is answered to requests that aren't stored, and the spans and occurrences of the others under their keys' tenants."""
    path = gated(spark, d)
    told = F.when(F.size("issues") > 0, F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["path"], x["code"])), ","))
    refused = ingest.refusals(spark, path).select(F.lit("refused").alias("kind"), F.col("request_id").alias("name"), "reason", "status", told.alias("detail"))
    kept = lambda table, kind, name: store.read(spark, path, table).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("org_id").alias("detail"))
    return refused.unionByName(kept("spans", "span", "trace_id"), allowMissingColumns=True).unionByName(kept("error_occurrences", "occurrence", "message"), allowMissingColumns=True)


# Delivery over several batches.


def _consumer(body: str, attempt: int) -> int:
    """A consumer that takes, refuses, is busy once or twice, or never answers, as the body asks."""
    kind = int(body.rpartition(":")[2]) % 7
    if kind in (3, 4) and attempt <= kind - 2:
        return 503 if kind == 3 else 429
    if kind == 5:
        raise ConnectionRefusedError
    return (204, 400, 413, 200, 200, 0, 503)[kind]


def _clock(epoch: int):
    return F.lit(f"2024-01-01 00:{epoch:02}:00").cast("timestamp")


@query("stream_delivery", """SELECT CAST(event_id AS VARCHAR) AS batch_id, CASE WHEN event_id % 7 IN (0, 3, 4) THEN 'delivered' WHEN event_id % 7 IN (1, 2) THEN 'permanent' ELSE 'gave_up' END AS outcome,
 CASE WHEN event_id % 7 IN (0, 1, 2) THEN 1 WHEN event_id % 7 = 3 THEN 2 WHEN event_id % 7 = 4 THEN 3 ELSE 4 END AS attempts,
 CASE event_id % 7 WHEN 1 THEN 'http_400' WHEN 2 THEN 'http_413' WHEN 5 THEN 'connection_error' WHEN 6 THEN 'http_503' END AS reason FROM events""")
def stream_delivery(spark, d):
    """Bodies enqueued over four batches, sent in them and in the rounds after, until nothing waits."""
    at = folder(spark, "delivery")
    n = F.col("event_id")
    made = V.table(spark, d, "events").select(n.cast("string").alias("batch_id"), Q._text("org", F.col("user_id") % 3).alias("org_id"), Q._text("body:", n).alias("body"), F.lit(5).cast("long").alias("bytes"), F.col("ts").cast("timestamp").alias("signals_from"), F.col("ts").cast("timestamp").alias("signals_to"))
    queue = delivery.Queue(spark, f"{at}/sink", _consumer, attempts=4, base=30.0)
    delivery.deliver_stream(dealt(made, f"{at}/in", F.col("batch_id").cast("long") % 4, 4), queue, f"{at}/progress", _clock).awaitTermination()
    for epoch in range(4, 12):
        queue.deliver(_clock(epoch), epoch)
    return queue.state().select("batch_id", "outcome", "attempts", "reason")


# Merged parts.


@query("merged_usage", SQL["browser_rollup_1m"])
def merged_usage(spark, d):
    """Partial sums of six batches, merged: the stored rows are the sums themselves, without a reader's adding up."""
    at = folder(spark, "merged")
    e = V.browser_events(spark, d)
    stream = dealt(e, f"{at}/in", F.col("event_id") % 6, 6)
    jobs.append_usage(stream, f"{at}/store", f"{at}/progress").awaitTermination()
    parts.merge(spark, f"{at}/store", "metrics_1m")
    return store.read(spark, f"{at}/store", "metrics_1m").drop(store.PARTITION)


# Faults of payloads.

_FAULTS = ("version:invalid_literal", "service:too_small", "release:invalid_type", "events.0.type:invalid_enum_value", "events.0.timestamp:invalid_string", "events.0.line:invalid_type", "events.0.line:too_small", "events.1:invalid_type")


@query("payload_issues", f"""WITH e AS (SELECT event_id, list_filter([{", ".join(f"CASE WHEN event_id & {1 << k} > 0 THEN '{f}' END" for k, f in enumerate(_FAULTS) if k not in (5, 6))},
 CASE WHEN event_id & 32 > 0 THEN '{_FAULTS[5]}' END, CASE WHEN event_id & 32 > 0 THEN '{_FAULTS[6]}' END, CASE WHEN event_id & 128 > 0 THEN '{_FAULTS[7]}' END], lambda x: x IS NOT NULL) AS x FROM events),
s AS (SELECT event_id, list_sort(list_distinct(x)) AS x FROM e), o AS (SELECT event_id, list_filter({list(_FAULTS)}, lambda f: list_contains(x, f)) AS x FROM s)
SELECT event_id, array_to_string(x[:5], ',') AS issues FROM o""")
def payload_issues(spark, d):
    """A payload for each event whose number's bits say which of seven faults it has: the first five, in the schema's order."""
    n = F.col("event_id")
    pick = lambda k, good, bad: F.when(n.bitwiseAND(1 << k) > 0, F.lit(bad)).otherwise(F.lit(good))
    first = Q._text('{"line":', pick(5, "3", "-1.5"), ',"type":', pick(3, '"message"', '"crash"'), ',"timestamp":', pick(4, '"2024-01-01T00:00:00Z"', '"noon"'), "}")
    value = Q._text('{"events":[', first, pick(7, "", ",7"), '],"release":', pick(2, '"r"', "null"), ',"environment":"p","service":', pick(1, '"web"', '""'), ',"version":', pick(0, "1", '"1"'), "}")
    told = with_issues(V.table(spark, d, "events").select("event_id", value.alias("value")))
    return told.select("event_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["path"], x["code"])), ",").alias("issues"))


# Tails over several batches.


@query("stream_tails", """WITH RECURSIVE e AS (SELECT event_id AS n, user_id % 20 AS trace_id, event_id % 4 AS batch, event_id % 23 = 0 OR event_id % 29 = 7 AS bad, event_id % 13 = 5 AS root,
 event_id // 400 * 100 + event_id % 4 * 9 + event_id % 5 AS second FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY batch, second, CAST(n AS VARCHAR)) AS k FROM e),
w AS (SELECT trace_id, k, n, second AS first, bad AS kept, CASE WHEN bad OR root THEN 0 ELSE 1 END AS waiting, 1 AS entry, 0 AS cut FROM o WHERE k = 1
 UNION ALL SELECT o.trace_id, o.k, o.n, CASE WHEN x.gone THEN o.second ELSE w.first END, (w.kept AND NOT x.gone) OR o.bad, CASE WHEN (w.kept AND NOT x.gone) OR o.bad OR o.root THEN 0 ELSE least(3, CASE WHEN x.gone THEN 0 ELSE w.waiting END + 1) END,
 w.entry + CAST(x.gone AS INT), w.cut + CAST(o.root AND NOT o.bad AND (x.gone OR NOT w.kept) AS INT)
 FROM w JOIN o ON o.trace_id = w.trace_id AND o.k = w.k + 1, LATERAL (SELECT o.second > w.first + 30 AS gone) x),
b AS (SELECT w.*, o.bad, o.root, CASE WHEN o.root AND NOT w.kept THEN cut - 1 ELSE cut END AS part FROM w JOIN o USING (trace_id, k)),
f AS (SELECT trace_id, entry, min(k) AS bad_k FROM b WHERE kept GROUP BY ALL),
p AS (SELECT b.*, f.bad_k, row_number() OVER (PARTITION BY b.trace_id, b.entry, b.part, b.k >= f.bad_k ORDER BY b.k) AS place, max(CASE WHEN b.k = f.bad_k THEN b.part END) OVER (PARTITION BY b.trace_id, b.entry) AS bad_part
 FROM b JOIN f USING (trace_id, entry))
SELECT n AS span_id, trace_id, TRUE AS tail_retained FROM p WHERE k >= bad_k OR (part = bad_part AND place <= 3 AND NOT root)""")
def stream_tails(spark, d):
    """Traces over four batches: failed spans and exception events rescue, healthy roots drop, three spans wait at most, and a trace
    is forgotten thirty seconds after its first span."""
    at = folder(spark, "tails")
    n = F.col("event_id")
    second = F.floor(n / 400) * 100 + n % 4 * 9 + n % 5
    event = F.struct(F.lit("exception").alias("name"))
    spans = V.table(spark, d, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("trace_id"), n.cast("string").alias("span_id"), F.when(n % 13 == 5, "").otherwise("p").alias("parent_span_id"), (n % 23 == 0).alias("is_error"),
        F.when(n % 29 == 7, F.array(event)).alias("exceptions"), F.timestamp_seconds(F.lit(1704067200) + second).alias("ended_at"),
    )
    stream = dealt(spans, f"{at}/in", F.col("span_id").cast("long") % 4, 4)
    kept = finished(spark, state.retain_tails(stream, seconds=30, most=3), at)
    return kept.select(F.col("span_id").cast("long").alias("span_id"), F.substring("trace_id", 2, 9).cast("long").alias("trace_id"), "tail_retained")


# Sketches, compressed bodies, repeated deliveries, traces in buckets.


@query("sketched_percentiles", f"""WITH {V.SPANS_SQL} SELECT concat('/', substring(trace_id, 1, 1)) AS route, count(*) AS sampled, {sketches.RANK_ERROR} AS rank_error, TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within, TRUE AS distinct_within FROM s GROUP BY ALL""")
def sketched_percentiles(spark, d):
    """Percentiles and numbers of traces out of stored sketches of each route and day, merged on read: whether each is within the
    bound that the sketches state, by the exact ranks of what they say."""
    at = folder(spark, "sketches")
    day = F.timestamp_seconds(F.lit(1704067200) + F.unix_date(F.col("started_at").cast("date")) % 10 * 86400)  # ten days of spans
    rows = V.spans(spark, d).withColumns({"route": F.concat(F.lit("/"), F.substring("trace_id", 1, 1)), "started_at": day}).select("org_id", "repository_id", "route", "started_at", "duration_ms", "trace_id")
    sketches.append(sketches.route_sketches(rows), at, "all")
    said = sketches.read(spark.read.parquet(f"{at}/route_sketches"), "route")
    count = lambda c: F.count(F.when(c, 1))
    pairs = [(p, n) for p in ("p50", "p95", "p99") for n in ("below", "up_to")]
    ranks_ = rows.join(said, "route").groupBy("route").agg(
        F.first("sampled").alias("sampled"), F.first("distinct").alias("said"), F.countDistinct("trace_id").alias("n"),
        *[count(F.col("duration_ms") < F.col(p) if n == "below" else F.col("duration_ms") <= F.col(p)).alias(f"{p}_{n}") for p, n in pairs],
    )
    within = lambda p, q: sketches.rank_within(F.col(f"{p}_below"), F.col(f"{p}_up_to"), F.col("sampled"), q).alias(f"{p}_within")
    near = (F.abs(F.col("said") - F.col("n")) <= sketches.COUNT_ERROR * F.col("n")).alias("distinct_within")
    return ranks_.select("route", "sampled", F.lit(sketches.RANK_ERROR).alias("rank_error"), within("p50", 0.5), within("p95", 0.95), within("p99", 0.99), near)


@query("stream_bodies", """WITH b AS (SELECT event_id // 100 AS n, count(*) * 20 AS k FROM events GROUP BY ALL), t AS (SELECT n, concat('{"n":', n, ',"pad":"', repeat('p', CAST(k + n % 7 * 100 AS INT)), '"}') AS body FROM b)
SELECT n, CASE WHEN length(body) + 1 > 2300 THEN 'payload too large' END AS fault, CASE WHEN length(body) + 1 <= 2300 THEN md5(body) END AS body_md5 FROM t""")
def stream_bodies(spark, d):
    """A stream of files that are plain, gzip or deflate: bodies up to a bound, the rest refused."""
    at = folder(spark, "bodies")
    n, codecs = F.col("n"), F.array(*map(F.lit, ("none", "gzip", "deflate")))
    e = staged(V.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("n")).agg((F.count("*") * 20).alias("k")), "bodies")
    body = F.concat(F.lit('{"n":'), n.cast("string"), F.lit(',"pad":"'), F.repeat(F.lit("p"), (F.col("k") + n % 7 * 100).cast("int")), F.lit('"}\n'))
    # said by number: a row is a few bytes and adaptive execution would have one task write all files
    rows = e.repartition(max(1, e.count() // BODIES))
    bodies.write_bodies(rows.select(n.cast("string").alias("name"), F.get(codecs, n % 3).alias("codec"), body.alias("body")), f"{at}/in")
    with bodies.many_files(spark):
        stream = bodies.read_bodies(spark, f"{at}/in", 2300, streaming=True)
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{at}/out")
    return rows.select(F.regexp_extract("path", "/([0-9]+)$", 1).cast("long").alias("n"), "fault", F.md5(F.regexp_replace("body", "\n$", "").cast("binary")).alias("body_md5"))


@query("stored_once", f"WITH {Q._PAYLOADS} SELECT occurrence_id, message FROM i")
def stored_once(spark, d):
    """Every occurrence stored, a third of them delivered again by a later write, and all of them by one that ran twice."""
    at = folder(spark, "once")
    # five writes deliver these rows: payloads are made, checked and read for one of them
    found = staged(occurrences.identify(occurrences.browser_occurrences(occurrences.browser_events(Q.browser.parse(Q.payloads(spark, d))))), "found")
    part = F.pmod(F.crc32(F.col("occurrence_id").cast("binary")), F.lit(3)) == 0
    for name, rows in (("first", found.filter(~part)), ("second", found.filter(part)), ("third", found.filter(part)), ("all", found), ("all", found)):
        store.append(store.not_stored(rows, at, name), at, "error_occurrences", write_id=name)
    return store.read(spark, at, "error_occurrences").select("occurrence_id", "message")


@query("bucketed_errors_in_traces", SQL["errors_in_traces"])
def bucketed_errors_in_traces(spark, d):
    """errors_in_traces over tables in the same buckets by trace: neither side is moved."""
    rows, name = V.spans(spark, d).select("trace_id", "span_id", "is_error"), f"t{uuid.uuid4().hex}"
    buckets = traces_layout.buckets_for(V.table(spark, d, "lineitem").count())
    traces_layout.save(rows, f"{name}_spans", buckets)
    traces_layout.save(rows.filter("is_error"), f"{name}_occurrences", buckets)
    return traces_layout.errors_in_traces(spark, f"{name}_occurrences", f"{name}_spans").groupBy("trace_id").agg(F.count("*").alias("spans"))
