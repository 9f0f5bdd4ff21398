import json
import struct

from pyspark.sql import functions as F

from gaugeline.operators import occurrences as O  # noqa: E741
from gaugeline.operators import traces as R
from gaugeline.sources import browser as B
from gaugeline.sources import requests as Q

AT = "2026-08-16T02:02:00.000Z"


def payload(*events, **more):
    return json.dumps({"version": 1, "sessionId": "s", "service": "web", "environment": "prod", "events": list(events)} | more)


def event(kind="exception", **more):
    return {"type": kind, "timestamp": AT, "message": "m"} | more


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string").withColumns({"org_id": F.lit("o"), "repository_id": F.lit("r")})


def test_browser_golden(spark):
    events = [event() for _ in range(4)] + [event("unhandled_rejection"), event("message"), event("session_start"), event("track_event", name="clicked")]
    rows = O.browser_events(B.parse(frame(spark, payload(*events))))
    assert O.browser_occurrences(rows).count() == 6
    usage = {r.route: (r.request_count, r.error_count, r.session_count) for r in O.browser_usage(rows).collect()}
    assert usage == {"": (6, 5, 1), "event:clicked": (1, 0, 0)}


def test_browser_groups(spark):
    events = [event(stack="at f (a.js:1:2)", route="/x?q=1", filename="a.js?v", line=3, context={"a": 1})] * 4 + [event("unhandled_rejection", stack="at g (b.js:1:2)")]
    found = O.identify(O.browser_occurrences(O.browser_events(B.parse(frame(spark, payload(*events))))).withColumn("batch_index", F.col("place")))
    assert sorted(r["count"] for r in found.groupBy("fingerprint").count().collect()) == [1, 4]
    assert found.select("occurrence_id").distinct().count() == 5
    first = found.orderBy("place").first()
    assert json.loads(first.attributes) == {"filename": "a.js", "line": 3, "context": {"a": 1}} and first.route == "/x" and first.error_type == "Error"


def test_validation(spark):
    good = [payload(event()), payload(), payload(event(line=3, context={}))]
    bad = [
        payload(event(severity=None)), payload(event(message=5)), payload(event(), event("x")), payload(event(timestamp="today")), payload(event(line=-1)), payload(event(line=1.5)), payload(event(context=[1])),
        payload(event(name="n" * 201)), payload(*[event()] * 51), payload(version=2), payload(service=""), payload(release=None), "no json", "[]", "null", payload(events="x"), payload(event(timestamp="2026-13-01T00:00:00Z")),
    ]
    got = B.parse(frame(spark, *good, *bad)).orderBy("n").collect()
    assert [r.valid for r in got] == [True] * len(good) + [False] * len(bad)
    assert all(r.payload is None for r in got[len(good) :])


def test_relay(spark):
    texts = [payload(event(severity="loud", name=7, route="/a?b", stack="s" * 33000, cookie="c", line=2), secret=1), payload(event(), service=5), payload({"type": "x"}), "nope", None, payload(event(message="m" * 70000))]
    got = [r.clean and json.loads(r.clean) for r in B.sanitize(frame(spark, *texts)).orderBy("n").collect()]
    e = got[0]["events"][0]
    assert "secret" not in got[0] and "cookie" not in e and "severity" not in e and "name" not in e
    assert e["route"] == "/a" and len(e["stack"]) == 32000 and e["line"] == 2
    assert got[1:] == [None] * 5


def attrs(**kv):
    kinds = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}
    return [{"key": k.replace("__", "."), "value": {kinds[type(v)]: v}} for k, v in kv.items()]


def trace(kind, spans_attrs=None, code=0, exception=None):
    span = {"traceId": "T1", "spanId": "a", "name": "n", "kind": kind, "startTimeUnixNano": "1755309720000000000", "endTimeUnixNano": "1755309720250000000", "attributes": spans_attrs or [], "status": {"code": code}}
    if exception is not None:
        span["events"] = [{"timeUnixNano": "1755309720100000000", "name": "exception", "attributes": exception}]
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attrs(service__name="svc")}, "scopeSpans": [{"spans": [span]}]}]})


def totals(spark, text):
    rows = R.span_rows(Q.parse_json(frame(spark, text), "traces").drop("value", "n"))
    found = R.occurrences(rows)
    usage = O.merge_usage(R.span_usage(rows, found)).agg(F.sum("request_count"), F.sum("error_count"), F.sum("duration_sum_ms")).first()
    return found.collect(), tuple(usage)


def test_internal_exception(spark):
    found, usage = totals(spark, trace(1, code=2, exception=attrs(exception__type="TypeError", exception__message="boom")))
    assert [(r.error_type, r.message, r.severity) for r in found] == [("TypeError", "boom", "error")] and usage[:2] == (1, 1)


def test_server_exception_counts_once(spark):
    found, usage = totals(spark, trace(2, attrs(http__route="/api/boom", http__response__status_code=500), exception=attrs(exception__type="E")))
    assert len(found) == 1 and usage == (1, 1, 250.0) and found[0].route == "/api/boom" and found[0].status_code == 500


def test_warning(spark):
    found, usage = totals(spark, trace(1, attrs(vendor__severity="warning"), exception=attrs(exception__message="x")))
    assert found[0].severity == "warning" and found[0].error_type == "Error" and usage[:2] == (1, 0)


def test_unhandled_is_fatal(spark):
    found, _ = totals(spark, trace(1, attrs(vendor__unhandled=True, vendor__severity="error"), code=2))
    assert (found[0].severity, found[0].message) == ("fatal", "n")


def test_metrics(spark):
    def metric(name, temporality, unit="ms", **a):
        return {"name": name, "unit": unit, "histogram": {"aggregationTemporality": temporality, "dataPoints": [{"timeUnixNano": "1755309720000000000", "count": "3", "sum": 1.5, "attributes": attrs(**a)}]}}

    metrics = [metric("http.server.duration", 1, http__route="/a/1"), metric("http.server.request.duration", 1, "s", http__response__status_code=503), metric("http.server.duration", 2), metric("other", 1)]
    text = json.dumps({"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"metrics": metrics}]}]})
    got = sorted(tuple(r) for r in R.metric_usage(Q.parse_json(frame(spark, text), "metrics").drop("value")).select("route", "request_count", "error_count", "duration_sum_ms").collect())
    assert got == [("", 3, 3, 1500.0), ("/a/:id", 3, 0, 1.5)]


def field(number, data):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(data, int):
        return varint(number << 3) + varint(data & (1 << 64) - 1)
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_protobuf(spark):
    fixed = lambda n, v: bytes([n << 3 | 1]) + struct.pack("<Q", v)
    pair = lambda k, v: field(1, k.encode()) + field(2, v)
    span = field(1, bytes.fromhex("AB" * 16)) + field(2, b"\x01\xff") + field(5, b"n") + field(6, 2) + fixed(7, 1755309720000000000) + fixed(8, 1755309720250000000) + field(9, pair("k", field(3, -5))) + field(15, field(3, 2)) + field(99, b"?")
    request = field(1, field(1, field(1, pair("service.name", field(1, b"svc")))) + field(2, field(2, span)))
    df = spark.createDataFrame([(0, bytearray(request)), (1, bytearray(b"\x0a\xff")), (2, None)], "n int, value binary").withColumns({"org_id": F.lit("o"), "repository_id": F.lit("r")})
    got = Q.parse_protobuf(df, "traces").orderBy("n")
    assert [r.request is None for r in got.collect()] == [False, True, True]
    row = R.span_rows(got.filter("request is not null").drop("value")).first()
    assert (row.trace_id, row.span_id, row.kind, row.status, row.duration_ms, row.service, row.bag[0].value) == ("ab" * 16, "01ff", "server", "error", 250.0, "svc", "-5")


def test_spans_carry_no_more_than_their_own_parts(spark):
    attributes = [("http.route", "/a"), ("http.route", ""), ("http.route", None), ("http.method", "GET"), ("vendor.x", "é" * 501)]
    kv = [{"key": k, "value": {"stringValue": v} if v is not None else {}} for k, v in attributes]
    times = [("1704067200000000001", "1704067200001000001"), ("18446744073709551615", "18446744073709551615"), ("999999.5", " 3000000 "), ("x", "1")]
    spans = [{"traceId": "A", "spanId": "B", "startTimeUnixNano": a, "endTimeUnixNano": b, "attributes": kv if i == 0 else []} for i, (a, b) in enumerate(times)]
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": v}} for v in ("old", "new")]}
    text = json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": spans}]}, {"scopeSpans": [{"spans": spans[:1]}]}]})
    df = R.span_rows(Q.parse_json(frame(spark, text), "traces").drop("value"))
    rows = df.orderBy("place").collect()
    assert [r.service for r in rows] == ["new"] * 4 + ["unknown"] and rows[0].route == "" and rows[0].method == "GET"
    assert json.loads(rows[0].attributes) == {"http.route": "", "http.method": "GET", "vendor.x": "é" * 500 + "…"}
    assert [r.duration_ms for r in rows[:4]] == [1.0, 0.0, 2.0, 0.0]
    assert [r.t for r in df.select(F.unix_millis("started_at").alias("t"), "place").orderBy("place").collect()] == [1704067200000, 18446744073709, 1, None, 1704067200000]
    plan = df.select("span_id", "service", "route")._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.split("\n") if "Generate explode" in line]
    # the resource is looked up below the spans, and no whole span is carried along behind them
    assert len(generators) == 2 and "span#" not in generators[0].split("[")[0] and plan.index("service.name") > plan.index("posexplode(s#")


def test_lines_are_dealt_into_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """A task sorts and groups the lines of its part, however many there are in all and however well they compress."""
    from gaugeline import request_queries as queries

    spark.range(20000).selectExpr(
        "id div 4 AS l_orderkey", "id % 50 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id % 4 AS int) AS l_linenumber", "1.0D AS l_quantity", "2.0D AS l_extendedprice", "timestamp '2024-01-01' AS l_shipdate", "'R' AS l_returnflag"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5000).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "LINES_OF_PART", 1000, raising=False)
    made = queries.trace_requests(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in made.groupBy("part").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) * 4 <= 2 * 1000
    assert made.selectExpr("sum(size(split(value, 'traceId')) - 1) AS n").first().n == 20000


def test_protobuf_is_read_many_at_once(spark):
    """What `columns` gives is what `decode` gives, message by message; what is odd is left to that, and has no struct."""
    import random

    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from gaugeline.schemas import TRACES
    from gaugeline.sources import wire

    form = to_arrow_type(T._parse_datatype_string(TRACES))

    def whole(x, kind):
        if x is None:
            return None
        if pa.types.is_struct(kind):
            return {f.name: whole(x.get(f.name), f.type) for f in kind}
        return [whole(y, kind.value_type) for y in x] if pa.types.is_list(kind) else x

    kv = [{"key": "k", "value": v} for v in ({"stringValue": "é" * 200}, {"intValue": "-5"}, {"boolValue": True}, {"doubleValue": -0.5}, {})]
    event = {"timeUnixNano": str(2**64 - 1), "name": "exception", "attributes": kv}
    spans = [{"traceId": "ab" * 16, "spanId": "01ff", "name": "", "kind": i, "startTimeUnixNano": "1", "attributes": kv[: i % 6], "status": {"code": 2} if i % 2 else {}, "events": [event] * (i % 3)} for i in range(20)]
    resource = {"attributes": kv}
    sound = [wire.encode({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": spans[:i]}, {"spans": spans[i:]}]}] * (i % 3)}, wire.TRACE_REQUEST) for i in range(20)] + [b""]
    in_span = lambda raw: field(1, field(2, field(2, raw)))
    odd = [b"\x0a\xff", b"\x08\x01", b"\x0b", in_span(field(6, 1 << 40)), in_span(field(1, 3)), in_span(field(15, field(3, 2)) + field(15, b"")), sound[1][:-1]]
    # of single fields the last counts, unknown ones are skipped, and what is no UTF-8 is replaced
    plain = [in_span(field(5, b"a") + field(5, b"b\xff") + field(99, b"?") + field(98, 1 << 63))]
    random.seed(1)
    cut = []
    for _ in range(2000):
        raw = bytearray(random.choice(sound))
        for _ in range(random.randint(1, 3)):
            i = random.randrange(len(raw) + 1)
            raw[i : i + random.randint(0, 2)] = random.randbytes(random.randint(0, 2))
        cut.append(bytes(raw))
    rows = [*sound, *plain, *odd, None, *cut]
    got, strange = wire.columns(pa.array(rows, pa.binary()).slice(1), wire.TRACE_REQUEST, form)
    got.validate(full=True)
    known = len(sound) + len(plain)
    assert list(strange[: known + len(odd)]) == [False] * (known - 1) + [True] * len(odd) + [False] and 0 < sum(~strange[known + len(odd) :]) < len(cut)
    for raw, o, x in zip(rows[1:], strange, got.to_pylist()):
        assert x == (None if o or raw is None else whole(wire.decode(raw, wire.TRACE_REQUEST), form))
    assert len(wire.columns(pa.array([], pa.binary()), wire.TRACE_REQUEST, form)[0]) == 0

    # both ways together, as requests, equal what JSON of each message gives
    import pandas as pd

    def as_json(raw):
        try:
            return None if raw is None else json.dumps(wire.decode(raw, wire.TRACE_REQUEST))
        except ValueError:
            return None

    few = rows[: known + len(odd) + 300]
    df = spark.createDataFrame(pd.DataFrame({"n": range(len(few)), "value": few, "text": [as_json(x) for x in few]}), "n int, value binary, text string")
    both = Q.parse_protobuf(df, "traces").withColumn("want", F.from_json("text", TRACES)).cache()
    assert both.count() == len(few) and both.filter(~F.col("request").eqNullSafe(F.col("want"))).count() == 0
    assert both.filter("request is null and value is not null").count() > 0


def test_protobuf_requests_are_written_by_columns(spark, tmp_path):
    """The bytes are those that the JSON requests have, one by one, and no Python writes them."""
    from gaugeline import request_queries as queries
    from gaugeline.sources import wire

    big = 9 * 10**17
    spark.range(3000).selectExpr(
        "IF(id < 1500, id div 4, IF(id < 2900, 7000, id * 900000000000000)) AS l_orderkey", "id * 7 % 1001 AS l_partkey", "id % 30 AS l_suppkey", "CAST(id % 7 AS int) + 1 AS l_linenumber", "CAST(id % 50 AS double) AS l_quantity", "2.0D AS l_extendedprice",
        "timestamp '2024-01-01' + make_interval(0, 0, 0, CAST(id % 40 AS int)) AS l_shipdate", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey", "l_orderkey % 20 AS o_custkey").distinct().write.parquet(f"{tmp_path}/orders.parquet")
    texts = {r.request_id: r for r in queries.trace_requests(spark, str(tmp_path)).collect()}
    got = queries.trace_messages(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == len(texts) > 300 and max(len(r.value) for r in rows) > 1 << 16 and max(texts) > big
    for r in rows:
        text = texts[r.request_id]
        assert (r.org_id, r.repository_id, bytes(r.value)) == (text.org_id, text.repository_id, wire.encode(json.loads(text.value), wire.TRACE_REQUEST))
    plan = queries.otlp_protobuf_spans(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1


def test_occurrences_are_compiled(spark, tmp_path):
    """The JVM compiles no method of more than 8000 bytes: it would run it step by step, several times slower."""
    R.span_rows(Q.parse_json(frame(spark, trace(1, code=2)).withColumn("request_id", F.col("n")), "traces").drop("value", "n")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.occurrences(rows)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    made = debug.codegenStringSeq(plan)
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert len(sizes) > 2 and max(sizes) < 8000


def test_spans_of_a_batch_are_staged_not_cached(spark, tmp_path):
    """A batch of any size goes through tables, not through Spark's cache; they go when it is stored."""
    import glob

    from gaugeline.plans import store
    from gaugeline.streaming import jobs

    texts = [trace(2, attrs(http__route="/a"), code=2), trace(1, attrs(gen_ai__request__model="m"), exception=attrs(exception__message="x"))]
    made = frame(spark, *texts).withColumnRenamed("n", "request_id")
    made.write.parquet(f"{tmp_path}/in")
    shared = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/spans-*"
    seen = []
    after = lambda found, usage, epoch: seen.append((found.count(), usage.count(), spark.sparkContext._jsc.getPersistentRDDs().size(), len(glob.glob(shared))))
    parsed = Q.parse_json(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in"), "traces").drop("value")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    jobs.ingest_traces(parsed, f"{tmp_path}/store", f"{tmp_path}/progress", after).awaitTermination()
    assert seen == [(2, 2, cached, 1)] and glob.glob(shared) == []
    counts = {t: store.read(spark, f"{tmp_path}/store", t).count() for t in ("spans", "error_occurrences", "llm_calls")}
    assert counts == {"spans": 2, "error_occurrences": 2, "llm_calls": 1}
