import pytest
from pyspark.sql import functions as F

from gaugeline.config import Settings, positive_int
from gaugeline.operators import gate, sampling
from gaugeline.operators import occurrences as O  # noqa: E741
from gaugeline.plans import store
from gaugeline.streaming import jobs, sink, state


def test_settings():
    assert [positive_int(x, 7) for x in (None, "", "0", "-1", "x", "1.5", " 12px")] == [7, 7, 7, 7, 7, 1, 12]
    assert Settings.of({"SPANS_TTL_DAYS": "3"}).retention_days["spans"] == 3


def test_keys(spark):
    text = '[{"key":"a","orgId":"o","repositoryId":"r"},{"key":"","orgId":"o","repositoryId":"r"},{"key":"b","orgId":"o"},{"key":"c","orgId":"o","repositoryId":"r","scope":"client","allowedOrigins":["x"]}]'
    got = gate.parse_keys(spark.createDataFrame([(text,), ("no",)], "value string")).orderBy(F.desc(F.col("key") == "a"), "key").collect()
    assert [(r.key, r.scope, r.allowed_origins) for r in got] == [("a", "server", []), ("", "server", []), ("c", "client", ["x"])]
    rows = [("Bearer k ", "h", "q", "k"), ("Bearer ", "h", "q", None), ("Basic x", " h ", "q", "h"), (None, " ", "q", "q"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, h string, q string, want string")
    assert all(r.got == r.want for r in df.select("want", gate.extract_key(F.col("a"), F.col("h"), F.col("q")).alias("got")).collect())


def test_gate(spark):
    keys = spark.createDataFrame([("s", "o", "r", "server", []), ("c", "o", "r", "client", ["https://a"])], "key string, org_id string, repository_id string, scope string, allowed_origins array<string>")
    rows = [(1, None, "otlp", None), (2, "x", "otlp", None), (3, "c", "otlp", "https://a"), (4, "c", "browser", "https://b"), (5, "c", "browser", None), (6, "c", "browser", "https://a"), (7, "c", "browser", "https://a"), (8, "s", "otlp", None)]
    df = spark.createDataFrame(rows, "request_id int, key string, surface string, origin string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.request_id: r.status for r in gate.gate(df, keys, client_limit=1).collect()}
    assert got == {1: 401, 2: 401, 3: 403, 4: 403, 5: 403, 6: 202, 7: 429, 8: 202}
    assert {r.status for r in gate.gate(df, keys, configured=False).collect()} == {503}


def test_delivery_outcomes(spark):
    rows = [(200, 1, "delivered"), (400, 1, "permanent"), (408, 1, "retry"), (429, 12, "gave_up"), (503, 2, "retry")]
    df = spark.createDataFrame(rows, "s int, n int, want string").select("want", gate.delivery_outcome(F.col("s"), F.col("n")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def reference_tail(spans, most):
    """One trace after the other, as a buffer would do it."""
    kept, waiting, out = False, [], []
    for s in sorted(spans, key=lambda s: (s[3], s[0])):
        if kept:
            out.append(s[0])
        elif s[2]:
            out += [*waiting, s[0]]
            kept, waiting = True, []
        elif s[1] == "":
            waiting = []
        elif len(waiting) < most:
            waiting.append(s[0])
    return out


def test_tail_retention(spark):
    import random

    rng, rows, want = random.Random(1), [], []
    for t in range(60):
        own = [(f"{t}-{i:02}", "" if rng.random() < 0.25 else "p", rng.random() < 0.2, i) for i in range(rng.randint(1, 9))]
        rows += [(f"t{t}", *s) for s in own]
        want += reference_tail(own, 2)
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, is_error boolean, n int").withColumn("ended_at", F.timestamp_seconds(F.col("n") + 1704067200))
    assert sorted(r.span_id for r in sampling.tail_retained(df, kept=2).collect()) == sorted(want)


def test_head_sampling(spark):
    df = spark.range(20000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("trace_id"), (F.col("id") < 5).alias("m"))
    got = sampling.sample(df, F.col("m")).filter("sampled")
    assert 120 < got.count() < 290 and got.filter("m").count() == 5


def metric(spark, day, n):
    return spark.createDataFrame([("o", "r", "s", "e", None, "/", n)], "org_id string, repository_id string, service string, environment string, release string, route string, request_count double").withColumn("bucket_at", F.lit(day).cast("timestamp"))


def test_store(spark, tmp_path):
    path = str(tmp_path)
    for day, n in (("2024-01-05", 1.6), ("2024-03-05", 2.0), ("2024-03-05", -4.0)):
        store.append(metric(spark, day, n), path, "metrics_1m")
    rows = store.read(spark, path, "metrics_1m")
    got = {str(r.bucket_at.date()): r.request_count for r in O.merge_usage(rows).collect()}
    assert got == {"2024-01-05": 2, "2024-03-05": 2}
    own = store.for_tenant(rows, "metrics_1m", "o", "r", F.lit("2024-03-01").cast("timestamp"), F.lit("2024-04-01").cast("timestamp"))
    assert own.count() == 2
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.drop_expired(spark, path, "metrics_1m", 30, "2024-03-10") == ["202401"]
    assert store.read(spark, path, "metrics_1m").count() == 2
    assert store.conform(metric(spark, "2024-01-05", 1.0), "metrics_1m", {"org_id": "mine"}).first().org_id == "mine"


def test_migrations(spark, tmp_path):
    assert len(store.migrate(spark, str(tmp_path))) == 4 and store.migrate(spark, str(tmp_path)) == []


def test_read_of_older_files(spark, tmp_path):
    spark.createDataFrame([("o", "r", "c1", "f", "browser", "s", "e", "Error", "m")], "org_id string, repository_id string, occurrence_id string, fingerprint string, source string, service string, environment string, error_type string, message string").withColumn("event_date", F.lit("2024-01-01")).write.partitionBy("event_date").parquet(f"{tmp_path}/error_occurrences")
    row = store.read(spark, str(tmp_path), "error_occurrences").first()
    assert (row.severity, row.top_frames, row.method, row.status_code) == ("error", [], "", 0)


def envelope_rows(spark, n):
    d = spark.range(n).select(F.lit("o").alias("org_id"), F.lit("r").alias("repository_id"), F.col("id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("occurred_at"))
    e = d.filter("false")
    return d, e.withColumnRenamed("occurred_at", "bucket_at"), e.withColumnRenamed("occurred_at", "started_at")


def test_envelopes(spark):
    import json

    got = sink.envelopes(*envelope_rows(spark, 9), "d", rows=4).collect()
    assert sum(len(json.loads(r.body)["occurrences"]) for r in got) == 9 and 1 < len(got) <= 3
    assert {r.batch_id for r in got} == {r.batch_id for r in sink.envelopes(*envelope_rows(spark, 9), "d", rows=4).collect()}
    assert json.loads(got[0].body)["occurrences"][0]["occurred_at"].endswith("Z")


def finish(writer):
    assert writer.trigger(availableNow=True).start().awaitTermination(60)


def finish_state(spark, writer):
    assert state.start(writer.trigger(availableNow=True), spark).awaitTermination(120)


def test_streaming_dedupe(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "occurrence_id string, t string").select("occurrence_id", F.col("t").cast("timestamp").alias("occurred_at"))
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.deduplicate(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    finish(stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/c"))
    assert spark.table("deduped").count() == 2


def test_streaming_tails(spark, tmp_path):
    own = [("t1", "a", "p", False, 1), ("t1", "b", "p", True, 2), ("t1", "c", "", False, 3), ("t2", "d", "p", False, 1), ("t2", "e", "", False, 2), ("t2", "f", "p", True, 3)]
    df = spark.createDataFrame(own, "trace_id string, span_id string, parent_span_id string, is_error boolean, n int").withColumn("ended_at", F.timestamp_seconds(F.col("n") + 1704067200)).drop("n")
    df = df.withColumn("note", F.concat(F.lit("n-"), "span_id"))
    df.write.parquet(f"{tmp_path}/in")
    stream = state.retain_tails(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    finish_state(spark, stream.writeStream.format("memory").queryName("tails").option("checkpointLocation", f"{tmp_path}/c"))
    got = spark.table("tails").collect()
    assert sorted(r.span_id for r in got) == ["a", "b", "c", "f"]
    assert all(r.tail_retained and r.note == f"n-{r.span_id}" for r in got)


def test_captured_errors_rescue(spark, tmp_path):
    df = spark.sql("SELECT 't' AS trace_id, id AS span_id, 'p' AS parent_span_id, false AS is_error, id = 2 AS captured, timestamp_seconds(1704067200 + id) AS ended_at FROM range(4)")
    df.write.parquet(f"{tmp_path}/in")
    stream = state.retain_tails(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), captured="captured", most=1)
    finish_state(spark, stream.writeStream.format("memory").queryName("captured").option("checkpointLocation", f"{tmp_path}/c"))
    assert sorted(r.span_id for r in spark.table("captured").collect()) == [0, 2, 3]


def test_a_write_done_twice_is_stored_once(spark, tmp_path):
    row = "SELECT 'o' AS org_id, 'r' AS repository_id, 's' AS service, 'e' AS environment, '/' AS route, timestamp'2024-01-01' AS bucket_at, 2 AS request_count"
    for name in ("job-0", "job-0", "job-1", None):
        store.append(spark.sql(row), str(tmp_path), "metrics_1m", write_id=name)
    assert O.merge_usage(store.read(spark, str(tmp_path), "metrics_1m")).first().request_count == 6


def test_place_among_occurrences(spark):
    from gaugeline.sources.browser import parse

    events = ",".join(f'{{"type":"{t}","timestamp":"2024-01-01T00:00:01Z","message":"m","name":"n"}}' for t in ("session_start", "exception", "track_event", "message"))
    df = spark.createDataFrame([(f'{{"version":1,"service":"w","environment":"p","events":[{events}]}}', "o", "r")], "value string, org_id string, repository_id string")
    found = O.browser_occurrences(O.browser_events(parse(df)))
    assert [(r.type, r.batch_index) for r in found.orderBy("place").collect()] == [("exception", 0), ("message", 1)]


def test_streaming_ingestion(spark, tmp_path):
    text = '{"version":1,"service":"w","environment":"p","events":[{"type":"exception","timestamp":"2024-01-01T00:00:01Z","message":"m"},{"type":"session_start","timestamp":"2024-01-01T00:00:01Z"}]}'
    spark.createDataFrame([(text,)] * 2, "value string").write.text(f"{tmp_path}/in")
    from gaugeline.sources.browser import parse

    stream = parse(spark.readStream.text(f"{tmp_path}/in")).withColumns({"org_id": F.lit("o"), "repository_id": F.lit("r")})
    sent = []
    jobs.ingest_browser(stream, f"{tmp_path}/out", f"{tmp_path}/c", lambda rows, usage, epoch: sent.append((rows.count(), epoch))).awaitTermination()
    assert store.read(spark, f"{tmp_path}/out", "error_occurrences").count() == 2 and sent == [(2, 0)]
    usage = O.merge_usage(store.read(spark, f"{tmp_path}/out", "metrics_1m")).first()
    assert (usage.request_count, usage.session_count) == (2, 2)


@pytest.mark.parametrize("error,want", [(TimeoutError(), "timeout"), (OSError(), "connection_error"), (ValueError(), "error")])
def test_failure_reasons(error, want):
    assert sink.failure_reason(error) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hotspot_frames_counts_whole_defects(spark):
    import __spark_entry__ as e
    from gaugeline.queries import _found

    d = "/root/testdata/sf0.001"
    found = _found(spark, d)
    got = e.queries()["hotspot_frames"](spark, d).collect()
    assert sum(r.occurrences for r in got) == found.filter("first_frame != ''").count() == found.count()
    assert {r.first_frame: r.issues for r in got} == {r[0]: r[1] for r in found.groupBy("first_frame").agg(F.countDistinct("fingerprint")).collect()}


def test_tails_are_moved_once(spark):
    """Rows are parted by trace alone: neither removing repeated spans nor the windows move them again."""
    import __spark_entry__ as e

    plan = e.queries()["tail_retention"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trace_id") == 1
