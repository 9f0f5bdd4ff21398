"""Jobs that keep state from batch to batch: keys, limits, ingestion, delivery, merged parts; and ranks of hot groups."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions import instants
from gaugeline.operators import gate, ranks, sampling
from gaugeline.operators import occurrences as O  # noqa: E741
from gaugeline.plans import parts, store
from gaugeline.plans.versions import Versions
from gaugeline.streaming import delivery, ingest, jobs, sink, state


def batches(spark, path, schema, *groups):
    """A stream of these groups of rows, one micro-batch for each."""
    for rows in groups:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_state(spark, stream, tmp_path):
    writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    assert state.start(writer, spark).awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


AT = "2024-01-01 00:00:"


def test_limits_across_batches(spark, tmp_path):
    row = lambda i, k, s: (i, k, f"{AT}{s:02}", None)
    groups = [[row(1, "a", 1), row(2, "a", 2), row(3, "b", 1), row(4, None, 9)], [row(5, "a", 0), row(6, "b", 2), row(7, None, 9)], [(8, "a", "2024-01-01 00:01:00", "x"), row(9, "b", 3)]]
    raw = batches(spark, f"{tmp_path}/in", "id long, k string, t string, note string", *groups)
    stream = raw.withColumn("at", F.col("t").cast("timestamp")).drop("t")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = run_state(spark, state.limit_stream(stream, ["k"], "at", 2, "id"), tmp_path)
    assert {r.id: r.allowed for r in got} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 9: False}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before and got[0].asDict().keys() == {"id", "k", "note", "at", "allowed"}


def test_a_large_group_in_one_batch(spark, tmp_path):
    raw = batches(spark, f"{tmp_path}/in", "id long", [(i,) for i in range(500)])
    stream = raw.withColumns({"k": F.lit("k"), "at": F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 50)})
    got = run_state(spark, state.limit_stream(stream, ["k"], "at", 7, "id"), tmp_path)
    assert sorted(r.id for r in got if r.allowed) == [0, 50, 100, 150, 200, 250, 300] and len(got) == 500


def tail_rows():
    span = lambda t, s, p, bad, at, n=0: (t, s, p, bad, at, ["e"] * n)
    first = [span("a", "1", "p", False, 1), span("b", "1", "p", False, 1), span("c", "1", "p", False, 1), span("d", "1", "p", False, 1), span("e", "1", "", False, 1), span("", "1", "p", True, 1)]
    second = [span("a", "2", "p", False, 2, 1), span("b", "2", "", False, 2), span("c", "2", "p", True, 40), span("d", "2", "p", False, 2), span("d", "3", "p", False, 3), span("e", "2", "p", True, 2)]
    third = [span("a", "3", "p", False, 3), span("b", "3", "p", True, 3), span("c", "3", "", False, 41), span("d", "4", "p", True, 4), span("a", "4", "p", False, 60)]
    return first, second, third


def test_tails_over_batches(spark, tmp_path):
    """Exception events are errors, a healthy root drops what waits, a trace is forgotten after its lifetime, two spans wait at most."""
    raw = batches(spark, f"{tmp_path}/in", "trace_id string, span_id string, parent_span_id string, is_error boolean, n long, exceptions array<string>", *tail_rows())
    stream = raw.withColumn("ended_at", F.timestamp_seconds(F.col("n") + 1704067200))
    got = run_state(spark, state.retain_tails(stream, seconds=30, most=2), tmp_path)
    assert sorted((r.trace_id, r.span_id) for r in got) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "3"), ("c", "2"), ("c", "3"), ("d", "1"), ("d", "2"), ("d", "4"), ("e", "2")]
    assert all(r.tail_retained for r in got)


def test_batch_tails_see_exception_events(spark):
    rows = [("a", "1", "p", False, 1, []), ("a", "2", "p", False, 2, ["e"]), ("b", "1", "p", False, 1, [])]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, is_error boolean, n long, exceptions array<string>").withColumn("ended_at", F.timestamp_seconds("n"))
    assert sorted((r.trace_id, r.span_id, r.tail_retained) for r in sampling.tail_retained(df).collect()) == [("a", "1", True), ("a", "2", True)]


@pytest.mark.parametrize("n", [1, 4, 9])
def test_ranks_of_hot_groups(spark, n):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 2003).alias("o"))
    got = {r.id: r["rank"] for r in ranks.ranked(df, ["k"], ["o"], partitions=n).collect()}
    df.createOrReplaceTempView("hot")
    assert got == {r.id: r.r for r in spark.sql("SELECT id, row_number() OVER (PARTITION BY k ORDER BY o) AS r FROM hot").collect()}
    assert ranks.ranked(df.limit(0), ["k"], ["o"]).count() == 0
    with pytest.raises(ValueError):
        ranks.ranked(df.withColumn("_rank_at", F.lit(1)), ["k"], ["o"])


def test_no_task_has_much_of_a_hot_group(spark):
    """Half of all rows have one key: no partition ranks more than twice the middle one's rows."""
    df = spark.range(40000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    rows = ranks.ranked(df, ["k"], ["id"], partitions=8)
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "Window" in plan  # of the parts of groups, not of their rows
    sizes = sorted(r["count"] for r in df.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert rows.filter("k = 0").agg(F.max("rank"), F.countDistinct("rank")).first() == (20000, 20000)


def request(i, key, surface="browser", body=None, at="2024-01-01 00:00:00"):
    return (i, surface, f"Bearer {key}" if key else None, None, None, None, at, body or json.dumps({"version": 1, "service": "w", "environment": "p", "events": [{"type": "exception", "timestamp": "2024-01-01T00:00:01Z", "message": f"m{i}"}]}))


REQUEST = "request_id long, surface string, authorization string, key_header string, key_query string, origin string, t string, body string"


def requests_of(spark, path, *groups):
    return batches(spark, path, REQUEST, *groups).withColumn("received_at", F.col("t").cast("timestamp")).drop("t")


def test_ingestion_with_a_validator_that_goes(spark, tmp_path):
    """Cached keys stay good while the validator can't be reached, unknown ones are refused; nothing is asked twice in a minute."""
    asked = []

    def validator(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        if len(asked) == 3:
            raise ConnectionError
        known = F.col("key") != "bad"
        return keys.select("key", F.lit(True).alias("reachable"), F.when(known, F.concat(F.lit("o-"), "key")).alias("org_id"), F.when(known, "r").alias("repository_id"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("array<string>").alias("allowed_origins"))

    groups = [
        [request(1, "k"), request(2, "bad"), request(3, None)],
        [request(4, "k", at="2024-01-01 00:00:30"), request(5, "bad", at="2024-01-01 00:00:30"), request(6, "new", at="2024-01-01 00:00:30")],
        [request(7, "k", at="2024-01-01 00:05:00"), request(8, "late", at="2024-01-01 00:05:00"), request(9, "bad", at="2024-01-01 00:05:00")],
    ]
    stream = requests_of(spark, f"{tmp_path}/in", *groups)
    ingest.ingest_requests(stream, f"{tmp_path}/store", f"{tmp_path}/c", validator=validator).awaitTermination()
    assert asked == [["bad", "k"], ["new"], ["bad", "k", "late"]]
    found = store.read(spark, f"{tmp_path}/store", "error_occurrences")
    assert {(r.message, r.org_id) for r in found.collect()} == {("m1", "o-k"), ("m4", "o-k"), ("m6", "o-new"), ("m7", "o-k")}
    told = {r.request_id: (r.status, r.reason) for r in ingest.refusals(spark, f"{tmp_path}/store").collect()}
    assert told == {"3": (401, "missing ingest key")} | {i: (401, "invalid ingest key") for i in ("2", "5", "8", "9")}


def test_a_batch_of_ingestion_that_runs_again(spark, tmp_path):
    """The first try of the second batch fails behind its writes: the second try stores and counts everything once."""
    static = gate.parse_keys(spark.createDataFrame([('[{"key":"k","orgId":"o","repositoryId":"r"}]',)], "value string"))
    options = {"static": static, "settings": Settings(server_limit=3)}
    groups = [[request(1, "k"), request(2, "k")], [request(3, "k"), request(4, "k"), request(5, "k", body="{")], [request(6, "k", body='{"version":1}', at="2024-01-01 00:01:00")]]
    stream, tries = requests_of(spark, f"{tmp_path}/in", *groups), []

    def after(rows, usage, epoch):
        tries.append(epoch)
        if tries == [0, 1]:
            raise RuntimeError("the sink is gone")

    with pytest.raises(Exception, match="sink is gone"):
        ingest.ingest_requests(stream, f"{tmp_path}/store", f"{tmp_path}/c", after=after, **options).awaitTermination()
    ingest.ingest_requests(stream, f"{tmp_path}/store", f"{tmp_path}/c", after=after, **options).awaitTermination()
    assert tries == [0, 1, 1, 2]
    assert sorted(r.message for r in store.read(spark, f"{tmp_path}/store", "error_occurrences").collect()) == ["m1", "m2", "m3"]
    assert O.merge_usage(store.read(spark, f"{tmp_path}/store", "metrics_1m")).agg(F.sum("request_count")).first()[0] == 3
    told = {r.request_id: (r.reason, [tuple(x) for x in r.issues or []]) for r in ingest.refusals(spark, f"{tmp_path}/store").collect()}
    missing = [("service", "invalid_type"), ("environment", "invalid_type"), ("events", "invalid_type")]
    assert told == {"4": ("rate limit exceeded", []), "5": ("rate limit exceeded", []), "6": ("invalid payload", missing)}


def test_versions(spark, tmp_path):
    own = Versions(spark, str(tmp_path / "v"), "n long")
    assert own.before(0).count() == 0
    for k in (0, 1, 1, 5):
        own.write(k, own.before(k).unionByName(spark.createDataFrame([(k,)], "n long")))
    assert sorted(r.n for r in own.latest().collect()) == [0, 1, 5] and sorted(r.n for r in own.before(5).collect()) == [0, 1]


def clock(epoch):
    return F.lit(f"2024-01-01 00:{epoch:02}:00").cast("timestamp")


def envelopes(spark, *ids):
    return spark.createDataFrame([(i, "o", f"body {i}", 6) for i in ids], "batch_id string, org_id string, body string, bytes long").withColumns({"signals_from": clock(0), "signals_to": clock(0)})


def test_delivery_killed_between_send_and_settle(spark, tmp_path, monkeypatch):
    """What was sent but not settled is sent again under the same claim; what was enqueued meanwhile waits for its own round."""
    seen = spark.sparkContext.accumulator(0)

    def send(body, attempt):
        seen.add(1)
        return 503 if body == "body 2" and attempt == 1 else 200

    queue = delivery.Queue(spark, str(tmp_path), send, base=1.0)
    queue.enqueue(envelopes(spark, "1", "2"), clock(0), "a")
    queue.enqueue(envelopes(spark, "1", "2"), clock(0), "a")  # once more under the same name
    claim = queue.claim(clock(0), 0)
    assert {(r.batch_id, r.attempt) for r in claim.collect()} == {("1", 1), ("2", 1)}
    settle, killed = delivery.Queue._failing, []

    def kill(self):
        killed.append(1)
        raise KeyboardInterrupt

    monkeypatch.setattr(delivery.Queue, "_failing", kill)
    with pytest.raises(KeyboardInterrupt):
        queue.deliver(clock(0), 0)
    monkeypatch.setattr(delivery.Queue, "_failing", settle)
    queue.enqueue(envelopes(spark, "3"), clock(0), "b")
    queue.deliver(clock(0), 0)
    queue.deliver(clock(0), 0)  # settled already
    now = {r.batch_id: (r.outcome, r.attempts, r.reason) for r in queue.state().collect()}
    assert now == {"1": ("delivered", 1, None), "2": ("retry", 1, "http_503"), "3": ("queued", 0, None)} and seen.value == 2
    queue.deliver(clock(1), 1)
    assert {r.outcome for r in queue.state().collect()} == {"delivered"} and queue.claim(clock(2), 2).count() == 0
    told = queue.stats().first()
    assert (told.delivered, told.retried, told.dropped_permanent, told.consecutive_failures, told.queued, told.last_failure_reason) == (3, 1, 0, 0, 0, "http_503")


def test_delivery_gives_up_and_waits(spark, tmp_path):
    def send(body, attempt):
        if body == "body bad":
            return 400
        raise TimeoutError

    queue = delivery.Queue(spark, str(tmp_path), send, attempts=3, base=60.0, cap=100.0)
    queue.enqueue(envelopes(spark, "bad", "down"), clock(0), "a")
    for epoch in (0, 0, 1, 2, 3, 4, 5):
        queue.deliver(clock(epoch), epoch)
    got = {r.batch_id: (r.outcome, r.attempts, r.reason) for r in queue.state().collect()}
    assert got == {"bad": ("permanent", 1, "http_400"), "down": ("gave_up", 3, "timeout")}
    tries = queue._read("attempts", delivery.SETTLED).filter("batch_id = 'down'").orderBy("attempt").collect()
    waits = [(r.next_at - r["at"]).total_seconds() for r in tries[:2]]
    assert 30 <= waits[0] <= 60 and 50 <= waits[1] <= 100 and tries[2].next_at is None
    told = queue.stats().first()
    assert (told.delivered, told.dropped_permanent, told.retried, told.consecutive_failures, told.queued) == (0, 2, 2, 4, 0)
    queue.enqueue(envelopes(spark, "new"), clock(9), "b")
    queue.compact("c")
    assert [r.batch_id for r in queue.queued().collect()] == ["new"]


def usage(spark, day, n, route="/"):
    return spark.createDataFrame([("o", "r", "s", "e", "", route, n, 0, 0.0, 0)], "org_id string, repository_id string, service string, environment string, release string, route string, request_count long, error_count long, duration_sum_ms double, session_count long").withColumn("bucket_at", F.lit(day).cast("timestamp"))


def test_merged_parts(spark, tmp_path):
    path = str(tmp_path)
    for k in range(6):
        store.append(usage(spark, "2024-01-05", k + 1), path, "metrics_1m", write_id=f"job-{k}")
    store.append(usage(spark, "2024-02-05", 7), path, "metrics_1m", write_id="job-0b")
    before = store.read(spark, path, "metrics_1m")
    assert parts.merge(spark, path, "metrics_1m") == {"202401": 6}
    after = store.read(spark, path, "metrics_1m")
    assert sorted(r.request_count for r in before.collect()) == [1, 2, 3, 4, 5, 6, 7]  # planned before the merge: the parts
    assert sorted(r.request_count for r in after.collect()) == [7, 21] and len(parts.live(spark, path, "metrics_1m")) == 2
    assert parts.merge(spark, path, "metrics_1m") == {}
    for k in range(5):
        store.append(usage(spark, "2024-01-05", 100, f"/{k % 2}"), path, "metrics_1m", write_id=f"later-{k}")
    assert parts.merge(spark, path, "metrics_1m") == {"202401": 6}
    assert sorted(r.request_count for r in store.read(spark, path, "metrics_1m").collect()) == [7, 21, 200, 300]
    assert parts.vacuum(spark, path, "metrics_1m") == 12 and parts.vacuum(spark, path, "metrics_1m") == 0
    assert sorted(r.request_count for r in store.read(spark, path, "metrics_1m").collect()) == [7, 21, 200, 300]


def test_a_merge_that_is_not_published(spark, tmp_path, monkeypatch):
    """A merge that dies before its version is written shows nothing of itself; the next one does its work."""
    path = str(tmp_path)
    for k in range(5):
        store.append(usage(spark, "2024-01-05", 1), path, "metrics_1m", write_id=f"job-{k}")
    with monkeypatch.context() as m:
        m.setattr(Versions, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            parts.merge(spark, path, "metrics_1m")
    assert [r.request_count for r in store.read(spark, path, "metrics_1m").collect()] == [1] * 5
    parts.merge(spark, path, "metrics_1m")
    assert [r.request_count for r in store.read(spark, path, "metrics_1m").collect()] == [5]


def test_merged_occurrences_are_kept_once(spark, tmp_path):
    path = str(tmp_path)
    row = lambda i: spark.sql(f"SELECT 'o' AS org_id, 'r' AS repository_id, '{i}' AS occurrence_id, 'f' AS fingerprint, 'browser' AS source, 's' AS service, 'e' AS environment, 'E' AS error_type, 'm' AS message, timestamp'2024-01-05 10:00:00' AS occurred_at")
    for k in range(6):
        store.append(row(k % 4), path, "error_occurrences", write_id=f"job-{k}")
    assert parts.merge(spark, path, "error_occurrences") == {"2024-01-05": 6}
    assert sorted(r.occurrence_id for r in store.read(spark, path, "error_occurrences").collect()) == ["0", "1", "2", "3"]


def test_other_time_zones(spark, tmp_path):
    """Days, minutes and texts are of UTC whatever the session's zone is: a reader of another zone prunes nothing of its own away."""
    day = spark.sql("SELECT timestamp_seconds(1704067200) AS at UNION ALL SELECT timestamp_micros(1710037800123456)")  # the second lies in a gap of New York's clock
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = sorted(tuple(r) for r in day.select(instants.utc_text(F.col("at")), instants.utc_partition(F.col("at"), "yyyyMM"), F.unix_seconds(instants.utc_minute(F.col("at")))).collect())
        assert got == [("2024-01-01T00:00:00.000Z", "202401", 1704067200), ("2024-03-10T02:30:00.123Z", "202403", 1710037800)]
        rows = usage(spark, "2024-01-05", 1).withColumn("bucket_at", F.timestamp_seconds(F.lit(1704067200)))
        store.append(rows, str(tmp_path), "metrics_1m")
        body = sink.envelopes(rows.limit(0).withColumnRenamed("bucket_at", "occurred_at"), rows, rows.limit(0).withColumnRenamed("bucket_at", "started_at"), "d").first().body
        assert json.loads(body)["metrics"][0]["bucket_at"] == "2024-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    own = store.for_tenant(store.read(spark, str(tmp_path), "metrics_1m"), "metrics_1m", "o", "r", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    assert own.count() == 1 and store.read(spark, str(tmp_path), "metrics_1m").first()[store.PARTITION] == "202401"


def test_a_key_listed_twice(spark):
    text = '[{"key":"k","orgId":"o1","repositoryId":"r"},{"key":"k","orgId":"o2","repositoryId":"r","scope":"client"}]'
    keys = gate.parse_keys(spark.createDataFrame([(text,)], "value string"))
    assert [(r.key, r.org_id, r.scope) for r in keys.collect()] == [("k", "o2", "client")]
    one = spark.createDataFrame([(1, "k", "browser", None)], "request_id int, key string, surface string, origin string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert gate.gate(one, keys.unionByName(keys)).count() == 1
    twice = keys.unionByName(keys.withColumn("org_id", F.lit("o0")))
    resolved, _ = gate.resolve_keys(one.select("key"), twice, spark.createDataFrame([], f"{gate.KEYS}, expires_at timestamp"), keys.limit(0).withColumn("reachable", F.lit(True)), F.current_timestamp())
    assert resolved.count() == 1


def test_repeated_attribute_keys(spark):
    from gaugeline.functions import attributes as A

    bag = [("ai.a", "1"), ("x", "0"), ("ai.b", "2"), ("ai.a", "3")]
    df = spark.createDataFrame([(bag,), ([],)], f"bag {A.BAG}")
    assert [r[0] for r in df.select(A.subset(F.col("bag"), ("ai.",))).collect()] == ['{"ai.a":"3","ai.b":"2"}', "{}"]
    assert [r[0] for r in df.select(A.lookup(F.col("bag"))).collect()] == [dict(bag), {}]


def test_attributes_without_key_or_value(spark):
    from gaugeline.functions import attributes as A

    df = spark.createDataFrame([(0, [("ai.a", None), (None, "1"), ("ai.b", "é\"\n"), (None, "2")]), (1, None)], f"id int, bag {A.BAG}").orderBy("id")
    got = df.select(A.lookup(F.col("bag")), A.subset(F.col("bag"), ("ai.",)), A.subset(F.col("bag"), ("ai.",), total=None)).collect()
    assert got[0][0] == {"ai.a": None, "ai.b": "é\"\n"} and got[1][0] is None
    assert got[0][1] == got[0][2] == '{"ai.b":"é\\"\\n"}' and got[1][1] is None and got[1][2] is None


def test_subset_ends_with_the_first_that_does_not_fit(spark):
    from gaugeline.functions import attributes as A

    bag = [("ai.a", "x" * 6), ("ai.b", "y" * 60), ("ai.c", "z")]
    df = spark.createDataFrame([(bag,)], f"bag {A.BAG}")
    some, every, cut = df.select(A.subset(F.col("bag"), ("ai.",), 99, 20), A.subset(F.col("bag"), ("ai.",), 99, None), A.subset(F.col("bag"), ("ai.",), 2, 18)).first()  # cut, they take 7, 7 and 5
    assert some == '{"ai.a":"xxxxxx"}' and every.count("ai.") == 3 and cut == '{"ai.a":"xx…","ai.b":"yy…"}'


def test_jobs_that_run_on(spark, tmp_path):
    stream = batches(spark, f"{tmp_path}/in", "id long", [(1,)])
    seen = []
    query = jobs.run(stream, lambda batch, epoch: seen.append(batch.count()), f"{tmp_path}/c", every="1 second")
    try:
        query.processAllAvailable()
        spark.createDataFrame([(2,), (3,)], "id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
        assert query.isActive and seen == [1, 2]
    finally:
        query.stop()


def test_batches_are_dealt_into_files(spark, tmp_path, monkeypatch):
    from gaugeline import job_queries as J

    monkeypatch.setattr(J, "FILE_ROWS", 10)
    df = spark.range(0, 330, 1, 3).withColumn("text", F.repeat(F.lit("x"), 9))
    stream = J.dealt(df, f"{tmp_path}/in", F.when(F.col("id") < 300, F.col("id") % 3), 3)
    files = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.countDistinct(F.col("id") % 3).alias("batches")).collect()
    assert len(files) == 30 and max(r.n for r in files) < 30 and {r.batches for r in files} == {1}
    seen = []
    jobs.run(stream, lambda batch, epoch: seen.append((epoch, batch.count(), batch.agg(F.collect_set(F.col("id") % 3)).first()[0])), f"{tmp_path}/c").awaitTermination()
    assert seen == [(k, 100, [k]) for k in range(3)]
    # too few rows of one batch: one file for each
    few = J.dealt(df.filter("id < 25"), f"{tmp_path}/few", F.when(F.col("id") < 24, 0).otherwise(1), 2)
    sizes = []
    jobs.run(few, lambda batch, epoch: sizes.append(batch.count()), f"{tmp_path}/d").awaitTermination()
    assert sizes == [24, 1]


def test_buckets_hold_so_many_rows(spark):
    from gaugeline.plans import traces_layout as L

    assert [L.buckets_for(n) for n in (0, 4_000_000, 4_000_001, 216_000_000)] == [8, 8, 16, 512]
    assert all(n / L.buckets_for(n) <= L.BUCKET_ROWS for n in range(1, 10**8, 999_999))


def test_payloads_are_read_once_for_all_writes(spark, monkeypatch):
    from gaugeline import job_queries

    plans = []
    monkeypatch.setattr(store, "not_stored", lambda df, *_: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    job_queries.stored_once(spark, "/root/testdata/sf0.001")
    assert len(plans) == 5 and not any("parse_json" in p.lower() for p in plans)


def test_payloads_are_read_once_for_both_deliveries(spark, monkeypatch):
    from gaugeline import request_queries

    plans, union = [], type(spark.range(1)).unionByName
    monkeypatch.setattr(type(spark.range(1)), "unionByName", lambda a, b, *rest, **more: plans.append(a._jdf.queryExecution().optimizedPlan().toString()) or union(a, b, *rest, **more))
    out = request_queries.stream_dedupe(spark, "/root/testdata/sf0.001")
    assert plans and not any("parse_json" in p.lower() for p in plans)
    assert out.count() == out.select("occurrence_id").distinct().count() > 0
