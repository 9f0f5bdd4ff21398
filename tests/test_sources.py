"""Bodies, faults of payloads, sketches, stored ids and bucketed traces."""

import gzip
import json
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeline.plans import sketches, store, traces_layout
from gaugeline.plans.staging import staged
from gaugeline.sources import bodies
from gaugeline.sources.issues import with_issues


def test_inflate():
    text = b'{"a":1}'
    for data in (text, gzip.compress(text), zlib.compress(text), gzip.compress(text[:3]) + gzip.compress(text[3:])):
        assert bodies.inflate(data, 7) == (text, None) and bodies.inflate(data, 6) == (None, bodies.TOO_LARGE)
    assert bodies.inflate(gzip.compress(text)[:-3], 100) == (None, bodies.BROKEN)
    assert bodies.inflate(gzip.compress(text) + b"rest", 100) == (None, bodies.BROKEN)
    assert bodies.inflate(b"", 10) == (b"", None)


def test_a_small_file_that_inflates_to_a_gigabyte():
    packer = zlib.compressobj(9)
    bomb = b"".join(packer.compress(bytes(1 << 24)) for _ in range(64)) + packer.flush()
    assert len(bomb) < 1 << 20
    tracemalloc.start()
    assert bodies.inflate(bomb, 1 << 20) == (None, bodies.TOO_LARGE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_bodies_of_files(spark, tmp_path):
    for name, data in (("a", b"plain"), ("b.gz", gzip.compress(b"zipped")), ("c", zlib.compress(b"x" * 99)), ("d", b"\xff\xfe"), ("e", b"y" * 51), ("f", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.body, r.fault) for r in bodies.read_bodies(spark, str(tmp_path), 50).collect()}
    assert got == {"a": ("plain", None), "b.gz": ("zipped", None), "c": (None, bodies.TOO_LARGE), "d": (None, bodies.BROKEN), "e": (None, bodies.TOO_LARGE)}


def test_written_bodies(spark, tmp_path):
    rows = [("1", "none", "plain\n"), ("2", "gzip", "zipped \u00e9"), ("3", "deflate", "x" * 60), ("4", "none", "y" * 60)]
    bodies.write_bodies(spark.createDataFrame(rows, "name string, codec string, body string"), f"{tmp_path}/in")
    assert gzip.decompress((tmp_path / "in/gzip/2").read_bytes()).decode() == "zipped \u00e9"
    got = {r.path.rpartition("/")[2]: (r.body, r.fault) for r in bodies.read_bodies(spark, f"{tmp_path}/in", 50).collect()}
    assert got == {"1": ("plain\n", None), "2": ("zipped \u00e9", None), "3": (None, bodies.TOO_LARGE), "4": (None, bodies.TOO_LARGE)}


def test_tasks_of_many_small_bodies(spark, tmp_path):
    """Listing and reading take far fewer tasks than there are files, also in a stream; the settings are put back."""
    for n in range(120):
        (tmp_path / f"in/{n}").mkdir(parents=True)
        (tmp_path / f"in/{n}/body").write_text(f"n{n}")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    with bodies.many_files(spark):
        stream = bodies.read_bodies(spark, f"{tmp_path}/in", streaming=True)
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert {r.body for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {f"n{n}" for n in range(120)}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(run.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= bodies.LISTING * spark.sparkContext.defaultParallelism


def test_issues_in_the_order_of_the_schema(spark):
    """One payload with seven faults gives the first five."""
    event = {"type": "message", "timestamp": "2024-01-01T00:00:00Z"}
    seven = {"events": [event | {"context": [1], "line": -1.5, "type": "x"}, 5], "sessionId": 3, "environment": "", "service": "s" * 201, "version": 2}
    rows = [
        ("good", json.dumps({"version": 1, "service": "s", "environment": "e", "events": [event | {"line": 3, "context": {}}]}), []),
        ("seven", json.dumps(seven), ["version:invalid_literal", "sessionId:invalid_type", "service:too_big", "environment:too_small", "events.0.type:invalid_enum_value"]),
        ("last", json.dumps({"version": 1, "service": "s", "environment": "e", "events": seven["events"]}), ["events.0.type:invalid_enum_value", "events.0.line:invalid_type", "events.0.line:too_small", "events.0.context:invalid_type", "events.1:invalid_type"]),
        ("many", json.dumps({"version": 1, "service": "s", "environment": "e", "events": [event] * 50 + [7]}), ["events:too_big", "events.50:invalid_type"]),
        ("empty", "{}", ["version:invalid_literal", "service:invalid_type", "environment:invalid_type", "events:invalid_type"]),
        ("nulls", json.dumps({"version": None, "service": "s", "environment": "e", "release": None, "events": [event | {"message": None, "timestamp": "noon"}]}), ["version:invalid_literal", "release:invalid_type", "events.0.timestamp:invalid_string", "events.0.message:invalid_type"]),
        ("list", "[]", [":invalid_type"]),
        ("broken", "{", None),
        ("none", None, None),
    ]
    got = with_issues(spark.createDataFrame([r[:2] for r in rows], "name string, value string")).collect()
    assert {r.name: r.issues and [f"{x.path}:{x.code}" for x in r.issues] for r in got} == {n: w for n, _, w in rows}


def test_sketches_merge(spark, tmp_path):
    rows = spark.range(20000).select(F.lit("o").alias("org_id"), F.lit("r").alias("repository_id"), F.when(F.col("id") % 10 == 0, "/a").otherwise("/b").alias("route"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 5 * 86400).alias("started_at"), (F.col("id") * 7919 % 20011).cast("double").alias("duration_ms"), (F.col("id") % 4000).cast("string").alias("trace_id"))
    for k in range(2):
        sketches.append(sketches.route_sketches(rows.filter(F.pmod(F.xxhash64("trace_id"), F.lit(2)) == k)), str(tmp_path), f"w{k}")
    sketches.append(sketches.route_sketches(rows.filter(F.pmod(F.xxhash64("trace_id"), F.lit(2)) == 1)), str(tmp_path), "w1")  # again, under its name
    stored = spark.read.parquet(f"{tmp_path}/route_sketches")
    assert stored.groupBy("route", store.PARTITION).count().agg(F.max("count")).first()[0] == 2
    whole = sketches.read(stored, "org_id").first()
    exact = rows.agg(F.percentile("duration_ms", [0.5, 0.95, 0.99])).first()[0]
    assert whole.sampled == 20000 and abs(whole.distinct - 4000) <= sketches.COUNT_ERROR * 4000
    assert all(abs(got - want) <= sketches.RANK_ERROR * 20011 for got, want in zip((whole.p50, whole.p95, whole.p99), exact, strict=True))
    assert sketches.read(stored.limit(0), "route").count() == 0
    none = sketches.read(sketches.route_sketches(rows.limit(3).withColumn("duration_ms", F.lit(None).cast("double"))), "org_id").first()
    assert (none.sampled, none.p50) == (0, None)


def occurrence(spark, i, day):
    return spark.sql(f"SELECT 'o' AS org_id, 'r' AS repository_id, '{i}' AS occurrence_id, 'f' AS fingerprint, 'browser' AS source, 's' AS service, 'e' AS environment, 'E' AS error_type, 'm' AS message, timestamp'{day} 10:00:00' AS occurred_at")


def test_a_delivery_repeated_two_days_later(spark, tmp_path):
    path = str(tmp_path)
    for name, rows in (("a", occurrence(spark, 1, "2024-01-01")), ("b", occurrence(spark, 2, "2024-01-03")), ("c", occurrence(spark, 1, "2024-01-01").union(occurrence(spark, 3, "2024-01-03")).union(occurrence(spark, 3, "2024-01-03")))):
        store.append(store.not_stored(rows, path, name), path, "error_occurrences", write_id=name)
    assert sorted(r.occurrence_id for r in store.read(spark, path, "error_occurrences").collect()) == ["1", "2", "3"]
    plan = store.not_stored(occurrence(spark, 1, "2024-01-01"), path, "d")._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-01" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # what a first try has left does not keep the second from storing it
    assert store.not_stored(occurrence(spark, 3, "2024-01-03"), path, "c").count() == 1


def test_buckets_by_trace_need_no_exchange(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 50 > 0, (F.col("id") % 40).cast("string")).alias("trace_id"), "id")
    traces_layout.save(rows, "spans_by_trace", 4)
    traces_layout.save(rows.filter("id < 10"), "occurrences_by_trace", 4)
    got = traces_layout.errors_in_traces(spark, "occurrences_by_trace", "spans_by_trace")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == rows.join(rows.filter("id < 10").select("trace_id").distinct(), "trace_id", "left_semi").count() > 0
    for t in ("spans_by_trace", "occurrences_by_trace"):
        spark.sql(f"DROP TABLE {t}")


def test_staged(spark):
    df = staged(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect()


@pytest.mark.parametrize("text", ["user \x85 1", "a" * 5000])
def test_texts_of_any_length_are_cut(spark, text):
    row = store.conform(occurrence(spark, 1, "2024-01-01").withColumn("message", F.lit(text)), "error_occurrences").first()
    assert row.message == text[:4000]


def test_fields_of_payloads_are_taken_out_at_once(spark):
    """No field is looked up by a path of its own, nor the kind of a whole event made; null, wrong and odd fields count as before."""
    from gaugeline.sources import browser

    event = {"type": "message", "timestamp": "2024-01-01T00:00:00Z"}
    odd = ([event], True), ([{**event, "message": 'a"}'}], True), ([{**event, "name": None}], False), ([7], False), ([event, None], False), ({"a": 1}, False), (None, False), ([event] * 51, False)
    rows = [(i, json.dumps({"version": 1, "service": "w}", "environment": "p", "events": events})) for i, (events, _) in enumerate(odd)]
    df = browser.sanitize(browser.parse(spark.createDataFrame(rows, "i int, value string")))
    got = {r.i: r for r in df.select("i", "valid", "clean").collect()}
    assert [got[i].valid for i in range(len(odd))] == [ok for _, ok in odd]
    assert json.loads(got[1].clean)["events"][0]["message"] == 'a"}' and json.loads(got[1].clean)["service"] == "w}"
    assert "$.type" not in df._jdf.queryExecution().analyzed().toString()
