"""The gated ingestion job: raw requests with keys on one side, stored rows and refusals on the other.

A request has request_id, surface (traces, metrics or browser), authorization, key_header, key_query, origin, received_at and
body. Each micro-batch extracts the keys, resolves them against the static keys and the table of cached answers (asking the
validator only for what is neither static nor fresh), checks scope, origin and rate, parses what is let through and stores
it with its tenant. Cached keys and the counters of the minutes are versions of small tables, one for each epoch, and all
rows are written under a name made of job and epoch: a batch that runs again finds what the first try found, and replaces
what it wrote. Where a table can't be written the batch fails as a whole and runs again, as a sender would that is told to
come back.

The path has the four tables, `refusals` (request_id, status, reason, issues) and, under `_gate`, the versions.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import calls as C
from ..operators import gate as G
from ..operators import occurrences as O  # noqa: E741
from ..operators import traces as R
from ..plans import store
from ..plans.versions import Versions
from ..sources import browser, requests
from ..sources.issues import ISSUE, with_issues
from . import jobs

Validator = Callable[[DataFrame], DataFrame]
CACHE = f"{G.KEYS}, expires_at timestamp"
COUNTS = "key string, minute timestamp, n long"
REFUSED = f"request_id string, status int, reason string, issues array<{ISSUE}>"
_log = logging.getLogger(__name__)


def body_fault(surface: Column, body: Column, largest: int) -> Column:
    """What is wrong with a body before anyone asks who sends it; browsers' texts are read behind the gate."""
    shape = F.substring(F.trim(F.coalesce(body, F.lit(""))), 1, 1)
    readable = shape.isin("{", "[") & F.try_parse_json(body).isNotNull()
    return F.when(F.octet_length(body) > largest, "payload too large").when((surface != "browser") & ~F.coalesce(readable, F.lit(False)), "bad request")


class Gatekeeper:
    """Keys and counters of one job, from batch to batch."""

    def __init__(self, spark: SparkSession, path: str, static: DataFrame, validator: Validator | None, settings: Settings, cache_seconds: int = 60, forget_days: int = 1, count_hours: int = 1):
        self.static, self.validator, self.settings, self.seconds, self.days, self.hours = static, validator, settings, cache_seconds, forget_days, count_hours
        self.cache, self.counts = Versions(spark, f"{path}/_gate/keys", CACHE), Versions(spark, f"{path}/_gate/counts", COUNTS)

    def tenants(self, wanted: DataFrame, now: Column, epoch: int) -> DataFrame:
        """Tenants of the keys that are wanted; the cache of this epoch is written."""
        cached = self.cache.before(epoch)
        known = self.static.select("key").unionByName(cached.filter(F.col("expires_at") > now).select("key"))
        open_ = wanted.join(known.distinct(), "key", "left_anti")
        answers = open_.select("key", F.lit(False).alias("reachable"), *[F.lit(None).cast(t).alias(c) for c, t in self.static.dtypes if c != "key"])
        if self.validator is not None:
            try:
                answers = self.validator(open_).select("key", "reachable", *G.TENANT).persist()
                answers.count()
            except Exception as error:  # whatever keeps it from answering: known keys stay good, unknown ones are refused
                _log.warning("the key validator failed: %s", type(error).__name__)
                answers = open_.select("key", F.lit(False).alias("reachable"), *[F.lit(None).cast(t).alias(c) for c, t in self.static.dtypes if c != "key"])
        resolved, renewed = G.resolve_keys(wanted, self.static, cached, answers, now, self.seconds)
        self.cache.write(epoch, renewed.filter(F.col("expires_at") + F.make_dt_interval(F.lit(self.days)) > now))
        return resolved

    def decide(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The batch with key, tenant, status and reason."""
        key = G.extract_key(F.col("authorization"), F.col("key_header"), F.col("key_query"))
        fault = body_fault(F.col("surface"), F.col("body"), self.settings.body_bytes)
        rows = batch.withColumns({"key": key, "_fault": fault, "at": F.col("received_at"), "_surface": F.col("surface"), "surface": F.when(F.col("surface") == "browser", "browser").otherwise("otlp")}).persist()
        try:
            latest = rows.agg(F.max("received_at")).first()[0]
            now = F.lit(latest).cast("timestamp")
            sound = rows.filter(F.col("_fault").isNull())
            keys = self.tenants(sound.select("key").filter("key is not null").distinct(), now, epoch).persist()
            counted = self.counts.before(epoch)
            limits = {"server_limit": self.settings.server_limit, "client_limit": self.settings.client_limit}
            told = G.gate(sound, keys, counted=counted, **limits)
            refused = rows.filter(F.col("_fault").isNotNull()).withColumn("reason", F.col("_fault"))
            whole = told.unionByName(refused.withColumn("status", G.status_of(F.col("reason"))), allowMissingColumns=True)
            whole = whole.withColumn("surface", F.col("_surface")).drop("_fault", "_surface", "at").persist()
            passed = whole.filter(F.col("reason").isNull() | (F.col("reason") == "rate limit exceeded"))
            counts = counted.unionByName(G.counts_per_minute(passed, ["key"], "received_at")).groupBy("key", "minute").agg(F.sum("n").alias("n"))
            # minutes that no request comes for any more go
            self.counts.write(epoch, counts.filter(F.col("minute") + F.make_dt_interval(hours=F.lit(self.hours)) > now))
            keys.unpersist()
            return whole
        finally:
            rows.unpersist()


def ingest_requests(stream: DataFrame, path: str, checkpoint: str, *, static: DataFrame | None = None, validator: Validator | None = None, settings: Settings | None = None, cache_seconds: int = 60, count_hours: int = 1, once: bool = False, job: str = "requests", every: str | None = None, after: jobs.After | None = None):
    """Starts the job. `static`: keys as `gate.parse_keys` gives them. `validator` takes keys and gives key, reachable and the
    tenant (nulls: invalid); what it raises means that it can't be reached. A minute's counts are kept until `count_hours` before
    the latest request of a batch. With `once` an occurrence that an earlier batch has stored is not stored again, however long
    ago that was. `after` gets the occurrences and usage of a batch
    when they are stored, and its epoch."""
    spark = stream.sparkSession
    settings = settings or Settings()
    static = static if static is not None else spark.createDataFrame([], G.KEYS)
    keeper = Gatekeeper(spark, path, static.select("key", *G.TENANT), validator, settings, cache_seconds, count_hours=count_hours)

    def write(batch: DataFrame, epoch: int) -> None:
        name, vendor = f"{job}-{epoch}", settings.vendor
        decided = keeper.decide(batch, epoch)
        let = decided.filter(F.col("reason").isNull()).select("request_id", "surface", "org_id", "repository_id", "body")
        try:
            texts = browser.parse(let.filter("surface = 'browser'").withColumnRenamed("body", "value")).persist()
            faults = with_issues(texts.filter(~F.col("valid")))
            bad = faults.select("request_id", F.when(F.col("issues").isNull(), "invalid json").otherwise("invalid payload").alias("reason"), "issues")
            events = O.browser_events(texts.filter("valid").drop("surface")).persist()
            spans = R.span_rows(requests.parse_json(let.filter("surface = 'traces'").drop("surface"), "traces", "body").drop("body"), vendor).persist()
            metrics = requests.parse_json(let.filter("surface = 'metrics'").drop("surface"), "metrics", "body").drop("body")

            from_spans = O.identify(R.occurrences(spans, vendor))
            from_events = O.identify(O.browser_occurrences(events))
            found = store.conform(from_spans, "error_occurrences").unionByName(store.conform(from_events, "error_occurrences"))
            points = R.span_usage(spans, from_spans).unionByName(R.metric_usage(metrics)).unionByName(O.browser_usage(events))
            usage = O.merge_usage(points)
            refusals = decided.filter(F.col("reason").isNotNull()).select("request_id", "reason", F.lit(None).cast(f"array<{ISSUE}>").alias("issues")).unionByName(bad)
            new = store.not_stored(found, path, name) if once else found
            for table, rows in (("error_occurrences", new), ("spans", spans), ("metrics_1m", usage), ("llm_calls", C.extract_calls(spans, vendor))):
                store.append(rows, path, table, write_id=name)
            told = refusals.select(F.col("request_id").cast("string").alias("request_id"), G.status_of(F.col("reason")).cast("int").alias("status"), "reason", "issues")
            told.withColumn(store.WRITE, F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(store.WRITE).parquet(f"{path}/refusals")
            if after:
                after(found, usage, epoch)
        finally:
            for df in (decided, texts, events, spans):
                df.unpersist()

    return jobs.run(stream, write, checkpoint, every)


def refusals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{REFUSED}, {store.WRITE} string").parquet(f"{path}/refusals").drop(store.WRITE)
