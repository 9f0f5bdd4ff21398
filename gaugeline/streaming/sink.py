"""Envelopes for a webhook, made on the cluster, and how one is sent. Queueing and retries are in `delivery`."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import utc_text

VERSION = 1


def _instants(df: DataFrame) -> list:
    return [utc_text(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes if c not in ("org_id", "repository_id")]


def envelopes(occurrences: DataFrame, metrics: DataFrame, calls: DataFrame, delivery: str, rows: int = 500) -> DataFrame:
    """One JSON body for each tenant and part: batch_id, org_id, repository_id, body, bytes, signals_from, signals_to.

    The id is derived from the delivery's name, the tenant and the part, so a repeated delivery has the same one. A tenant has
    as many parts as its signals need for `rows` in each on average; a signal's part follows from the MD5 of its kind and JSON.
    Only the rows that go into bodies are moved, each once, by tenant and part; the tenants' sizes are counted before.
    """
    signals = []
    for name, df, at in (("occurrences", occurrences, "occurred_at"), ("metrics", metrics, "bucket_at"), ("llmCalls", calls, "started_at")):
        row = F.to_json(F.struct(*_instants(df)))
        signals.append(df.select("org_id", "repository_id", F.lit(name).alias("kind"), row.alias("row"), F.col(at).alias("at")))
    every = signals[0].unionByName(signals[1]).unionByName(signals[2])
    sizes = [df.groupBy("org_id", "repository_id").agg(F.count("*").alias("n")) for df in (occurrences, metrics, calls)]
    sizes = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).groupBy("org_id", "repository_id").agg(F.ceil(F.sum("n") / rows).cast("long").alias("parts"))
    hashed = F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "row").cast("binary")), 1, 12), 16, 10).cast("long")
    every = every.join(sizes, ["org_id", "repository_id"]).withColumn("part", (hashed % F.col("parts")).cast("int"))
    own = lambda kind: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("row")))), ",")
    got = every.groupBy("org_id", "repository_id", "part").agg(own("occurrences").alias("o"), own("metrics").alias("m"), own("llmCalls").alias("c"), F.min("at").alias("signals_from"), F.max("at").alias("signals_to"))
    got = got.withColumn("batch_id", F.substring(F.sha2(F.concat_ws("\u0000", F.lit(delivery), "org_id", "repository_id", "part"), 256), 1, 32))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), '^\\{"v":(.*)\\}$', 1)
    body = F.concat(F.lit(f'{{"version":{VERSION},"batchId":"'), "batch_id", F.lit('","orgId":'), quoted("org_id"), F.lit(',"repositoryId":'), quoted("repository_id"), F.lit(',"occurrences":['), "o", F.lit('],"metrics":['), "m", F.lit('],"llmCalls":['), "c", F.lit("]}"))
    return got.withColumn("body", body).select("batch_id", "org_id", "repository_id", "body", F.octet_length("body").alias("bytes"), "signals_from", "signals_to")


def failure_reason(error: BaseException) -> str:
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, urllib.error.HTTPError):
        return f"http_{error.code}"
    return "timeout" if isinstance(getattr(error, "reason", None), TimeoutError) else "connection_error" if isinstance(error, OSError) else "error"


def post(url: str, token: str | None, body: str, timeout: float = 10.0) -> int:
    headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers), timeout=timeout) as answer:
            answer.read()
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code
