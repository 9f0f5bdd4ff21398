"""Views of the driver's tables as telemetry, and the same in SQL. All mappings are exact in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def browser_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, n = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "error", F.when(n % 5 == 0, "unhandled_rejection").otherwise("exception")).when(F.col("event_type") == "view", "message").when(F.col("event_type") == "signup", "session_start").otherwise("track_event")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return e.select(
        "event_id", text("org", (u % 3).cast("string")).alias("org_id"), text("repo", (u % 7).cast("string")).alias("repository_id"), F.lit("web").alias("service"), F.lit("production").alias("environment"),
        text("r", F.floor(F.dayofmonth("ts") / 8).cast("string")).alias("release"), text("s", u.cast("string")).alias("session_id"), kind.alias("type"), F.date_trunc("millisecond", "ts").alias("occurred_at"),
        F.when(n % 11 == 0, "info").when(n % 13 == 0, "fatal").alias("severity"), F.when(n % 17 == 0, "").otherwise(text("user ", u.cast("string"), " failed after ", F.floor("value").cast("string"), "ms in \"step ", k, "\"")).alias("message"),
        F.col("event_type").alias("name"), text("Error: x\n    at run (https://app.test/static/main.js?v=", k, ":10:", k, ")\n    at page", (n % 7).cast("string"), " (/src/page.tsx:", k, ":2)").alias("stack"),
        F.when(n % 3 == 0, "TypeError").alias("error_type"), text("/users/", u.cast("string"), "/items/", k, "?ref=x").alias("route"),
    )


EVENTS_SQL = """e AS (SELECT event_id, concat('org', user_id % 3) AS org_id, concat('repo', user_id % 7) AS repository_id, 'web' AS service, 'production' AS environment,
 concat('r', day(ts) // 8) AS release, concat('s', user_id) AS session_id,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'unhandled_rejection' ELSE 'exception' END WHEN event_type = 'view' THEN 'message' WHEN event_type = 'signup' THEN 'session_start' ELSE 'track_event' END AS type,
 date_trunc('millisecond', ts) AS occurred_at, CASE WHEN event_id % 11 = 0 THEN 'info' WHEN event_id % 13 = 0 THEN 'fatal' END AS severity,
 CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('user ', user_id, ' failed after ', CAST(floor(value) AS BIGINT), 'ms in "step ', json_extract_string(props, '$.k'), '"') END AS message, event_type AS name,
 concat('Error: x', chr(10), '    at run (https://app.test/static/main.js?v=', json_extract_string(props, '$.k'), ':10:', json_extract_string(props, '$.k'), ')', chr(10), '    at page', event_id % 7, ' (/src/page.tsx:', json_extract_string(props, '$.k'), ':2)') AS stack,
 CASE WHEN event_id % 3 = 0 THEN 'TypeError' END AS error_type, concat('/users/', user_id, '/items/', json_extract_string(props, '$.k'), '?ref=x') AS route FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return d.select(
        F.concat(F.lit("org"), (F.col("o_custkey") % 3).cast("string")).alias("org_id"), F.lit("repo0").alias("repository_id"), F.lit("shop").alias("service"), F.lit("production").alias("environment"), F.lit("").alias("release"),
        F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("trace_id"), F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 256).alias("span_id"), F.when(F.col("l_linenumber") == 1, "").otherwise("root").alias("parent_span_id"),
        F.when(F.col("l_linenumber") % 5 == 1, "server").otherwise("internal").alias("kind"), bad.alias("is_error"), F.when(bad, "error").otherwise("ok").alias("status"), F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string"), F.lit("/lines/"), (F.col("l_partkey") % 3).cast("string"), F.lit("x")).alias("route"),
        F.when(F.col("l_suppkey") % 10 == 0, 500).otherwise(200).alias("status_code"), F.col("l_quantity").alias("duration_ms"), F.col("l_shipdate").alias("started_at"), F.col("l_shipdate").alias("ended_at"), (F.col("l_linenumber") % 5 == 2).alias("metrics_wired"), F.lit(False).alias("tail_retained"),
    )


SPANS_SQL = """s AS (SELECT concat('org', o_custkey % 3) AS org_id, 'repo0' AS repository_id, 'shop' AS service, 'production' AS environment, '' AS release, md5(CAST(l_orderkey AS VARCHAR)) AS trace_id,
 sha256(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS span_id, CASE WHEN l_linenumber = 1 THEN '' ELSE 'root' END AS parent_span_id, CASE WHEN l_linenumber % 5 = 1 THEN 'server' ELSE 'internal' END AS kind,
 l_returnflag = 'R' AND l_linestatus = 'F' AS is_error, concat('/orders/', l_orderkey, '/lines/', l_partkey % 3, 'x') AS route, CASE WHEN l_suppkey % 10 = 0 THEN 500 ELSE 200 END AS status_code, l_quantity AS duration_ms, l_shipdate AS started_at, l_shipdate AS ended_at,
 l_linenumber % 5 = 2 AS metrics_wired FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: Models by conversation: known, routed, unknown and absent ones.
MODELS = ("gpt-5-mini", "openai/gpt-4o", "us.anthropic.claude-sonnet-4-1", "models/gemini-2.5-pro", "own-model", "", "azure/gpt-4.1-nano")


def call_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span with a bag of attributes for each assistant turn; a tenth says what it cost, some that it failed."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("_in", F.lag(F.char_length("text")).over(W.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant'")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % len(MODELS) + 1).cast("int"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    cost = F.when(F.col("turn") % 10 == 1, F.lit("0.25"))
    bag = F.filter(F.array(pair("gen_ai.request.model", model), pair("gen_ai.provider.name", F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"))), pair("gen_ai.usage.input_tokens", F.col("_in")), pair("gen_ai.usage.output_tokens", F.char_length("text")), pair("gen_ai.usage.cost", cost), pair("user.id", F.concat(F.lit("u"), (F.col("conv_id") % 20).cast("string")))), lambda x: x["value"].isNotNull())
    bad = F.col("conv_id") % 9 == 0
    return c.select("conv_id", "turn", F.lit("org0").alias("org_id"), F.lit("repo0").alias("repository_id"), F.lit("chat").alias("service"), F.lit("production").alias("environment"), F.lit("").alias("release"), F.md5(F.col("conv_id").cast("string").cast("binary")).alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"), F.when(F.col("turn") % 7 == 6, "ai.generateText").otherwise("chat").alias("name"), bag.alias("bag"), bad.alias("is_error"), F.lit(None).cast("string").alias("exception_type"), F.col("turn").cast("double").alias("duration_ms"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).alias("started_at"))


def calls_sql() -> str:
    from .functions.prices import sql_cost

    model = "(" + f"{list(MODELS)}" + ")[conv_id % " + f"{len(MODELS)} + 1]"
    return f"""t AS (SELECT conv_id, turn, role, text, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
m AS (SELECT conv_id, turn, {model} AS model, concat('p', conv_id % 3) AS provider, coalesce(i, 0) AS input_tokens, length(text) AS output_tokens, concat('u', conv_id % 20) AS user_id, turn % 10 = 1 AS reported, conv_id % 9 = 0 AS bad FROM t WHERE role = 'assistant' AND turn % 7 <> 6),
x AS (SELECT *, {sql_cost("model", "input_tokens", "output_tokens")} AS estimate FROM m),
c AS (SELECT concat_ws('-', conv_id, turn) AS span_id, provider, model, input_tokens, output_tokens, CASE WHEN reported THEN 0.25 ELSE coalesce(estimate, 0) END AS cost_usd, CASE WHEN reported THEN 'reported' WHEN estimate IS NULL THEN 'none' ELSE 'estimated' END AS cost_source,
 CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 'Error' ELSE '' END AS error_type, user_id, CAST(to_timestamp(1704067200 + conv_id * 3600 + turn) AT TIME ZONE 'UTC' AS TIMESTAMP) AS started_at FROM x)"""
