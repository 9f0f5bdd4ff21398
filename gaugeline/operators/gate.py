"""Who may send: keys, scopes, origins and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.instants import utc_minute
from ..functions.text import trim_space
from .ranks import first_of_each, ranked


def parse_keys(df: DataFrame, value: str = "value") -> DataFrame:
    """Key rows out of JSON arrays: key, org_id, repository_id, scope, allowed_origins.

    Entries of which the first three are not all texts are left out (an empty text is one); a text that is no array has none.
    Of entries with one key the last in its array counts (of those in several arrays, the one in the text that sorts last).
    """
    v = F.try_parse_json(F.col(value))
    k = df.select(F.col(value).alias("_text"), F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("_at", "k"))
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("k", f"$.{name}", "variant")), F.lit(""))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get("k", f"$.{name}", "string"))
    named = (kind("key") == "STRING") & (kind("orgId") == "STRING") & (kind("repositoryId") == "STRING")
    origins = F.coalesce(F.try_variant_get("k", "$.allowedOrigins", "array<string>"), F.array().cast("array<string>"))
    tenant = F.struct(text("orgId").alias("org_id"), text("repositoryId").alias("repository_id"), F.coalesce(text("scope"), F.lit("server")).alias("scope"), origins.alias("allowed_origins"))
    rows = k.filter(named).select(text("key").alias("key"), tenant.alias("tenant"), F.struct("_text", "_at").alias("_last"))
    return rows.groupBy("key").agg(F.max_by("tenant", "_last").alias("tenant")).select("key", "tenant.*")


TENANT = ("org_id", "repository_id", "scope", "allowed_origins")
KEYS = "key string, org_id string, repository_id string, scope string, allowed_origins array<string>"


def _one_each(keys: DataFrame, *first: str) -> DataFrame:
    """One row for each key, however often a table names it: the greatest, by the columns named first."""
    rest = [c for c in keys.columns if c != "key" and c not in first]
    return keys.groupBy("key").agg(F.max(F.struct(*first, *rest)).alias("_one")).select("key", *[F.col(f"_one.{c}").alias(c) for c in keys.columns if c != "key"])


def resolve_keys(wanted: DataFrame, static: DataFrame, cached: DataFrame, answers: DataFrame, now: Column, seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Tenants of keys, and the cache after that.

    wanted: key. static: key and the tenant. cached: key, the tenant (nulls: known to be invalid), expires_at. answers of the
    validator: key, reachable, and the tenant (nulls: invalid). A static key needs no validator; a cached one only when it
    has expired, and where the validator can't be reached the expired entry still counts; an unknown key is then refused.
    An answer is kept for `seconds`. A key that a table names several times has one row, of the cache the one that lasts longest.
    """
    static, cached, answers = _one_each(static.select("key", *TENANT)), _one_each(cached.select("key", *TENANT, "expires_at"), "expires_at"), _one_each(answers, "reachable")
    named = lambda df, s, *more: df.select("key", F.struct(*TENANT).alias(f"_{s}"), *more)
    asked = answers.filter("reachable").select("key", *TENANT)
    df = wanted.distinct().join(named(static, "static"), "key", "left").join(named(cached, "old", "expires_at"), "key", "left").join(named(asked, "new"), "key", "left")
    fresh = F.coalesce(F.col("expires_at") > now, F.lit(False))
    use = F.when(F.col("_static").isNotNull(), F.col("_static")).when(fresh, F.col("_old")).when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    got = df.withColumn("_t", use)
    whole = (F.coalesce("_t.org_id", F.lit("")) != "") & (F.coalesce("_t.repository_id", F.lit("")) != "")
    resolved = got.filter(whole).select("key", "_t.org_id", "_t.repository_id", F.coalesce("_t.scope", F.lit("server")).alias("scope"), F.coalesce("_t.allowed_origins", F.array().cast("array<string>")).alias("allowed_origins"))
    renewed = got.filter(F.col("_static").isNull() & ~fresh & F.col("_new").isNotNull()).select("key", "_new.*", (now + F.make_interval(secs=F.lit(seconds))).alias("expires_at"))
    return resolved, renewed.unionByName(cached.join(renewed.select("key"), "key", "left_anti"))


def extract_key(authorization: Column, header: Column, query: Column) -> Column:
    """A bearer token, even an empty one, comes before the key header, and that before the query's key."""
    own = lambda c: F.nullif(trim_space(c), F.lit(""))
    return F.when(F.lower(authorization).startswith("bearer "), own(F.substring(authorization, 8, 1 << 30))).otherwise(F.coalesce(own(header), own(query)))


def limit_per_minute(df: DataFrame, key: list[str], at: str, limit: Column | int, *ties: str, counted: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """Adds `allowed`: whether a row is among the first `limit` of its key's minute.

    `counted` has what came before these rows: the key, minute, n. A key's minute is one group of a window, or with `spread`
    dealt over tasks, for keys that may hold a large part of all rows.
    """
    taken = {c for c in ("_minute", "_place", "_before") if c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    own = df.withColumn("_minute", utc_minute(F.col(at)))
    if spread:
        own = ranked(own, [*key, "_minute"], [at, *ties], "_place")
    else:
        own = own.withColumn("_place", F.row_number().over(W.partitionBy(*key, "_minute").orderBy(at, *ties)))
    before = F.lit(0)
    if counted is not None:
        sums = counted.groupBy(*key, F.col("minute").alias("_minute")).agg(F.sum("n").alias("_before"))
        own, before = own.join(sums, [*key, "_minute"], "left"), F.coalesce("_before", F.lit(0))
    return own.withColumn("allowed", F.col("_place") + before <= limit).select(*df.columns, "allowed")


def counts_per_minute(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """How many rows each key has in each minute: the key, minute, n."""
    return df.groupBy(*key, utc_minute(F.col(at)).alias("minute")).agg(F.count("*").alias("n"))


def client_address(forwarded: Column, peer: Column) -> Column:
    """The address that a request came from: the first that proxies name, else the connection's own."""
    named = trim_space(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    return F.coalesce(F.nullif(named, F.lit("")), peer, F.lit("unknown"))


def limit_per_address(requests: DataFrame, limit: int = 120) -> DataFrame:
    """A relay's limit: adds `allowed` to requests with forwarded, peer, at and request_id."""
    own = requests.withColumn("_address", client_address(F.col("forwarded"), F.col("peer")))
    return limit_per_minute(own, ["_address"], "at", limit, "request_id").drop("_address")


def session_cap(events: DataFrame, session: str, at: str, tie: str, most: int = 200, spread: bool = False) -> DataFrame:
    """The first events of each session; with `spread` a session may be of any size."""
    if spread:
        return first_of_each(events, [session], [at, tie], most)
    w = W.partitionBy(session).orderBy(at, tie)
    return events.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


# The texts and codes that senders are answered with.
REFUSALS = {
    "storage not configured": 503,
    "missing ingest key": 401,
    "invalid ingest key": 401,
    "client keys cannot send OTLP — use a server key": 403,
    "origin not allowed for this key": 403,
    "rate limit exceeded": 429,
    "payload too large": 413,
    "bad request": 400,
    "invalid json": 400,
    "invalid payload": 400,
}


def status_of(reason: Column) -> Column:
    """The code of a refusal, 202 for none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair]), F.coalesce(reason, F.lit(""))), F.lit(202))


def gate(requests: DataFrame, keys: DataFrame, *, configured: bool = True, server_limit: int = 300, client_limit: int = 120, counted: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """Adds the tenant, `status` (202 or the refusal's code) and `reason`, checked in this order: storage, key, scope, origin, rate.

    Needs request_id, key, surface (otlp or browser), origin and at. Refused requests don't count against a limit. `counted`
    has the requests of each key's minutes that passed the other checks before these (key, minute, n). A key that the table
    names several times has one tenant.
    """
    df = requests.join(_one_each(keys.select("key", *TENANT)), "key", "left")
    client, origin = F.col("scope") == "client", F.col("origin")
    refused = F.lit(None).cast("string") if configured else F.lit("storage not configured")
    steps = (
        (F.coalesce("key", F.lit("")) == "", "missing ingest key"),
        (F.col("org_id").isNull(), "invalid ingest key"),
        (client & (F.col("surface") != "browser"), "client keys cannot send OTLP — use a server key"),
        (client & (F.size("allowed_origins") > 0) & ~F.coalesce(F.array_contains("allowed_origins", origin), F.lit(False)), "origin not allowed for this key"),
    )
    for bad, reason in steps:
        refused = F.coalesce(refused, F.when(bad, reason))
    df = df.withColumn("reason", refused)
    # only what passed is ranked: refused requests of one key, or of none, are not brought together
    limit = F.when(client, client_limit).otherwise(server_limit)
    passed = limit_per_minute(df.filter(F.col("reason").isNull()), ["key"], "at", limit, "request_id", counted=counted, spread=spread)
    passed = passed.withColumn("reason", F.when(~F.col("allowed"), "rate limit exceeded")).drop("allowed")
    df = passed.unionByName(df.filter(F.col("reason").isNotNull()))
    return df.withColumn("status", status_of(F.col("reason")))


def delivery_outcome(status: Column, attempts: Column, most: Column | int = 12) -> Column:
    """What a sink's answer means: delivered, permanent, gave_up or retry."""
    permanent = (status < 500) & ~status.isin(408, 429)
    return F.when(status.between(200, 299), "delivered").when(permanent, "permanent").when(attempts >= most, "gave_up").otherwise("retry")
