"""Browser payloads: JSON texts, checked whole, then typed.

Checking is done on the untyped document, as an optional field may be absent but not null, and numbers are not strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BROWSER, EVENT_TYPES, SEVERITIES

# The longest strings of a payload and of an event.
_PAYLOAD_STRINGS = {"sessionId": (0, 100, False), "service": (1, 200, True), "environment": (1, 100, True), "release": (0, 200, False)}
_EVENT_STRINGS = {"id": 64, "message": 4000, "name": 200, "stack": 32000, "errorType": 200, "filename": 1000, "route": 1000}
MOST_EVENTS = 50
# An object's fields as variants, taken out of it at once; null of what is no object.
_EVENT = "struct<" + ",".join(f"`{k}`:variant" for k in ("type", "timestamp", "severity", *_EVENT_STRINGS, "line", "column", "context")) + ">"
_PAYLOAD = "struct<version:variant," + ",".join(f"{k}:variant" for k in _PAYLOAD_STRINGS) + f",events:array<{_EVENT}>>"
_DATETIME = "^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\\.[0-9]+)?Z$"


def _once(c: Column, f) -> Column:
    """f of a column that is worked out once, however often f names it: the parameter of a lambda over one element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _kind(v: Column) -> Column:
    """The type of a variant: STRING, BIGINT, ..., OBJECT<...>; null if absent."""
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v).startswith(kind), F.lit(False))


def _string_ok(v: Column, least: int, most: int, needed: bool) -> Column:
    text = F.try_variant_get(v, "$", "string")
    ok = _is(v, "STRING") & F.char_length(text).between(least, most)
    return F.coalesce(ok, F.lit(False)) if needed else v.isNull() | F.coalesce(ok, F.lit(False))


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _one_of(v: Column, values: tuple[str, ...]) -> Column:
    return _is(v, "STRING") & F.coalesce(F.try_variant_get(v, "$", "string").isin(*values), F.lit(False))


def _count_ok(v: Column) -> Column:
    n = F.try_variant_get(v, "$", "double")
    return v.isNull() | ((_is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE")) & F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False)))


def event_valid(e: Column) -> Column:
    """Whether an event (its fields as variants) keeps the rules."""
    ok = e.isNotNull() & _one_of(e["type"], EVENT_TYPES)
    at = e["timestamp"]
    ok = ok & _is(at, "STRING") & F.coalesce(F.try_variant_get(at, "$", "string").rlike(_DATETIME), F.lit(False)) & F.try_to_timestamp(F.try_variant_get(at, "$", "string")).isNotNull()
    ok = ok & (e["severity"].isNull() | _one_of(e["severity"], SEVERITIES))
    for key, most in _EVENT_STRINGS.items():
        ok = ok & _string_ok(e[key], 0, most, False)
    for key in ("line", "column"):
        ok = ok & _count_ok(e[key])
    context = e["context"]
    return ok & (context.isNull() | _is(context, "OBJECT"))


def valid(payload: Column) -> Column:
    """Whether a parsed payload (variant; null if it is no JSON) keeps all rules. One bad event makes it invalid."""

    def rules(p: Column) -> Column:
        version, events = p["version"], p["events"]
        ok = p.isNotNull() & (_is(version, "BIGINT") | _is(version, "DECIMAL") | _is(version, "DOUBLE")) & F.coalesce(F.try_variant_get(version, "$", "double") == 1, F.lit(False))
        for key, (least, most, needed) in _PAYLOAD_STRINGS.items():
            ok = ok & _string_ok(p[key], least, most, needed)
        return F.coalesce(ok & events.isNotNull() & (F.size(events) <= MOST_EVENTS) & F.forall(events, event_valid), F.lit(False))

    return _once(F.try_variant_get(payload, "$", _PAYLOAD), rules)


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds `valid` and `payload` (typed; null if invalid). Unknown keys are left out."""
    out = df.withColumn("valid", _once(F.try_parse_json(F.col(value)), valid))
    return out.withColumn("payload", F.when(F.col("valid"), F.from_json(F.col(value), BROWSER)))


def sanitize(df: DataFrame, value: str = "value", largest: int = 64 << 10) -> DataFrame:
    """What a relay passes on: adds `clean`, JSON with listed fields only, cut to length, wrongly typed optional ones left
    out; null if the payload's structure is wrong or its text too large."""
    text = lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))
    number = lambda v: F.when(_is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE"), F.try_variant_get(v, "$", "double"))
    cut = lambda v, n: F.substring(text(v), 1, n)
    path = lambda v: F.substring(F.substring_index(text(v), "?", 1), 1, 1000)
    whole = lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    # of {"v":"..."} what is between the colon and the brace
    quoted = lambda c: F.rtrim(F.substring(F.to_json(F.struct(c.alias("v"))), 6, 2**31 - 1), F.lit("}"))
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), c))
    obj = lambda *fields: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))

    def event(e: Column) -> Column:
        severity, context = e["severity"], e["context"]
        return obj(
            field("type", quoted(text(e["type"]))), field("timestamp", quoted(text(e["timestamp"]))), F.when(_one_of(severity, SEVERITIES), field("severity", quoted(text(severity)))),
            field("message", quoted(F.coalesce(cut(e["message"], 4000), F.lit("")))), *[_optional(field, quoted, cut(e[k], n), k) for k, n in (("name", 200), ("stack", 32000), ("errorType", 200))],
            _optional(field, quoted, path(e["filename"]), "filename"), *[field(k, whole(number(e[k]))) for k in ("line", "column")], _optional(field, quoted, path(e["route"]), "route"),
            F.when(_is(context, "OBJECT") | _is(context, "ARRAY"), field("context", F.to_json(context))),
        )

    good = lambda e: e.isNotNull() & _one_of(e["type"], EVENT_TYPES) & _is(e["timestamp"], "STRING")

    def whole_payload(p: Column) -> Column:
        events = p["events"]
        filled = lambda k: F.coalesce(text(p[k]) != "", F.lit(False))
        ok = F.coalesce(number(p["version"]) == 1, F.lit(False)) & filled("service") & filled("environment")
        ok = ok & events.isNotNull() & (F.size(events) <= MOST_EVENTS) & F.forall(events, good)
        clean = obj(
            F.lit('"version":1'),
            _optional(field, quoted, cut(p["sessionId"], 100), "sessionId"),
            field("service", quoted(cut(p["service"], 200))),
            field("environment", quoted(cut(p["environment"], 100))),
            _optional(field, quoted, cut(p["release"], 200), "release"),
            F.concat(F.lit('"events":['), F.array_join(F.transform(events, event), ","), F.lit("]")),
        )
        return F.when(ok, clean)

    parsed = F.when(F.octet_length(F.col(value)) <= largest, F.try_parse_json(F.col(value)))
    return df.withColumn("clean", _once(F.try_variant_get(parsed, "$", _PAYLOAD), whole_payload))


def _optional(field, quoted, c: Column, name: str) -> Column:
    return F.when(c.isNotNull(), field(name, quoted(c)))
