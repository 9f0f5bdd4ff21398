"""Why a browser payload is refused: the first faults in the order of its schema, each with its path and a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_TYPES, SEVERITIES
from .browser import _DATETIME, _EVENT_STRINGS, _PAYLOAD_STRINGS, MOST_EVENTS, _at, _is, _once

MOST = 5
ISSUE = "struct<path:string,code:string>"
# The codes that senders are answered with.
WRONG_TYPE, WRONG_LITERAL, WRONG_VALUE, WRONG_STRING, TOO_SMALL, TOO_BIG = "invalid_type", "invalid_literal", "invalid_enum_value", "invalid_string", "too_small", "too_big"


def _issue(path: Column, code: str) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"))


def _first(path: Column, *faults: tuple[Column, str]) -> Column:
    """The first fault that a value has, null if none."""
    out = F.lit(None).cast(ISSUE)
    for bad, code in reversed(faults):
        out = F.when(F.coalesce(bad, F.lit(False)), _issue(path, code)).otherwise(out)
    return out


def _number(v: Column) -> Column:
    return _is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE")


def _text(v: Column, path: Column, least: int, most: int, needed: bool) -> Column:
    n = F.char_length(F.try_variant_get(v, "$", "string"))
    wrong = ~_is(v, "STRING") & (F.lit(True) if needed else v.isNotNull())
    return _first(path, (wrong, WRONG_TYPE), (n < least, TOO_SMALL), (n > most, TOO_BIG))


def _one_of(v: Column, path: Column, values: tuple[str, ...], needed: bool) -> Column:
    wrong = ~_is(v, "STRING") & (F.lit(True) if needed else v.isNotNull())
    return _first(path, (wrong, WRONG_TYPE), (~F.try_variant_get(v, "$", "string").isin(*values), WRONG_VALUE))


def _event(e: Column, path: Column) -> Column:
    """The faults of one event."""
    at = lambda key: F.concat(path, F.lit(f".{key}"))
    text = lambda key: _text(_at(e, key), at(key), 0, _EVENT_STRINGS[key], False)
    moment = F.try_variant_get(_at(e, "timestamp"), "$", "string")
    context = _at(e, "context")

    def count(key: str) -> list[Column]:
        n = F.try_variant_get(_at(e, key), "$", "double")
        number = _number(_at(e, key))
        return [_first(at(key), (_at(e, key).isNotNull() & ~number, WRONG_TYPE), (number & (n != F.floor(n)), WRONG_TYPE)), _first(at(key), (number & (n < 0), TOO_SMALL))]

    own = [
        text("id"),
        _one_of(_at(e, "type"), at("type"), EVENT_TYPES, True),
        _first(at("timestamp"), (~_is(_at(e, "timestamp"), "STRING"), WRONG_TYPE), (~moment.rlike(_DATETIME) | F.try_to_timestamp(moment).isNull(), WRONG_STRING)),
        _one_of(_at(e, "severity"), at("severity"), SEVERITIES, False),
        *map(text, ("message", "name", "stack", "errorType", "filename")),
        *count("line"),
        *count("column"),
        text("route"),
        _first(at("context"), (context.isNotNull() & ~_is(context, "OBJECT"), WRONG_TYPE)),
    ]
    return F.when(_is(e, "OBJECT"), F.array_compact(F.array(*own))).otherwise(F.array(_issue(path, WRONG_TYPE)))


def issues_of(payload: Column) -> Column:
    """The first MOST faults of a parsed payload (variant), empty if there are none."""
    version, events = _at(payload, "version"), _at(payload, "events")
    one = _number(version) & (F.try_variant_get(version, "$", "double") == 1)
    head = [_first(F.lit("version"), (~one, WRONG_LITERAL))]
    head += [_text(_at(payload, key), F.lit(key), least, most, needed) for key, (least, most, needed) in _PAYLOAD_STRINGS.items()]
    each = F.try_variant_get(payload, "$.events", "array<variant>")
    head.append(_first(F.lit("events"), (~_is(events, "ARRAY"), WRONG_TYPE), (F.size(each) > MOST_EVENTS, TOO_BIG)))
    inner = F.flatten(F.transform(F.coalesce(each, F.array().cast("array<variant>")), lambda e, i: _event(e, F.concat(F.lit("events."), i.cast("string")))))
    whole = F.slice(F.concat(F.array_compact(F.array(*head)), inner), 1, MOST)
    return F.when(_is(payload, "OBJECT"), whole).otherwise(F.array(_issue(F.lit(""), WRONG_TYPE)))


def with_issues(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds `issues`: null for a text that is no JSON, else the faults of the payload."""
    return df.withColumn("issues", _once(F.try_parse_json(F.col(value)), lambda p: F.when(p.isNotNull(), issues_of(p))))
