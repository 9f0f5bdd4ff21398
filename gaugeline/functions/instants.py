"""Instants as texts, days and minutes of UTC, whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY, _MINUTE = 86_400_000_000, 60_000_000


def utc_date(at: Column) -> Column:
    """The day (a date, which has no time zone)."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at.cast("timestamp")) / _DAY).cast("int"))


def utc_partition(at: Column, form: str) -> Column:
    """The day or month in a pattern of years, months and days."""
    return F.date_format(utc_date(at), form)


def utc_minute(at: Column) -> Column:
    micros = F.unix_micros(at.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(_MINUTE)))


def utc_text(at: Column) -> Column:
    """As JSON has it: 2024-01-01T00:00:00.000Z."""
    millis = F.floor(F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(_DAY)) / 1000).cast("long")
    part = lambda size, most: F.pmod(F.floor(millis / size), F.lit(most)).cast("int")
    clock = F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))
    return F.concat(utc_date(at).cast("string"), F.lit("T"), clock, F.lit("Z"))
