"""Templates of messages, routes and stacks, and the identities made of them.

All are built-in expressions. White space and word boundaries follow ECMAScript: explicit classes, ASCII words.
Lengths are counted in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript's white space and line ends, and the templates' patterns in the order in which they apply.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_ANY = "[^\\n\\r\\u2028\\u2029]"
_NOT_AFTER_WORD, _NOT_BEFORE_WORD = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
MESSAGE_STEPS = (
    (f"([\"'`])(?:\\\\{_ANY}|(?!\\1){_ANY})*\\1", "<str>"),
    (UUID, "<uuid>"),
    (f"{_NOT_AFTER_WORD}[0-9a-fA-F]{{8,}}{_NOT_BEFORE_WORD}", "<hex>"),
    (f"_[0-9a-fA-F]{{8,}}{_NOT_BEFORE_WORD}", "_<hex>"),
    (f"_[0-9]+(?:\\.[0-9]+)?{_NOT_BEFORE_WORD}", "_<n>"),
    (f"{_NOT_AFTER_WORD}[0-9]+(?:\\.[0-9]+)?", "<n>"),
    (f"{SPACE}+", " "),
)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_message(message: Column) -> Column:
    """Values in a message become placeholders, so that one defect has one text."""
    out = F.substring(message, 1, 500)
    for pattern, put in MESSAGE_STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def strip_query(c: Column) -> Column:
    """What stands before the first question mark; null if that is nothing."""
    return F.nullif(F.substring_index(c, "?", 1), F.lit(""))


def normalize_route(route: Column) -> Column:
    """Segments that look like identifiers become :id."""
    segments = F.split(F.substring_index(F.coalesce(route, F.lit("")), "?", 1), "/")
    identifier = f"^(?:{UUID}|[0-9]+|[0-9a-fA-F]{{8,}})$"
    return F.array_join(F.transform(segments, lambda s: F.when(s.rlike(identifier), ":id").otherwise(s)), "/")


def stack_frames(stack: Column, top: int = 5) -> Column:
    """The first frames of a stack without query strings and positions."""
    lines = F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), trim_space)
    frames = F.slice(F.filter(lines, lambda s: s.rlike(f"^at{SPACE}|@|^File{SPACE}|\\.[jt]sx?")), 1, top)

    def clean(s: Column) -> Column:
        s = F.regexp_replace(s, f"\\?(?:(?!{SPACE})[^:)])*", "")
        return trim_space(F.regexp_replace(F.regexp_replace(s, ":[0-9]+(?::[0-9]+)?\\)?$", ""), f"{SPACE}+", " "))

    return F.transform(frames, clean)


def fingerprint(source: Column, service: Column, error_type: Column, message: Column, stack: Column, route: Column) -> Column:
    """Identity of a defect: of equal source, service, type, message template, frames and route template."""
    return fingerprint_of(source, service, error_type, normalize_message(message), stack_frames(stack), normalize_route(route))


def fingerprint_of(source: Column, service: Column, error_type: Column, template: Column, frames: Column, route: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  array_join would leave nulls out
    parts = F.concat(F.array(text(source), text(service), text(error_type), template), frames, F.array(route))
    return F.substring(F.sha2(F.array_join(parts, " "), 256), 1, 32)


def occurrence_id(org: Column, repository: Column, defect: Column, at: Column, trace: Column, session: Column, message: Column, index: Column) -> Column:
    """Identity of one occurrence that a retried delivery has again."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))  # noqa: E731  concat_ws would leave nulls out
    parts = (F.lit("v1"), text(org), text(repository), text(defect), text(F.unix_millis(at)), text(trace), text(session), F.substring(text(message), 1, 1000), text(index))
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)


# The same for DuckDB, whose patterns have ASCII boundaries and no back references.
_DQ, _DA = "\\x{2028}\\x{2029}", "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
_SQL_STEPS = (
    ("|".join(f"{q}(?:\\\\[^\\n\\r{_DQ}]|[^{q}\\n\\r{_DQ}])*{q}" for q in ('"', "''", "`")), "<str>"),
    (UUID, "<uuid>"),
    ("\\b[0-9a-fA-F]{8,}\\b", "<hex>"),
    ("_[0-9a-fA-F]{8,}\\b", "_<hex>"),
    ("_[0-9]+(?:\\.[0-9]+)?\\b", "_<n>"),
    ("\\b[0-9]+(?:\\.[0-9]+)?", "<n>"),
    (f"[{_DA}]+", " "),
)


def sql_message(c: str) -> str:
    out = f"substring({c}, 1, 500)"
    for pattern, put in _SQL_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"trim({out})"


def sql_route(c: str) -> str:
    return f"array_to_string([CASE WHEN regexp_matches(s, '^(?:{UUID}|[0-9]+|[0-9a-fA-F]{{8,}})$') THEN ':id' ELSE s END for s in string_split(string_split(coalesce({c}, ''), '?')[1], '/')], '/')"


def sql_frames(c: str, top: int = 5) -> str:
    trimmed = lambda x: f"regexp_replace({x}, '^[{_DA}]+|[{_DA}]+$', '', 'g')"
    lines = f"[{trimmed('s')} for s in string_split(coalesce({c}, ''), chr(10))]"
    frames = f"[f for f in {lines} if regexp_matches(f, '^at[{_DA}]|@|^File[{_DA}]|\\.[jt]sx?')][1:{top}]"
    cleaned = f"regexp_replace(regexp_replace(regexp_replace(g, '\\?[^:){_DA}]*', '', 'g'), ':[0-9]+(?::[0-9]+)?\\)?$', ''), '[{_DA}]+', ' ', 'g')"
    return f"[{trimmed(cleaned)} for g in {frames}]"
