"""Keyed state of streams: limits that hold across micro-batches, and traces that an error rescues.

State lies in RocksDB, with timers of processing time that forget it; no row is dropped for being late. A query over such a
stream is started with `start`, which sets what it needs for this one query and leaves the session as it was.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.instants import utc_minute
from ..operators.sampling import shows_error

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # timers of processing time would ask for batches without data for ever
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def start(writer, spark: SparkSession):
    """Starts a DataStreamWriter whose stream has keyed state."""
    old = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        return writer.start()  # the query works on a copy of the session as it is now
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class _Forgetful(StatefulProcessor):
    """State whose timer is put off whenever rows come."""

    keep_ms: int

    def put_off(self, old: int | None, timer_values) -> int:
        if old is not None:
            self.handle.deleteTimer(old)
        at = timer_values.getCurrentProcessingTimeInMs() + self.keep_ms
        self.handle.registerTimer(at)
        return at

    def close(self) -> None:
        pass


def _plain(df: DataFrame) -> DataFrame:
    """Instants as microseconds: numbers pass through Python and state as they are, whatever zone either works in."""
    return df.withColumns({f.name: F.unix_micros(f.name) for f in df.schema.fields if f.dataType == T.TimestampType()})


def _restored(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.timestamp_micros(f.name) for f in like.schema.fields if f.dataType == T.TimestampType()})


def _sortable(row: Row, names: tuple[str, ...]) -> tuple:
    """Values to compare rows by; nulls come first."""
    return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in names)


class _Counter(_Forgetful):
    """The number of requests of one key's minute."""

    def __init__(self, order: tuple[str, ...], limit: str, names: list[str], keep_ms: int):
        self.order, self.limit, self.row, self.names, self.keep_ms = order, limit, Row(*names, "allowed"), names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, timer = self.seen.get() if self.seen.exists() else (0, None)
        room, first, came = None, [], 0
        for row in rows:
            room = max(0, row[self.limit] - n) if room is None else room
            came += 1
            # of this batch no more rows are held than are let through
            insort(first, (_sortable(row, self.order), came, row))
            if len(first) > room:
                last = first.pop()[2]
                yield self.row(*[last[c] for c in self.names], False)
        for _, _, row in first:
            yield self.row(*[row[c] for c in self.names], True)
        self.seen.update((n + came, self.put_off(timer, timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter([])


def limit_stream(stream: DataFrame, key: list[str], at: str, limit: Column | int, *ties: str, keep: str = "10 minutes") -> DataFrame:
    """Adds `allowed` to a stream: whether a row is among the first `limit` of its key's minute in all batches.

    Rows of one batch come in the order of `at` and `ties`, batches in theirs. A key's minute is one state, a number; it is
    forgotten `keep` of processing time after its last row. `limit` must be the same for all rows of a key.
    """
    minute, most = "_limit_minute", "_limit_most"
    rows = _plain(stream.withColumns({minute: utc_minute(F.col(at)), most: limit if isinstance(limit, Column) else F.lit(limit)}))
    schema = T.StructType([*rows.select(*stream.columns).schema.fields, T.StructField("allowed", T.BooleanType())])
    counter = _Counter((at, *ties), most, stream.columns, _milliseconds(keep))
    return _restored(rows.groupBy(*key, minute).transformWithState(counter, schema, "Append", "ProcessingTime"), stream)


class _Tail(_Forgetful):
    """The unsampled spans of one trace that wait for an error, or the mark that one has come."""

    def __init__(self, schema: T.StructType, error: str, told: str | None, lifetime: int, most: int, keep_ms: int):
        self.schema, self.error, self.told, self.lifetime, self.most, self.keep_ms = schema, error, told, lifetime, most, keep_ms
        self.names = schema.names
        self.row = Row(*self.names, "tail_retained")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "first long, kept boolean, n int, timer long")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, kept, n, timer = self.entry.get() if self.entry.exists() else (None, False, 0, None)
        stored, new = n, []  # what the list state holds, and what waits beside it
        for r in sorted(rows, key=lambda r: (r["ended_at"], str(r["span_id"]))):
            if first is None or r["ended_at"] > first + self.lifetime:
                first, kept, n, stored, new = r["ended_at"], False, 0, self._drop(stored), []
            if kept:
                yield self._out(r)
            elif r[self.error] or (self.told and r[self.told]):
                if stored:
                    yield from (self._out(x) for x in self.waiting.get())
                yield from map(self._out, [*new, r])
                kept, n, stored, new = True, 0, self._drop(stored), []
            elif not r["parent_span_id"]:
                n, stored, new = 0, self._drop(stored), []
            elif n < self.most:
                n += 1
                new.append(r)
        if new:
            self.waiting.appendList([tuple(r[c] for c in self.names) for r in new])
        self.entry.update((first, kept, n, self.put_off(timer, timerValues)))

    def _drop(self, stored: int) -> int:
        if stored:
            self.waiting.clear()
        return 0

    def _out(self, r) -> Row:
        return self.row(*[r[c] if isinstance(r, Row) else r[i] for i, c in enumerate(self.names)], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.entry.clear()
        self.waiting.clear()
        return iter([])


def retain_tails(stream: DataFrame, seconds: int = 30, most: int = 256, captured: str | None = None, keep: str = "10 minutes") -> DataFrame:
    """The unsampled spans that an error rescues, whole, with tail_retained set, from a stream of spans.

    Needs trace_id, span_id, parent_span_id, ended_at and is_error; a span that has an exception event (`exceptions`, where
    there is that column) shows an error too. `captured` names a boolean column that says that the application reported an
    error while the span was active; it rescues the trace as a failed span does. Spans of a batch come in order of their ends,
    batches in theirs. From the first error on all spans of a trace go out, with up to `most` before it; a root that ends
    without one drops those that wait. A trace is forgotten `seconds` after its first span, in the time of the spans, and its
    state `keep` of processing time after its last. Spans without a trace id, or whose end is not known, are never rescued.
    """
    names = [c for c in stream.columns if c != "tail_retained"]
    own = stream.filter((F.coalesce("trace_id", F.lit("")) != "") & F.col("ended_at").isNotNull()).select(*names)
    rows = _plain(own)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    out = T.StructType([*schema.fields, T.StructField("tail_retained", T.BooleanType())])
    tail = _Tail(schema, "_tail_error", captured, seconds * 1_000_000, most, _milliseconds(keep))
    return _restored(rows.withColumn("_tail_error", shows_error(rows)).groupBy("trace_id").transformWithState(tail, out, "Append", "ProcessingTime"), own)


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
