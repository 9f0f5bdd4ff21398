"""Durable delivery: a queue of envelopes in tables, sent at least once, retried in later batches and never by a task that waits.

Under a path: `queue` has what was enqueued (a folder for each enqueuing), `claims` what a round has taken to send, and
`attempts` how each sending ended. A round claims what is due, sends it and settles it; its claim is written before anything
is sent, and its settlement after, each committed by Spark's own marker. A round that is killed between the two is taken up
again with the same claim when it runs next, so a batch may be sent twice but none is lost; the batch id lets the consumer tell.
What a batch's next step is follows from its attempts: it is settled when delivered, refused for good or out of attempts, or
else due again after a wait that doubles up to a cap, between half of it and the whole by a hash of batch and attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gate import delivery_outcome
from ..plans.staging import delete, exists, names
from .sink import failure_reason

QUEUED = "batch_id string, org_id string, body string, bytes long, signals_from timestamp, signals_to timestamp, enqueued_at timestamp"
CLAIMED = "batch_id string, attempt int"
SETTLED = "batch_id string, attempt int, status int, reason string, outcome string, at timestamp, next_at timestamp"
#: How many are sent at a time while the consumer answers, and while it does not.
CONCURRENCY, CAREFUL = 4, 1


class Queue:
    """`send(body, attempt)` gives an HTTP status or raises. It runs in tasks."""

    def __init__(self, spark: SparkSession, path: str, send: Callable[[str, int], int], *, attempts: int = 12, base: float = 1.0, cap: float = 60.0):
        self.spark, self.path, self.send, self.attempts, self.base, self.cap = spark, path, send, attempts, base, cap

    def enqueue(self, batches: DataFrame, now: Column, name: str) -> None:
        """Adds envelopes (batch_id, org_id, body, bytes, signals_from, signals_to) under a name; the same name replaces them."""
        rows = batches.withColumn("enqueued_at", now).select(*[c.split()[0] for c in QUEUED.split(", ")])
        rows.write.mode("overwrite").parquet(f"{self.path}/queue/name={name}")

    def _read(self, part: str, schema: str, *more: str) -> DataFrame:
        own = [p for p in names(self.spark, f"{self.path}/{part}/*") if exists(self.spark, f"{p}/_SUCCESS")]
        df = self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)
        return df.select("*", *more) if more else df

    def queued(self) -> DataFrame:
        """Each batch once, however often it was enqueued (the first time counts)."""
        rows = self._read("queue", QUEUED)
        return rows.groupBy("batch_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "batch_id"]), "enqueued_at").alias("q")).select("batch_id", "q.*")

    def settled(self) -> DataFrame:
        """Of each batch its last attempt."""
        rows = self._read("attempts", SETTLED)
        return rows.groupBy("batch_id").agg(F.max_by(F.struct("attempt", "status", "reason", "outcome", "at", "next_at"), "attempt").alias("a")).select("batch_id", "a.*")

    def state(self) -> DataFrame:
        """All batches: attempts so far and outcome, `queued` before the first."""
        rows = self.queued().drop("body").join(self.settled(), "batch_id", "left")
        return rows.select("batch_id", "org_id", "bytes", "signals_from", "signals_to", "enqueued_at", F.coalesce("attempt", F.lit(0)).alias("attempts"), F.coalesce("outcome", F.lit("queued")).alias("outcome"), "reason", "next_at")

    def _failing(self) -> bool:
        """Whether nothing of the last round that sent anything was delivered."""
        rounds = [p for p in names(self.spark, f"{self.path}/attempts/round=*") if exists(self.spark, f"{p}/_SUCCESS")]
        if not rounds:
            return False
        last = self.spark.read.schema(SETTLED).parquet(rounds[-1]).agg(F.count("*"), F.count(F.when(F.col("outcome") == "delivered", 1))).first()
        return last[0] > 0 and last[1] == 0

    def claim(self, now: Column, round_: int) -> DataFrame:
        """What a round sends: what is due and not settled. A round that has claimed before has the same claim."""
        at = f"{self.path}/claims/round={round_:012}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            last = self.settled().select("batch_id", "attempt", "outcome", "next_at")
            due = self.queued().join(last, "batch_id", "left").filter((F.col("outcome").isNull() & (F.col("enqueued_at") <= now)) | ((F.col("outcome") == "retry") & (F.col("next_at") <= now)))
            due.select("batch_id", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(CLAIMED).parquet(at)

    def deliver(self, now: Column, round_: int) -> None:
        """One round: every batch that is due is sent once. A round that has settled does nothing."""
        at = f"{self.path}/attempts/round={round_:012}"
        if exists(self.spark, f"{at}/_SUCCESS"):
            return
        claimed = self.claim(now, round_).join(self.queued().select("batch_id", "body", "enqueued_at"), "batch_id")
        n = CAREFUL if self._failing() else CONCURRENCY
        dealt = claimed.repartition(n, "batch_id").sortWithinPartitions("enqueued_at", "batch_id")
        sent = dealt.select("batch_id", "attempt", "body").mapInArrow(_sender(self.send), "batch_id string, attempt int, status int, reason string")
        outcome = F.when(F.col("status").isNull(), F.when(F.col("attempt") >= self.attempts, "gave_up").otherwise("retry")).otherwise(delivery_outcome(F.col("status"), F.col("attempt"), self.attempts))
        wait = F.least(F.lit(self.cap), F.lit(self.base) * F.pow(F.lit(2.0), F.col("attempt") - 1))
        part = F.pmod(F.xxhash64("batch_id", "attempt"), F.lit(1000)) / 1000.0
        later = F.timestamp_micros(F.unix_micros(now) + ((wait / 2 + part * wait / 2) * 1_000_000).cast("long"))
        rows = sent.withColumn("outcome", outcome).withColumns({"at": now, "next_at": F.when(F.col("outcome") == "retry", later)})
        rows.select(*[c.split()[0] for c in SETTLED.split(", ")]).write.mode("overwrite").parquet(at)

    def stats(self) -> DataFrame:
        """One row: what a sink reports. Every failed attempt counts as a failure, those since the last delivery as consecutive."""
        tries = self._read("attempts", SETTLED)
        count = lambda c: F.count(F.when(c, 1))
        bad = F.col("outcome") != "delivered"
        last = tries.agg(F.max(F.when(~bad, F.col("at"))).alias("_last"))
        told = tries.join(F.broadcast(last)).agg(  # one row
            count(~bad).alias("delivered"),
            count(F.col("outcome") == "retry").alias("retried"),
            count(F.col("outcome").isin("permanent", "gave_up")).alias("dropped_permanent"),
            count(bad & (F.col("_last").isNull() | (F.col("at") > F.col("_last")))).alias("consecutive_failures"),
            F.max(F.when(bad, F.col("at"))).alias("last_failure_at"),
            F.max_by(F.when(bad, F.col("reason")), F.when(bad, F.struct("at", "batch_id"))).alias("last_failure_reason"),
        )
        waits = self.state().filter(F.col("outcome").isin("queued", "retry"))
        return told.join(F.broadcast(waits.agg(F.count("*").alias("queued"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("queued_bytes"), F.min("enqueued_at").alias("oldest_queued_since"))))

    def compact(self, name: str) -> None:
        """Writes what still waits as one enqueuing and forgets the rest with its attempts' folders kept as the record.

        For a queue that has run long; no round may run meanwhile."""
        waits = self.state().filter(F.col("outcome").isin("queued", "retry")).select("batch_id")
        old = names(self.spark, f"{self.path}/queue/*")
        self.queued().join(waits, "batch_id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/queue/name={name}")
        for p in old:
            if not p.endswith(f"/name={name}"):
                delete(self.spark, p)


def _sender(send: Callable[[str, int], int]):
    """One attempt for each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            statuses, reasons = [], []
            for attempt, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    status = send(body, attempt)
                    statuses.append(status)
                    reasons.append(None if 200 <= status < 300 else f"http_{status}")
                except Exception as error:  # any failure to send is retried
                    statuses.append(None)
                    reasons.append(failure_reason(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(statuses, pa.int32()), pa.array(reasons, pa.string())], ["batch_id", "attempt", "status", "reason"])

    return run


def deliver_stream(envelopes: DataFrame, queue: Queue, checkpoint: str, clock: Callable[[int], Column], job: str = "delivery", every: str | None = None):
    """A job that enqueues each micro-batch of envelopes and sends what is due at the time that `clock` gives for its epoch."""
    from .jobs import run

    def write(batch: DataFrame, epoch: int) -> None:
        now = clock(epoch)
        queue.enqueue(batch, now, f"{job}-{epoch}")
        queue.deliver(now, epoch)

    return run(envelopes, write, checkpoint, every)
