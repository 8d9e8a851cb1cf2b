"""The life of jobs as a stream: requests are judged by the job's state and time, and timers end what has expired.

State is kept by ``transformWithState`` for each job and goes with the job: when it is deleted, or when the watermark has
passed the time it expires. Expiry is a matter of event time, so a request that comes at or after that time finds the job
gone, whether its timer has fired yet or not; results do not depend on how the log is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

REQUESTS = ("create", "claim", "advance", "setup", "report", "delete")
#: What became of a request, or what a timer did.
ACCEPTED, REFUSED, UNKNOWN, TIMER = "accepted", "refused", "unknown", "timer"


@dataclass(frozen=True)
class Rules:
    """States with a meaning of their own, and the progress that is set on entering them."""

    created: str = "uploaded"
    claimable: tuple[str, ...] = ("uploaded", "queued")
    claimed: tuple[str, int] = ("normalizing", 8)
    waiting: str = "needs_player_selection"
    resumed: tuple[str, int] = ("queued", 32)
    deleting: str = "deleting"
    purged: str = "purge"
    ended: tuple[str, int] = ("expired", 100)


def judge(rules: Rules, state: str, request: str, target: str | None, progress: int, asked: int) -> tuple[str, int] | None:
    """The state and progress of a live job after a request, or None if it is refused."""
    if request == "claim" and state in rules.claimable:
        return rules.claimed
    if request == "setup" and state == rules.waiting:
        return rules.resumed[0], max(progress, rules.resumed[1])
    if request == "advance" and target is not None and target not in (rules.deleting, rules.ended[0]):
        return target, max(0, min(100, asked))
    if request == "report":
        return state, progress
    return None


class _Jobs(StatefulProcessor):
    def __init__(self, rules: Rules, ttl_ms: int):
        self.rules, self.ttl = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, progress int, expires long, reports int")

    def _end(self, key: Any, at: int, progress: int, seq: int | None, by: str) -> Iterator[Row]:
        """Deleting, purge and expired, in this order; the job's state is dropped."""
        for step, (state, p) in enumerate([(self.rules.deleting, progress), (self.rules.purged, progress), self.rules.ended]):
            yield Row(key=key, at_ms=at, seq=seq, step=step, request=None if seq is None else "delete", outcome=by, state=state, progress=p)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        name = key[0]
        job = tuple(self.job.get()) if self.job.exists() else None
        before = job
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            if job and r.at_ms >= job[2]:
                yield from self._end(name, job[2], job[1], None, TIMER)
                job = None
            if job and r.request == "delete":
                yield from self._end(name, r.at_ms, job[1], r.seq, ACCEPTED)
                job = None
                continue
            outcome = ACCEPTED
            if job is None and r.request == "create":
                job = (self.rules.created, 0, r.at_ms + self.ttl, 0)
            elif job is None:
                outcome = UNKNOWN
            elif after := judge(self.rules, job[0], r.request, r.target, job[1], r.progress):
                job = (*after, job[2], job[3] + (r.request == "report"))
            else:
                outcome = REFUSED
            yield Row(key=name, at_ms=r.at_ms, seq=r.seq, step=0, request=r.request, outcome=outcome, state=job[0] if job else None, progress=job[1] if job else None)
        if before and (job is None or job[2] != before[2]):
            self.handle.deleteTimer(before[2])
        if job is None:
            self.job.clear()
        else:
            if before is None or job[2] != before[2]:
                self.handle.registerTimer(job[2])
            self.job.update(job)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            _, progress, expires, _ = self.job.get()
            self.job.clear()
            yield from self._end(key[0], expires, progress, None, TIMER)

    def close(self) -> None:
        pass


def job_lifecycle(stream: DataFrame, key: str, seq: str, ts: str, request: str, target: str, progress: str, *, ttl_ms: int, late: str, rules: Rules | None = None) -> DataFrame:
    """One row for each request and three for each job that ends: key, at_ms, seq, step, request, outcome, state, progress (append mode).

    ``request`` is one of ``REQUESTS``; others are refused. A job is opened by its first ``create`` and lives for ``ttl_ms``
    of event time; a second one is refused while it lives. ``claim`` is accepted once, from a claimable state; ``setup``
    from the waiting state only, and never lowers progress; ``advance`` goes to ``target`` but not to an end state, and
    clamps progress to 0 to 100; ``report`` is saved while the job lives. Requests to a job that is not there, deleted or
    expired are ``unknown``. ``delete`` and expiry give deleting, purge and expired, in this order.

    A job's rows of one batch are sorted in memory by time and number. Rows without a key or a time are left out; rows
    older than the watermark, which follows the latest row by ``late``, are dropped by Spark.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    at = F.floor(F.unix_micros(ts) / 1000).cast("long")
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), at.alias("at_ms"), F.col(seq).cast("long").alias("seq"), F.col(request).alias("request"), F.col(target).alias("target"), F.coalesce(F.col(progress).cast("int"), F.lit(0)).alias("progress"))
    schema = f"key {kind}, at_ms long, seq long, step int, request string, outcome string, state string, progress int"
    out = rows.groupBy("key").transformWithState(statefulProcessor=_Jobs(rules or Rules(), ttl_ms), outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("key", key)


class _FirstClaim(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.claim = handle, handle.getValueState("claim", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = until = self.claim.get()[0] if self.claim.exists() else None
        for at, seq in sorted((r.at_ms, r.seq) for r in rows):
            if until is None or at >= until:
                until = at + self.keep
                yield Row(key=key[0], seq=seq)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.claim.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.claim.clear()
        return iter(())

    def close(self) -> None:
        pass


def final_claims(stream: DataFrame, key: str, seq: str, ts: str, open_states: Sequence[str], state: str, alive: Column, *, keep_ms: int, late: str) -> DataFrame:
    """key and the claiming row's number, once for each key (append mode): the earliest row in an open state, not expired.

    A claim that was given out stays; later rows of its key are passed over for ``keep_ms`` of event time, which is as long
    as the job may live. After that time its state is dropped, and the key may be claimed again. Rows without a key or a time are left out.
    """
    rows = stream.where(F.col(state).isin(*open_states) & alive & F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.floor(F.unix_micros(ts) / 1000).cast("long").alias("at_ms"), F.col(seq).cast("long").alias("seq"))
    out = rows.groupBy("key").transformWithState(statefulProcessor=_FirstClaim(keep_ms), outputStructType=StructType.fromDDL(f"key {dict(stream.dtypes)[key]}, seq long"), outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.col("seq").alias(seq))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """For the streams that are started inside: the state store that ``transformWithState`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
