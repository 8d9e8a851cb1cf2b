"""Job logs as streams: the state machine of each job, tails, claims, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import delete_at_end


def job_states(stream: DataFrame, key: str, seq: str, state: str, terminal: Sequence[str]) -> DataFrame:
    """key, state, seq and done of each job after every batch of its log (update mode).

    A terminal state is never left. The rows of a job in one batch may come in any order and in several pieces; only
    the first terminal row and the rows before it count.
    """
    ends = frozenset(terminal)

    def step(k: tuple[Any, ...], pieces: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, at, done = held.get if held.exists else (None, -1, False)
        rows: list[tuple[int, str]] = []
        stop = None
        for p in pieces:
            for s, v in zip(p[seq].tolist(), p[state].tolist(), strict=True):
                if v in ends and (stop is None or s < stop):
                    stop = s
                rows.append((s, v))
        if not done:
            reached = max((r for r in rows if r[0] > at and (stop is None or r[0] <= stop)), default=None)
            if reached:
                at, last = reached
                done = last in ends
                held.update((last, at, done))
        yield pd.DataFrame({key: [k[0]], state: [last], seq: [at], "done": [done]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {state} string, {seq} long, done boolean", f"{state} string, {seq} long, done boolean", "update", GroupStateTimeout.NoTimeout)


def tail_stream(stream: DataFrame, seq: str, after: int) -> DataFrame:
    return stream.where(F.col(seq) > after)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", scratch: bool = False) -> DataFrame:
    """Runs a stream over all that is there and gives what it put out, with the number of its batch.

    Each batch is written to a folder of its own, so a batch that is repeated after a failure replaces itself. A stream
    that puts nothing out gives an empty table. A ``scratch`` folder is deleted when the application ends.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/out/batch=-1")
    if scratch:
        delete_at_end(stream.sparkSession, folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def open_claims(stream: DataFrame, key: str, seq: str, open_states: Sequence[str], state: str, alive: Column) -> DataFrame:
    """key and the claiming row's number, after every batch (update mode): the first row in an open state, not expired."""
    return stream.where(F.col(state).isin(*open_states) & alive).groupBy(key).agg(F.min(seq).alias(seq))


def expiring_jobs(stream: DataFrame, key: str, ts: str, state: str, ttl: str, late: str, terminal: Sequence[str]) -> DataFrame:
    """Jobs whose last row is older than ``ttl`` once the watermark has passed that time: key, expired_at (append mode).

    A session window of a job's rows ends ``ttl`` after its last one; the state is dropped with it. Terminal rows neither
    open nor prolong a job.
    """
    rows = stream.where(~F.col(state).isin(*terminal)).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, ttl).alias("w"), key).agg(F.count("*").alias("rows")).select(key, F.col("w.end").alias("expired_at"), "rows")


def resumed(paused: DataFrame, setups: DataFrame, key: str, at: str, setup_at: str, within: str, late: str) -> DataFrame:
    """Pauses with the setups that arrive for them within a time: a join of two streams whose states the watermarks bound."""
    a, b = paused.withWatermark(at, late), setups.withWatermark(setup_at, late).withColumnRenamed(key, "__key")
    soon = (F.col(setup_at) > F.col(at)) & (F.col(setup_at) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & soon).drop("__key")
