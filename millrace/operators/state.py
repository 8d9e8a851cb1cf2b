"""Logs of jobs and events as tables: latest rows, tails, claims, expiry and state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best_per_group


def latest(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key in the order of the log."""
    return best_per_group(df, by, [F.col(seq)], largest=True)


def tail(df: DataFrame, seq: str, after: Column | int) -> DataFrame:
    """Rows of the log after a sequence number."""
    return df.where(F.col(seq) > after)


def claims(df: DataFrame, by: Sequence[str], seq: str, open_states: Sequence[str], state: str, alive: Column) -> DataFrame:
    """The first row of each key that may claim it: in an open state and not expired."""
    return best_per_group(df.where(F.col(state).isin(*open_states) & alive), by, [F.col(seq)])


def expired(df: DataFrame, expires: str, now: Column, state: str, terminal: Sequence[str]) -> DataFrame:
    """Rows past their time that are not terminal yet."""
    return df.where((F.col(expires) <= now) & ~F.col(state).isin(*terminal))


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """``base`` with rows replaced or added by the last change of each key."""
    last = latest(changes, key, seq)
    return base.join(last.select(*key), list(key), "left_anti").unionByName(last)


def delete_children(df: DataFrame, fk: str, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def pending(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a resumed stage still has to do."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def monotone_progress(df: DataFrame, by: Sequence[str], seq: str, progress: str) -> DataFrame:
    """Progress that never falls, held to 0 to 100."""
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(progress, F.greatest(F.lit(0), F.least(F.lit(100), F.max(progress).over(w))))


def final_states(df: DataFrame, by: Sequence[str], seq: str, state: str, terminal: Sequence[str]) -> DataFrame:
    """The state of each key after its log: the first terminal state ends it, else the last state stands."""
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    dead = F.coalesce(F.max(F.col(state).isin(*terminal).cast("int")).over(w), F.lit(0))
    return latest(df.withColumn("__dead", dead).where("__dead = 0").drop("__dead"), by, seq)
