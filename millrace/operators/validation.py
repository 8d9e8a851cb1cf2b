"""Violation reports: rules about rows and references give rows, and never stop a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import reasons


def violations(df: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """key and violation: a row for each check that does not hold."""
    return df.select(F.col(key).alias("key"), F.explode(reasons(checks)).alias("violation"))


def duplicate_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("__n")).where("__n > 1").select("key", F.lit(name).alias("violation"))


def dangling(df: DataFrame, key: str, ref: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """Rows whose reference is set and has no target."""
    targets = dim.select(F.col(dim_key).alias("__t")).distinct()
    return df.where(F.col(ref).isNotNull()).join(targets, F.col(ref) == F.col("__t"), "left_anti").select(F.col(key).alias("key"), F.lit(name).alias("violation"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, repeats counted: ``side`` is only_left or only_right. Empty if equal."""
    left = a.exceptAll(b).withColumn("side", F.lit("only_left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right")))


def closure(required: DataFrame, present: DataFrame, by: str, item: str) -> DataFrame:
    """For each ``by``: how many required items there are and lack, and whether it is complete."""
    have = present.select(by, item).distinct().withColumn("__there", F.lit(1))
    joined = required.select(by, item).distinct().join(have, [by, item], "left")
    out = joined.groupBy(by).agg(F.count("*").alias("required"), F.count_if(F.col("__there").isNull()).alias("lacking"))
    return out.withColumn("status", F.when(F.col("lacking") == 0, "complete").otherwise("incomplete"))


def keyframe_checks(packages: DataFrame, frames: DataFrame, key: str, *, count: int = 7, tolerance: float = 0.25) -> DataFrame:
    """key and violation of packages that may not be exported.

    ``packages`` has start, end and duration; ``frames`` has key, name and at. Exactly ``count`` frames with different
    names must lie in the window, none outside of it, and the window's length may differ from the duration by at most
    ``tolerance``.
    """
    span = packages.select(key, "start", "end", "duration")
    # one sort of each package's frames counts its names by their rank and joins: a task holds no table of keys and names
    whole, by_name = Window.partitionBy(key), Window.partitionBy(key).orderBy(F.desc_nulls_last("name"))
    f = frames.select(key, "name", "at").withColumns({"__rank": F.when(F.col("name").isNotNull(), F.dense_rank().over(by_name)), "__row": F.row_number().over(by_name)})
    found = {"__n": F.count("*"), "__names": F.max("__rank"), "__first": F.min("at"), "__last": F.max("at")}
    f = f.select(key, "__row", *[c.over(whole).alias(name) for name, c in found.items()]).where("__row = 1")
    all_ = span.join(f.hint("merge"), key, "left")
    out = ~((F.col("__first") >= F.col("start")) & (F.col("__last") <= F.col("end")))
    n = F.coalesce(F.col("__n"), F.lit(0))
    return violations(all_, key, [("keyframe_count", n == count), ("keyframe_names", F.coalesce(F.col("__names"), F.lit(0)) == n), ("outside_window", ~F.coalesce(out, F.lit(False))), ("duration", F.abs(F.col("end") - F.col("start") - F.col("duration")) <= tolerance)])


def refreshed(catalogue: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """A refreshed catalogue: a row that is cached already stays as it is, only new keys are taken from ``catalogue``."""
    return cached.unionByName(catalogue.join(cached.select(key), key, "left_anti").select(*cached.columns))


def check_request(limit: int, most: int = 3, required: dict[str, str | None] | None = None, choices: dict[str, tuple[str | None, Sequence[str]]] | None = None) -> None:
    """Raises an error for a limit that is not from 1 to ``most``, a required id that is blank, or a value of no choice."""
    wrong = [] if 1 <= limit <= most else [f"limit {limit}"]
    wrong += [name for name, value in (required or {}).items() if not (value or "").strip()]
    wrong += [f"{name} {value}" for name, (value, known) in (choices or {}).items() if value is not None and value not in known]
    if wrong:
        raise ValueError("not allowed: " + ", ".join(wrong))


def require_known(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """``df``, all of whose values in ``column`` must be keys of ``known``; otherwise an error names some that are not."""
    lost = df.select(column).distinct().join(known.select(F.col(key).alias(column)), column, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"unknown {column}: {[r[0] for r in lost]}")
    return df
