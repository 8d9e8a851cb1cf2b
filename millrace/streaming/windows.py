"""Windowed counts that run alike on tables and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, by: Sequence[str], width: str, late: str | None = None) -> DataFrame:
    """Counts in windows of a fixed width; ``late`` sets the watermark of a stream."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(df: DataFrame, ts: str, by: Sequence[str], gap: str, late: str | None = None) -> DataFrame:
    """Counts of sessions that end after a gap."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
