"""Slots for models that the library does not bring: detectors, trackers, reviewers.

A slot maps rows to rows in Arrow batches. Without a model, a slot is closed: it gives no rows, or a column that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def detect(rows: DataFrame, model: Model | None, schema: str) -> DataFrame:
    """Rows that a model finds in rows; none without a model."""
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(model, schema)


def review_status(model_ran: Column, accepted: Column) -> Column:
    """``accepted`` only where a model ran and accepted; ``unavailable`` where none ran, else ``rejected``."""
    ran = F.coalesce(model_ran, F.lit(False))
    return F.when(~ran, "unavailable").when(F.coalesce(accepted, F.lit(False)), "accepted").otherwise("rejected")
