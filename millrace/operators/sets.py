"""Set operations on rows and on arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys that are expected and not there."""
    return expected.select(*on).distinct().join(actual.select(*on).distinct(), list(on), "left_anti")


def not_stored(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested rows, repeats counted, that are not among the stored ones; empty if all are."""
    return requested.exceptAll(stored)


def shared_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def is_subset(required: Column, have: Column) -> Column:
    return F.size(F.array_except(required, have)) == 0


def first_seen_union(a: Column, b: Column) -> Column:
    """Items of both in first-seen order, each once."""
    return F.array_distinct(F.concat(a, b))
