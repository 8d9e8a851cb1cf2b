"""Counts by several dimensions, fixed domains, roll-ups and ordered collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by_each(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """dim, value and n: the counts by each dimension on its own, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def domain_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts in the order of a fixed domain (place from 0), without the values that do not occur."""
    place = F.array_position(F.array(*[F.lit(d) for d in domain]), F.col(column)) - 1
    return df.where(F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias("n")).withColumn("place", place.cast("long"))


def conditional_counts(df: DataFrame, by: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def worst_child(df: DataFrame, by: Sequence[str], state: str, priority: Sequence[str]) -> DataFrame:
    """The state of a parent: the child state that comes first in the priority list."""
    places = F.array(*[F.lit(p) for p in priority])
    rank = F.min(F.nullif(F.array_position(places, F.col(state)), F.lit(0)))
    return df.groupBy(*by).agg(rank.alias("__r")).withColumn("state", F.get(places, (F.col("__r") - 1).cast("int"))).drop("__r")


def ordered_distinct(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """by and list: distinct values in the order of their first occurrence. Rows are reduced to one for each value first."""
    first = F.min(F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)]))
    each = df.groupBy(*by, value).agg(first.alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__at"), F.col(value).alias("v"))))
    return each.groupBy(*by).agg(F.transform(listed, lambda s: s["v"]).alias("list"))


def duplicated_groups(df: DataFrame, by: Sequence[str], digest: Column) -> DataFrame:
    """Groups in which a digest occurs twice: rows and distinct digests."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(digest).alias("kinds")).where("rows > kinds")


def null_safe_means(df: DataFrame, roles: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and count for every role; 0 where a role has no rows."""
    found = df.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return roles.join(found, by, "left").select(by, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))
