"""Joins by shape: ordered look-ups, overrides, unresolved keys, joins by one of several keys, edges of a graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

from .ranking import top_per_group


def lookup_in_order(rows: DataFrame, key: str, ids: str, dim: DataFrame, dim_key: str, value: str) -> DataFrame:
    """key and found: the dimension's values for an array of ids, in the array's order; unknown ids are dropped."""
    one = rows.select(key, F.posexplode(ids).alias("__p", dim_key))
    hits = one.join(dim.select(dim_key, value), dim_key)
    found = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", value))).alias("found"))
    out = rows.select(key).distinct().join(found, key, "left")
    return out.select(key, F.coalesce(F.transform("found", lambda x: x[value]), F.array()).alias("found"))


def looked_up(rows: DataFrame, by: str, order: Sequence[str], dim: DataFrame, key: str, value: str) -> DataFrame:
    """by and found: for each group the values that its rows' keys have in ``dim``, in order; unknown keys are left out.

    For rows that are not arrays yet: one join by key and one grouping.
    """
    joined = rows.join(dim.select(key, value), key, "left")
    hits = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, value))))
    return joined.groupBy(by).agg(hits.alias("__x")).select(by, F.transform("__x", lambda s: s[value]).alias("found"))


def override(base: DataFrame, reviews: DataFrame, on: Sequence[str], column: str, latest: str) -> DataFrame:
    """``base`` with a column replaced by the last review of the same keys, where there is one; of equally late ones by the greatest value."""
    last = top_per_group(reviews, on, [F.desc(latest), F.desc(column)], 1).select(*on, F.col(column).alias("__new"))
    return base.join(last, list(on), "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def unresolved(rows: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct keys without a row in the dimension."""
    return rows.where(F.col(key).isNotNull()).select(key).distinct().join(dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti")


def join_any(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], ids: tuple[str, str]) -> DataFrame:
    """Distinct pairs of ids that agree in one of several keys: an equi join for each, and the union of what they find.

    Ids, not pairs, are made distinct, each with all of its values of every key; a pair is then given by the first key in
    which it agrees alone, and there by the least common value. So pairs are neither shuffled nor held.
    """
    side = lambda df, one, at, name: df.groupBy(one).agg(F.struct(*[F.collect_set(k[at]).alias(f"k{i}") for i, k in enumerate(keys)]).alias(name))
    a, b = side(left, ids[0], 0, "__a"), side(right, ids[1], 1, "__b")
    parts = []
    for i in range(len(keys)):
        pairs = a.withColumn("__k", F.explode(f"__a.k{i}")).join(b.withColumn("__k", F.explode(f"__b.k{i}")), "__k")
        least = F.array_min(F.array_intersect(f"__a.k{i}", f"__b.k{i}"))
        earlier = [~F.arrays_overlap(f"__a.k{j}", f"__b.k{j}") for j in range(i)]
        parts.append(pairs.where(reduce(and_, earlier, F.col("__k") == least)).select(*ids))
    return reduce(DataFrame.unionByName, parts)


def shared_items(left: DataFrame, right: DataFrame, on: Sequence[str], ids: tuple[str, str], item: str, arrays: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys and at least one common array item, and how many they share."""
    a = left.select(*on, ids[0], F.explode(F.array_distinct(arrays[0])).alias(item))
    b = right.select(*on, ids[1], F.explode(F.array_distinct(arrays[1])).alias(item))
    return a.join(b, [*on, item]).groupBy(*on, *ids).agg(F.count("*").alias("shared"))


def missing_reverse(edges: DataFrame, back: DataFrame, a: str, b: str) -> DataFrame:
    """Edges a → b without an edge b → a in ``back``."""
    there = back.select(F.col(b).alias(a), F.col(a).alias(b)).distinct()
    return edges.select(a, b).distinct().join(there, [a, b], "left_anti")


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """a and the sorted distinct nodes that its edges lead to."""
    return edges.groupBy(a).agg(F.array_sort(F.collect_set(b)).alias("neighbours"))


def reachable(edges: DataFrame, start: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Nodes within ``most`` steps of the start nodes, with their least number of steps. Each step's nodes are stored once."""
    seen = stored(start.select(F.col(a).alias("node")).distinct().withColumn("steps", F.lit(0).cast("long")))
    front = seen
    for step in range(1, most + 1):
        front = stored(front.join(edges.select(F.col(a).alias("node"), F.col(b).alias("__to")), "node").select(F.col("__to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step).cast("long")))
        seen = seen.unionByName(front)
    return seen


def override_chain(rows: DataFrame, key: str, first: DataFrame, second_key: str, second: DataFrame, value: str) -> DataFrame:
    """A value from an override table by ``key``, else from a default table by ``second_key``."""
    a = first.select(key, F.col(value).alias("__a"))
    b = second.select(second_key, F.col(value).alias("__b"))
    return rows.join(a, key, "left").join(b, second_key, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
