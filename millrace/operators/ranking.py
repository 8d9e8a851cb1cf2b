"""Sorting and selection with total orders: every ranking names its tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a hash by which rows are counted to find a share's end: 4,096 bins for each group.
_HASH_LETTERS = 3


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, one row for each group; a null in ``by`` is a group like any other."""
    named = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return rows.join(named, same, how).drop(*[f"__{c}" for c in by])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 within ``by``; ``order`` should be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return ranked(df, by, order, "__rank").where(F.col("__rank") <= k).drop("__rank")


def best_per_group(df: DataFrame, by: Sequence[str], key: Sequence[Column], largest: bool = False) -> DataFrame:
    """The row of each group with the least (or the largest) key, all columns.

    Spark limits each task's rows to one for a group before the shuffle, so that a large group is a row for each task.
    """
    return top_per_group(df, by, [k.desc() if largest else k.asc() for k in key], 1)


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of all, by partial sorts of the partitions."""
    return df.orderBy(*order).limit(k)


def one_per_source(df: DataFrame, by: Sequence[str], source: str, order: Sequence[Column], k: int) -> DataFrame:
    """The best row of each source, then the first ``k`` of these in each group of ``by``."""
    return top_per_group(top_per_group(df, [*by, source], order, 1), by, order, k)


def preferred_tier(df: DataFrame, by: Sequence[str], preferred: Column) -> DataFrame:
    """Where a group has preferred rows, these alone; otherwise all of it."""
    chosen = F.coalesce(preferred, F.lit(False))
    there = df.where(chosen).select(*by).distinct()
    return df.where(chosen).unionByName(join_groups(df.where(~chosen), there, by, "left_anti"))


def fill_to_cap(df: DataFrame, by: Sequence[str], unit: str, best: Sequence[Column], cap: int) -> DataFrame:
    """The best row of each unit first, then the best of the rest, up to ``cap`` in each group."""
    firsts = ranked(df, [*by, unit], best, "__first")
    order = [F.when(F.col("__first") == 1, 0).otherwise(1), *best]
    return ranked(firsts, by, order, "__n").where(F.col("__n") <= cap).drop("__first", "__n")


def stratified_sample(df: DataFrame, by: Sequence[str], key: Column, share: float = 0.2, least: int = 10) -> DataFrame:
    """Of each group the rows first in order of the SHA-256 of ``key``: a share, rounded up, and ``least`` at least."""
    # counts by the first letters of the hash tell where a group's share ends; only rows at this place are ranked
    keyed = df.withColumn("__sha", F.sha2(key.cast("string"), 256)).withColumn("__bin", F.substring("__sha", 1, _HASH_LETTERS))
    bins = keyed.groupBy(*by, "__bin").agg(F.count("*").alias("__in"))
    whole, up = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("__of", F.sum("__in").over(whole)).withColumn("__before", F.sum("__in").over(up) - F.col("__in"))
    bins = bins.withColumn("__left", F.least(F.col("__of"), F.greatest(F.lit(least), F.ceil(F.col("__of") * share))) - F.col("__before")).where("__left > 0")
    near = join_groups(keyed, bins.drop("__of", "__before"), [*by, "__bin"])
    edge = ranked(near.where(F.col("__in") > F.col("__left")), [*by, "__bin"], [F.col("__sha"), key], "__n").where(F.col("__n") <= F.col("__left"))
    return near.where(F.col("__in") <= F.col("__left")).select(*df.columns).unionByName(edge.select(*df.columns))


def shard_of(key: Column, shards: int) -> Column:
    """The part, from 0, of a key that numbers the rows."""
    return F.pmod(key, F.lit(shards))


def shard(df: DataFrame, key: Column, shards: int, which: int) -> DataFrame:
    """One of ``shards`` parts by a key that numbers the rows."""
    return df.where(shard_of(key, shards) == which)


def best_position(values: Column) -> Column:
    """Position from 0 of the greatest value of an array, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def greedy_next(items: Column, limit: int) -> Column:
    """The first ``limit`` items with different drills in order; an item without a drill always counts.

    ``items``: array of struct (seq, id, drill), sorted by seq.
    """
    seen = F.aggregate(items, F.array().cast("array<struct<seq:long,id:long,drill:string>>"), lambda acc, x: F.when((F.size(acc) < limit) & (x["drill"].isNull() | ~F.exists(acc, lambda y: F.coalesce(y["drill"] == x["drill"], F.lit(False)))), F.concat(acc, F.array(x))).otherwise(acc))
    return F.transform(seen, lambda x: x["id"])


def by_preference(df: DataFrame, by: Sequence[str], value: str, preferred: DataFrame, k: int) -> DataFrame:
    """Values in the order of a preference table (value, place), the others after them by name; the first ``k``."""
    joined = df.join(preferred, value, "left")
    return ranked(joined, by, [F.coalesce("place", F.lit(2**31 - 1)), F.col(value)]).where(F.col("rank") <= k).drop("place")


def grid_peaks(grid: Column | str, width: int, *, threshold: float, radius: int = 1, most: int = 3) -> Column:
    """Peaks of a heat map given row by row: an array of confidence, x and y, the last two as shares of the map.

    Cells of at least ``threshold`` come in order of value, then y, then x; one within ``radius`` of a peak in both
    directions is passed over, and there are ``most`` peaks at most. All of it is decided within the row.
    """
    grid = F.col(grid) if isinstance(grid, str) else grid
    cells = F.transform(grid, lambda v, i: F.struct((-v).cast("double").alias("less"), F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x")))
    ranked = F.array_sort(F.filter(cells, lambda c: -c["less"] >= threshold))
    near = lambda a, b: (F.abs(a["x"] - b["x"]) <= radius) & (F.abs(a["y"] - b["y"]) <= radius)
    none = F.array().cast("array<struct<less:double,y:int,x:int>>")
    picked = F.aggregate(ranked, none, lambda kept, c: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: near(k, c)), F.array_append(kept, c)).otherwise(kept))
    tall = F.greatest(F.lit(1), F.floor(F.size(grid) / width) - 1)
    return F.transform(picked, lambda c: F.struct((-c["less"]).alias("confidence"), (c["x"] / max(1, width - 1)).alias("x"), (c["y"] / tall).alias("y")))
