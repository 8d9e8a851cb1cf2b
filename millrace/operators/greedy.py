"""Choices that depend on what was kept before, over each group's rows in order.

Rows are dealt by group and sorted by Spark; a task reads them in Arrow batches and holds what it has kept of the group
that it is in, never a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Takes the next row and says what becomes of it: a value for the result, or None to leave the row out.
Step = Callable[[tuple[Any, ...]], int | None]


def fold(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str], start: Callable[[], Step], name: str) -> DataFrame:
    """Rows of ``df`` that a fresh step for each group answers, with the answer in a long column ``name``.

    ``order`` must be total within a group; ``columns`` are what a step sees of a row.
    """
    wide = [c for c in df.columns if c != name]
    schema = df.select(*wide).withColumn(name, F.lit(None).cast("long")).schema
    keys, seen = [wide.index(c) for c in by], [wide.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in keys), strict=True)
            rows = zip(*(batch.column(i).to_pylist() for i in seen), strict=True)
            out = []
            for group, row in zip(groups, rows, strict=True):
                if step is None or group != at:
                    at, step = group, start()
                out.append(step(row))
            answers = pa.array(out, pa.int64())
            full = pa.RecordBatch.from_arrays([*batch.columns, answers], names=[*wide, name])
            yield full.filter(answers.is_valid())

    return df.select(*wide).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class _Kept:
    """Kept intervals by start; what may touch another one lies within the longest one's length."""

    def __init__(self) -> None:
        self.items: list[tuple[Any, ...]] = []
        self.longest = 0

    def near(self, s: int, e: int) -> Iterator[tuple[Any, ...]]:
        for i in range(bisect_left(self.items, (s - self.longest,)), len(self.items)):
            if self.items[i][0] > e:
                return
            yield self.items[i]

    def add(self, item: tuple[Any, ...]) -> None:
        insort(self.items, item)
        self.longest = max(self.longest, item[1] - item[0])


def suppress(df: DataFrame, by: Sequence[str], order: Sequence[Column], s: str, e: str, share: float, most: int) -> DataFrame:
    """Greedy suppression: a row stays unless it overlaps a kept one by more than ``share`` of the shorter of both; at
    most ``most`` of a group. place: from 1, the order in which they were kept."""

    def start() -> Step:
        kept: list[tuple[int, int]] = []

        def step(row: tuple[Any, ...]) -> int | None:
            a, b = row
            if len(kept) >= most or any(max(0, min(b, y) - max(a, x)) > share * min(b - a, y - x) for x, y in kept):
                return None
            kept.append((a, b))
            return len(kept)

        return step

    return fold(df, by, order, [s, e], start, "place")


def non_overlapping(df: DataFrame, by: Sequence[str], order: Sequence[Column], s: str, e: str) -> DataFrame:
    """Greedy choice of half-open intervals that do not overlap. place: from 1, the order in which they were kept."""

    def start() -> Step:
        kept = _Kept()

        def step(row: tuple[Any, ...]) -> int | None:
            a, b = row
            if any(a < y[1] and b > y[0] for y in kept.near(a, b)):
                return None
            kept.add((a, b))
            return len(kept.items)

        return step

    return fold(df, by, order, [s, e], start, "place")


def mark_duplicates(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, s: str, e: str, least: float, labels: str | None = None) -> DataFrame:
    """duplicate_of: the first kept row whose IoU with this one is at least ``least`` and, if there are ``labels`` (an
    array), that shares one of them; -1 for rows that are kept themselves."""

    def start() -> Step:
        kept, n = _Kept(), 0

        def step(row: tuple[Any, ...]) -> int:
            nonlocal n
            k, a, b, own = (*row, None)[:4] if labels is None else row
            first = None
            for x, y, place, other, names in kept.near(a, b):
                both = max(0, min(b, y) - max(a, x))
                union = (b - a) + (y - x) - both
                if union > 0 and both / union >= least and (labels is None or not names.isdisjoint(own or ())) and (first is None or place < first[0]):
                    first = (place, other)
            if first:
                return first[1]
            kept.add((a, b, n := n + 1, k, frozenset(own or ())))
            return -1

        return step

    return fold(df, by, order, [key, s, e, *([labels] if labels else [])], start, "duplicate_of")


def spaced(df: DataFrame, by: Sequence[str], order: Sequence[Column], at: str, gap: int, media: str | None = None) -> DataFrame:
    """Greedy choice of rows at least ``gap`` from all chosen before, and with ``media`` none whose media was chosen.
    place: from 1, the order in which they were chosen."""

    def start() -> Step:
        chosen: list[int] = []
        seen: set[Any] = set()

        def step(row: tuple[Any, ...]) -> int | None:
            t = row[0]
            i = bisect_left(chosen, t)
            if i < len(chosen) and chosen[i] - t < gap or i and t - chosen[i - 1] < gap or media and row[1] in seen:
                return None
            chosen.insert(i, t)
            if media:
                seen.add(row[1])
            return len(chosen)

        return step

    return fold(df, by, order, [at, *([media] if media else [])], start, "place")
