"""Choices that depend on the ones before: one pass over each group's rows in order, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stable_choice(df: DataFrame, by: str, frame: str, key: str, x: str, y: str, size: str, reach: float) -> DataFrame:
    """Of each frame the candidate nearest to the last choice if within ``reach``, else the largest one.

    Ties: the smaller key. Rows are dealt by group and sorted, so a task holds one frame at a time, not a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = last = None
        at, frame_rows = None, []

        def choose(rows: list[tuple]) -> tuple:
            near = min(((a - last[0]) * (a - last[0]) + (b - last[1]) * (b - last[1]), k, a, b) for k, a, b, _ in rows) if last else None
            if near is not None and near[0] <= reach * reach:
                return near[1:]
            return min((-s, k, a, b) for k, a, b, s in rows)[1:]

        for batch in batches:
            out = []
            for g, f, k, a, b, s in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (g, f) != at:
                    if frame_rows:
                        chosen = choose(frame_rows)
                        out.append((*at, chosen[0]))
                        last = chosen[1:]
                    if g != group:
                        group, last = g, None
                    at, frame_rows = (g, f), []
                frame_rows.append((k, a, b, s))
            yield table(out)
        if frame_rows:
            yield table([(*at, choose(frame_rows)[0])])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[by, frame, key])

    rows = df.select(F.col(by).cast("long").alias(by), F.col(frame).cast("long").alias(frame), F.col(key).cast("long").alias(key), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), F.col(size).cast("double").alias(size))
    return rows.repartition(by).sortWithinPartitions(by, frame, key).mapInArrow(run, f"{by} long, {frame} long, {key} long")
