"""Centroid clustering over a vector-approximation file: exact k-means that mostly looks at a few bits for each component.

Every component is an integer, and is kept a second time as the number of its cell: 4 bits, two components to a byte, by
marks that follow the mean and spread of that component over all vectors. For each byte of such cells and each centroid a
table holds the least and the largest sum of squares that the two components can add. Summing 32 look-ups instead of 64
differences gives an interval for every distance; a centroid whose interval begins beyond the smallest upper end of the
row cannot be nearest. Where one centroid is left, it is taken without a look at the vector; only rows whose intervals
overlap have their full vectors fetched from the batch, and only for the centroids that are left.

Vectors and cells lie side by side in one Parquet table, so that a fetch is a slice of the batch and not a shuffle. A
round is one scan without a shuffle of vectors: a task gives a sum and a count for each centroid. Marks, centroids and
tables depend on the number of components and centroids alone, so what is sent to tasks does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Cells of a component, and rows that are judged at once.
CELLS, _ROWS = 16, 4096
#: Components are held to this range, so that squares, distances and the sums of 2^36 vectors fit into a long.
MOST = 2**26


def integers(vector: Column, dim: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null unless there are ``dim`` components, all finite."""
    fits = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), x.cast("double") * scale))))).cast("int")
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vector, held))


def marks(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component the 15 marks between its cells, its least and its largest value, from all vectors."""
    at = [F.col("v")[d] for d in range(dim)]
    row = vectors.agg(*[f(x) for x in at for f in (F.min, F.max, F.avg, F.stddev_pop)]).first()
    low, high, mean, spread = np.array(row, dtype=np.float64).reshape(dim, 4).T
    # cells of a third of the spread around the mean; the outer two take what lies beyond
    steps = np.linspace(-7 / 3, 7 / 3, CELLS - 1)
    return np.ceil(mean[:, None] + steps * spread[:, None]).astype(np.int64), low.astype(np.int64), high.astype(np.int64)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def pack(v: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The cells of each row, two to a byte; an odd last component has a byte of its own."""
    cells = np.zeros((len(v), v.shape[1] + v.shape[1] % 2), np.uint8)
    for d in range(v.shape[1]):
        cells[:, d] = np.searchsorted(borders[d], v[:, d], side="right")
    return cells[:, ::2] * CELLS + cells[:, 1::2]


def tables(centroids: np.ndarray, borders: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest sum of squares by byte of cells and centroid: two arrays of (bytes of a row, 256, centroids)."""
    dim = len(borders)
    first = np.concatenate([low[:, None], borders], 1)  # the integers of a cell, both ends included
    last = np.concatenate([borders - 1, high[:, None]], 1)
    first, last = np.maximum(first, low[:, None]), np.minimum(last, high[:, None])
    c = centroids.T[:, None, :]
    a, b = first[:, :, None] - c, c - last[:, :, None]
    least, most = np.maximum(0, np.maximum(a, b)) ** 2, np.maximum(a**2, b**2)
    if dim % 2:
        pad = np.zeros((1, CELLS, len(centroids)), np.int64)
        least, most = np.concatenate([least, pad]), np.concatenate([most, pad])
    pairs = [(x[::2, :, None, :] + x[1::2, None, :, :]).reshape(len(x) // 2, CELLS * CELLS, -1) for x in (least, most)]
    return pairs[0], pairs[1]


def nearest(cells: np.ndarray, fetch, centroids: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smallest of equals), and for which rows ``fetch(rows)`` was asked for vectors."""
    low, high = np.zeros((len(cells), len(centroids)), np.int64), np.zeros((len(cells), len(centroids)), np.int64)
    for k in range(cells.shape[1]):
        low += least[k][cells[:, k]]
        high += most[k][cells[:, k]]
    left = low <= high.min(1)[:, None]
    found, open_ = left.argmax(1), left.sum(1) > 1
    rows = np.flatnonzero(open_)
    if len(rows):
        v, left = fetch(rows), left[rows]
        best = np.full(len(rows), np.iinfo(np.int64).max)
        for k, c in enumerate(centroids):
            r = np.flatnonzero(left[:, k])
            d = ((v[r] - c) ** 2).sum(1)
            nearer = d < best[r]
            r = r[nearer]
            best[r], found[rows[r]] = d[nearer], k
    return found, open_


def _approximate(dim: int, borders: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pack(_matrix(batch.column("v"), dim), borders)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([r.tobytes() for r in cells], pa.binary())], names=["vec_id", "v", "cells"])

    return run


def _assigned(batch: pa.RecordBatch, dim: int, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the centroid of each row, and whether its vector was needed for that."""
    for at in range(0, batch.num_rows, _ROWS):
        part = batch.slice(at, _ROWS)
        vectors = part.column("v")
        cells = np.frombuffer(b"".join(x.as_py() for x in part.column("cells")), np.uint8).reshape(part.num_rows, -1)
        found, fetched = nearest(cells, lambda rows, vectors=vectors: _matrix(vectors.take(pa.array(rows)), dim), centroids, *bounds)
        yield part, found, fetched


def _sums(dim: int, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for part, found, _ in _assigned(batch, dim, centroids, bounds):
                v = _matrix(part.column("v"), dim)  # the new centroid needs every vector
                order = np.argsort(found, kind="stable")
                ids, starts = np.unique(found[order], return_index=True)
                total[ids] += np.add.reduceat(v[order], starts, axis=0)
                count += np.bincount(found, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _last(dim: int, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found, fetched in _assigned(batch, dim, centroids, bounds):
                away = ((_matrix(part.column("v"), dim) - centroids[found]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(found, pa.int32()), pa.array(away), pa.array(fetched)], names=["vec_id", "cluster", "distance", "fetched"])

    return run


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cluster of every vector: vec_id, cluster, distance (squared), fetched, centroid (its components).

    Vectors with exactly ``dim`` components, none of them null or not finite, become integers ``floor(scale * x)``; others
    have no row. Components beyond 2^26 are held to it. The centroids start as the ``k`` vectors with the smallest SHA-256
    of ``seed:id``, in that order; of vectors that share an id, the smaller one is first, and those without an id are last.
    With fewer vectors there are as many centroids; an empty table gives an empty result. Each of ``rounds`` rounds assigns
    all vectors (ties: the smaller number) and moves every centroid with vectors to the floor of their mean; then they are
    assigned once more. ``fetched`` tells whether the approximation left that last choice open. Rows that repeat an id
    count and return as often as they stand; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), integers(F.col(vector), dim, scale).alias("v")).where("v IS NOT NULL")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, fetched boolean"
    if not first:
        return spark.createDataFrame([], f"{schema}, centroid array<long>")
    centroids = np.array([r.v for r in first], np.int64)
    borders, low, high = marks(rows, dim)
    file = materialize(rows.mapInArrow(_approximate(dim, borders), "vec_id long, v array<int>, cells binary"))
    for _ in range(rounds):
        parts = file.select("v", "cells").mapInArrow(_sums(dim, centroids, tables(centroids, borders, low, high)), "cluster int, n long, sums array<long>")
        moved = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dim)]).alias("sums")).collect()
        for r in moved:
            centroids[r.cluster] = [x // r.n for x in r.sums]
    found = materialize(file.mapInArrow(_last(dim, centroids, tables(centroids, borders, low, high)), schema))
    ends = spark.createDataFrame([(n, c) for n, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "fetched", "centroid")


def with_inertia(found: DataFrame) -> DataFrame:
    """Adds cluster_inertia and inertia: the distances summed over the cluster and over all; null where no long holds them."""
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda x: x if x < 2**63 else None
    whole = fits(sum(int(r.s) for r in by))
    sums = found.sparkSession.createDataFrame([(r.cluster, fits(int(r.s)), whole) for r in by], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(sums), "cluster")


#: The same in SQL: integers by component, three rounds, and the last assignment.
_ROUND = """c{m} AS (SELECT k, d, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN (SELECT k, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY ALL) USING (k, d)),
"""
_ASSIGN = """a{r} AS MATERIALIZED (SELECT rid, min(k) AS k, min(away) AS away FROM (SELECT rid, k, away, min(away) OVER (PARTITION BY rid) AS best FROM (SELECT rid, k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS away FROM v JOIN c{r} c USING (d) GROUP BY ALL)) WHERE away = best GROUP BY rid),
"""
SQL = (
    """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, unnest(v) AS x FROM kept),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept ORDER BY 2 LIMIT 16),
c0 AS (SELECT k, d, x FROM s JOIN v USING (rid)),
"""
    + "".join(_ASSIGN.format(r=r) + _ROUND.format(r=r, m=r + 1) for r in range(3))
    + _ASSIGN.format(r=3)
    + """h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, away AS distance, CAST(sum(away) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(away) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN kept USING (rid) JOIN h USING (k)"""
)
