"""Pairs of texts whose sets of shingles have a Jaccard similarity of at least some share.

Texts that agree in one of ``BANDS`` groups of minimum hashes meet in a bucket; at a similarity of 0.8 a pair misses all
of them with a probability of 3e-6. Pairs of a bucket whose hashes agree often enough are confirmed with the sets
themselves. A first round confirms each text's best partner only, and joins most of a cluster. Texts that still have
likely partners in other groups then meet in their buckets once more, with their sets; every such pair is compared there,
in the first bucket that both share, and a task gives out a spanning forest of what it has found, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, giving_back, materialize
from .components import components

BANDS, ROWS = 32, 5
_N = BANDS * ROWS
_CHUNK = 2048
_TILE = 256
_draw = np.random.Generator(np.random.PCG64(42)).integers(0, 2**63, (3, _N), np.uint64)
_XOR, _TIMES = _draw[0], _draw[1] | np.uint64(1)
_MIX, _BAND = (_draw[2] | np.uint64(1)).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the shingles (numbers) for each of the hash functions."""
    least = np.full(_N, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), _CHUNK):
        np.minimum(least, ((shingles[a : a + _CHUNK, None] ^ _XOR) * _TIMES).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The names of a text's buckets."""
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """A byte of each minimum, from the middle."""
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def least_equal(share: float) -> int:
    """Equal bytes of two signatures, below which a similarity of ``share`` is 4.5 standard deviations away."""
    return math.floor(share * _N - 4.5 * math.sqrt(share * (1 - share) * _N))


def _likely(group: np.ndarray, side: np.ndarray, both: bool, sig: np.ndarray, least: int, band: int = 0, names: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a cell of different groups with enough equal bytes, and how many, tile by tile.

    With ``names``, the buckets of each member, only pairs that share no bucket before this one.
    """
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if both else left
    for x in range(0, len(left), _TILE):
        a = left[x : x + _TILE]
        for y in range(0 if both else x, len(right), _TILE):
            b = right[y : y + _TILE]
            i, j = np.nonzero(group[a][:, None] != group[b][None, :])
            i, j = a[i], b[j]
            if not both:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                p, q = i[k : k + 65_536], j[k : k + 65_536]
                equal = np.concatenate([(sig[p[m : m + 4096]] == sig[q[m : m + 4096]]).sum(1) for m in range(0, len(p), 4096)])
                near = np.flatnonzero(equal >= least)
                p, q, equal = p[near], q[near], equal[near]
                if names is not None and len(p):
                    shared = names[p] == names[q]
                    first = names[p][np.arange(len(p)), shared.argmax(1)] == band
                    p, q, equal = p[first], q[first], equal[first]
                if len(p):
                    yield p, q, equal


def _best(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a cell that has a likely partner the one with most equal bytes."""
    best, with_ = np.zeros(n, np.int64), np.full(n, -1)
    for i, j, equal in pairs:
        for p, q in ((i, j), (j, i)):
            o = np.argsort(equal, kind="stable")
            more = equal[o] > best[p[o]]
            o = o[more]  # of several, the last and thus the largest is assigned
            best[p[o]], with_[p[o]] = equal[o], q[o]
    i = np.flatnonzero(with_ >= 0)
    return i, with_[i]


def _by_cell(solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Reads rows sorted by cell and hands whole cells on; a cell has a bounded number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            last = batch.column("cell")[-1]
            if waiting[0].column("cell")[0] == last:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            cut = int(np.searchsorted(table.column("cell").to_numpy(), last.as_py()))
            yield from solve(table.slice(0, cut))
            waiting = table.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield from solve(pa.Table.from_batches(waiting).combine_chunks())

    return run


def _cells(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, np.ndarray, int, np.ndarray]]:
    """Of each cell: its rows' range, groups, sides, whether it is a pair of parts, signatures, bucket and members' buckets."""
    cell, group, side, band = (table.column(n).to_numpy() for n in ("cell", "group", "side", "band"))
    both = table.column("two").to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(each(table.column("sig"))), np.uint8).reshape(-1, _N)
    names = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    ends = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)].tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield a, b, group[a:b], side[a:b], bool(both[a]), sig[a:b], int(band[a]), names[a:b]


def _best_pairs(least: int):
    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        for a, b, group, side, both, sig, _, _ in _cells(table):
            i, j = _best(_likely(group, side, both, sig, least), b - a)
            x, y = node[a:b][i], node[a:b][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _by_cell(solve)


def _still_likely(least: int):
    """The rows of cells that have a likely partner in another group."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(table.num_rows, bool)
        for a, _, *cell in _cells(table):
            for i, j, _ in _likely(*cell[:4], least, *cell[4:]):
                keep[a + i] = keep[a + j] = True
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return _by_cell(solve)


def _forest(least: int, share: float):
    """Compares all likely pairs of cells by their sets, and gives a spanning forest of the groups that are joined."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = table.column("set").combine_chunks()
        for a, b, group, side, both, sig, band, names in _cells(table):
            own: dict[int, np.ndarray] = {}
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            def of(i: int) -> np.ndarray:
                if i not in own:
                    own[i] = np.frombuffer(sets[a + i].as_buffer(), np.uint64)
                return own[i]

            edges = []
            for i, j, equal in _likely(group, side, both, sig, least, band, names):
                for k in np.argsort(-equal, kind="stable").tolist():
                    x, y = root(int(group[i[k]])), root(int(group[j[k]]))
                    if x != y and alike(of(int(i[k])), of(int(j[k])), share):
                        parent[max(x, y)] = min(x, y)
                        edges.append((max(x, y), min(x, y)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return _by_cell(solve)


def alike(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two sets, as sorted distinct numbers, have at least this Jaccard similarity."""
    least, most = sorted((len(x), len(y)))
    if least < share * most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= share * (len(x) + len(y) - both) - 1e-9


def _confirm(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                keep.append(alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share))  # without a copy
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], names=["a", "b"])

    return run


def join_alike(texts: DataFrame, groups: DataFrame, sets_of, *, share: float = 0.8, cell: int = 2_048) -> DataFrame:
    """node and group of every text, after groups with alike texts are joined.

    ``texts`` has distinct node (long), bands and sig; ``groups`` node and group (long), for every node. ``sets_of`` takes
    a table of nodes and gives node and set: the shingles as sorted distinct numbers of 64 bits.
    """
    least = least_equal(share)

    def cells(groups: DataFrame) -> DataFrame:
        """The members of buckets that hold several groups, in cells; large buckets are split in pairs of parts."""
        named = texts.join(groups, "node").select("node", "group", F.explode("bands").alias("band"))
        mixed = named.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
        # signatures go only to what is left: most texts share no bucket with another group
        dealt = materialize(named.join(mixed, "band")).join(texts.select("node", "sig", "bands"), "node")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        name = F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other"))
        side = F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).cast("int")
        dealt = dealt.select(name.alias("cell"), "node", "group", "sig", "band", "bands", side.alias("side"), (F.col("mine") != F.col("other")).alias("two"))
        return dealt.repartition("cell").sortWithinPartitions("cell")

    def joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
        roots = components(edges).toDF("group", "root")
        return materialize(groups.join(roots, "group", "left").select("node", F.coalesce("root", "group").alias("group")))

    pairs = materialize(cells(groups).mapInArrow(giving_back(_best_pairs(least)), "a long, b long").distinct())
    sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found = full.select("a", "b", "x", "y").mapInArrow(giving_back(_confirm(share)), "a long, b long")
    edges = found.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    groups = joined(groups, materialize(edges))

    members = cells(groups)
    left = materialize(members.mapInArrow(giving_back(_still_likely(least)), members.schema))
    sets = sets_of(left.select("node").distinct())
    again = left.join(sets, "node").select(*left.columns, "set").repartition("cell").sortWithinPartitions("cell")
    return joined(groups, materialize(again.mapInArrow(giving_back(_forest(least, share)), "a long, b long")))
