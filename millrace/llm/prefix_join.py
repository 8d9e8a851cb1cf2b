"""Similarity join of documents by their sets of word n-grams, with a grouped prefix join.

A set is kept as sorted 64-bit numbers of its shingles. All sets are read in one order of shingles: by the logarithm of
the number of documents that hold them, then by number, so that what a document has to itself stands first. Two sets of a Jaccard similarity of at least ``share`` hold a common shingle among the first
n - ceil(share * n) + 1 of each, its prefix. Documents of identical prefix and size are one group and join as one: groups
meet in the buckets of their prefix shingles, pairs of groups are filtered by size and by the place of the shingle in
both, and only what is left is expanded to members, whose whole sets are compared.

Only connected components are asked for, so pairs are never listed. A first step proposes few pairs for each group: the
next member of its own group, and the neighbour in order of size that it meets in most buckets. This joins most of a
cluster. Then buckets that still hold several components are looked at as a whole: a task compares the members of
different components that pass the filters, and gives a spanning forest of what it has joined. A pair that is left out
lies in one component already, so the result is exact.

Document frequencies are counted over all shingles, and kept in a table of ``_SLOTS`` bytes by a part of the shingle's
number: of the shingles of a slot that are in several documents, the largest logarithm. Any such table is a valid order,
so that what shares a slot changes costs, never results, and what is broadcast has one size for all corpora.

Hot keys: copies are one class before anything else. Counts are combined in each task, so that a shingle of all documents
is one entry of a task. Frequent shingles stand last and so in few prefixes. Buckets beyond ``cell`` members are split,
and each pair of parts is a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alike import _by_cell
from .common import BROADCAST_KEYS, each, id_of, key_of, lists, materialize, release, text_of
from .components import components

#: Bytes of the table of frequencies, and of the pieces that it is merged in.
_SLOTS, _PIECE = 2**24, 2**16
#: Shingles of a part of their numbers that is counted in memory, and of a task that are combined at once.
_PART = 1_000_000
#: Parts that a task counts one after the other, and the most tasks that count.
_PARTS, _TASKS = 4, 20_000
_TILE, _WORDS = 256, 100_000
_draw = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, 66, np.uint64) | np.uint64(1)


class _Numbers(dict):
    """Numbers of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


_numbers = _Numbers()


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted numbers; of fewer words the whole sequence is the only one."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_numbers.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    # sequences of different lengths have numbers of their own
    x = np.full(len(w) - k + 1, _draw[64] + np.uint64(k), np.uint64)
    for j in range(k):
        x += w[j : len(w) - k + 1 + j] * _draw[j % 64]
        x = (x ^ (x >> np.uint64(31))) * _draw[65]
    return np.unique(x ^ (x >> np.uint64(29)))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Places in the table of frequencies: bits of a number that follow the first ``bits``, which name the part."""
    return (shingles >> np.uint64(32 - bits) & np.uint64(_SLOTS - 1)).astype(np.int64)


def prefix(shingles: np.ndarray, percent: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The first shingles of a set in the order of all: by the table's logarithm, then by number."""
    order = np.argsort(table[slots(shingles, bits)], kind="stable")
    return shingles[order[: prefix_length(len(shingles), percent)]]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection of two sets is at least ``percent`` times their union."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                found = [shingle_set(t, words) for t in each(part.column("bytes"))]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in found), np.int64).reshape(-1, 2)
                arrays = [part.column("key"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "c1", "c2", "n", "set"])
        _numbers.clear()
        release()

    return run


def _as_set(value: Any) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)  # without a copy


def _counted(bits: int):
    """Of every part of the numbers, the numbers' next 32 bits and how often they occur, combined by ``_PART`` shingles."""

    def pack(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, n = np.unique(np.concatenate(sets), return_counts=True)
        part = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
        rest, n = (x >> np.uint64(32 - bits)).astype(np.uint32), n.astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = [*starts[1:].tolist(), len(x)]
        for k in range(0, len(starts), 10_000):
            some = [*zip(starts[k : k + 10_000].tolist(), ends[k : k + 10_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts[k : k + 10_000]]), *(pa.array([v[a:b].tobytes() for a, b in some], pa.binary()) for v in (rest, n))], names=["cell", "rest", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting, size = [], 0
        for batch in batches:
            for s in batch.column("set"):
                waiting.append(np.frombuffer(s.as_py(), np.uint64))
                size += len(waiting[-1])
                if size >= _PART:
                    yield from pack(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from pack(waiting)
        waiting = []
        release()

    return run


def _pieces(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(table.reshape(-1, _PIECE).any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([table[k * _PIECE : (k + 1) * _PIECE].tobytes() for k in some.tolist()], pa.binary())], names=["piece", "bytes"])


def _logarithms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of the table, from whole parts in order."""
    release()
    table = np.zeros(_SLOTS, np.uint8)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = rows.column("cell").to_numpy()
        ends = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)].tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            rest, times = (np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column(c).slice(a, b - a)]) for c in ("rest", "times"))
            o = np.argsort(rest, kind="stable")
            rest, times = rest[o], times[o].astype(np.int64)
            first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
            n = np.add.reduceat(times, first)
            many = n > 1
            np.maximum.at(table, (rest[first[many]] & np.uint32(_SLOTS - 1)).astype(np.int64), np.ceil(np.log2(n[many])).astype(np.uint8))
        return iter(())

    yield from _by_cell(solve)(batches)
    yield from _pieces(table)
    del table
    release()


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    table = np.zeros(_SLOTS, np.uint8)
    for batch in batches:
        for k, piece in zip(batch.column("piece").to_pylist(), batch.column("bytes"), strict=True):
            own = table[k * _PIECE : (k + 1) * _PIECE]
            np.maximum(own, np.frombuffer(piece.as_buffer(), np.uint8), out=own)
    yield from _pieces(table)


def frequencies(sets: DataFrame, bits: int) -> np.ndarray:
    """The table of frequencies of all shingles. Parts by the first ``bits`` bits of their numbers are counted apart."""
    tasks = min(_TASKS, max(1, (1 << bits) // _PARTS))  # so that a batch holds a few parts, not all that a task may be given
    counted = sets.select("set").mapInArrow(_counted(bits), "cell long, rest binary, times binary").repartition(tasks, "cell").sortWithinPartitions("cell")
    pieces = counted.mapInArrow(_logarithms, "piece long, bytes binary").repartition("piece").mapInArrow(_merge_pieces, "piece long, bytes binary")
    table = np.zeros(_SLOTS, np.uint8)
    for r in pieces.toLocalIterator():
        table[r.piece * _PIECE : (r.piece + 1) * _PIECE] = np.frombuffer(r.bytes, np.uint8)
    return table


def _prefixes(percent: int, order: Any, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = order.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [prefix(_as_set(s), percent, table, bits) for s in part.column("set")]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in found), np.int64).reshape(-1, 2)
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists(flat, np.array([len(p) for p in found], np.int64))], names=["node", "n", "p1", "p2", "prefix"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(_as_set(x), _as_set(y), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], names=["a", "b"])

    return run


def _open_pairs(root: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, both: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's members of different components that size and place of the shingle allow to be linked, tile by tile."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if both else left
    for x in range(0, len(left), _TILE):
        a = left[x : x + _TILE, None]
        for y in range(0 if both else x, len(right), _TILE):
            b = right[None, y : y + _TILE]
            rest = 1 + np.minimum(n[a] - 1 - pos[a], n[b] - 1 - pos[b])  # what both can share from this shingle on
            open_ = (root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((100 + percent) * rest >= percent * (n[a] + n[b]))
            i, j = np.nonzero(open_)
            i, j = a[i, 0], b[0, j]
            if not both:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _cells(table: pa.Table) -> Iterator[tuple[int, int, tuple]]:
    cell, root, n, pos, side = (table.column(c).to_numpy() for c in ("cell", "root", "n", "pos", "side"))
    two = table.column("two").to_numpy(zero_copy_only=False)
    ends = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)].tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield a, b, (root[a:b], n[a:b], pos[a:b], side[a:b], bool(two[a]))


def _still_open(percent: int):
    """The rows of cells that may be linked to a member of another component."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(table.num_rows, bool)
        for a, _, cell in _cells(table):
            for i, j in _open_pairs(*cell, percent):
                keep[a + i] = keep[a + j] = True
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return _by_cell(solve)


def _first_shared(percent: int):
    """Of rows with their prefixes those that have an open pair whose first common shingle is that of the cell.

    A pair that may be linked is open where its first common shingle is, so it stays there and goes everywhere else.
    """

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(table.num_rows, bool)
        prefixes, pos = table.column("prefix").combine_chunks(), table.column("pos").to_numpy()
        for a, _, cell in _cells(table):
            before: dict[int, set[int]] = {}

            def earlier(k: int, a: int = a, before: dict[int, set[int]] = before) -> set[int]:
                if k not in before:
                    before[k] = set(prefixes[a + k].values[: int(pos[a + k])].to_numpy().tolist())
                return before[k]

            for i, j in _open_pairs(*cell, percent):
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    if not (keep[a + p] and keep[a + q]) and earlier(p).isdisjoint(earlier(q)):
                        keep[a + p] = keep[a + q] = True
        yield from table.drop_columns(["prefix"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return _by_cell(solve)


def _forest(percent: int):
    """Compares the open pairs of cells by their sets, and gives a spanning forest of the components that are joined."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = table.column("set").combine_chunks()
        for a, _, cell in _cells(table):
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            edges = []
            for i, j in _open_pairs(*cell, percent):
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = top(int(cell[0][p])), top(int(cell[0][q]))
                    if x != y and linked(_as_set(sets[a + p]), _as_set(sets[a + q]), percent):
                        up[max(x, y)] = min(x, y)
                        edges.append((max(x, y), min(x, y)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return _by_cell(solve)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _proposed(members: DataFrame, named: DataFrame, percent: int, cell: int) -> DataFrame:
    """Pairs of nodes to begin with: neighbours within a group, and of each group the neighbour that it meets most often."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / cell))
    mates = members.where("size > 1").withColumn("part", part).select("node", F.lag("node").over(Window.partitionBy("gid", "part").orderBy("node")).alias("b"))
    spread = named.withColumn("part", F.pmod(F.xxhash64("gid"), F.ceil(F.col("rows") / cell)))
    order = Window.partitionBy("token", "part").orderBy("n", "gid")
    met = spread.select("gid", "n", F.lag("gid").over(order).alias("b"), F.lag("n").over(order).alias("m")).where(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n"))
    best = met.groupBy("gid", "b").agg(F.count("*").alias("times")).groupBy("gid").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    return mates.where("b IS NOT NULL").select(F.col("node").alias("a"), "b").unionByName(best.select(F.col("gid").alias("a"), "b"))


def _left(members: DataFrame, named: DataFrame, roots: DataFrame, cell: int) -> DataFrame:
    """The members of buckets that hold several components, in cells; large buckets are split in pairs of parts."""
    known = materialize(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_group = known.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    # a group is a bucket too: its members share the whole prefix
    own = by_group.where("lo <> hi").select(F.xxhash64(F.lit("group"), "gid").alias("token"), "gid", F.lit(0).cast("long").alias("pos"), "lo", "hi", "size")
    shared = named.select("token", "gid", "pos").join(by_group, "gid").select("token", "gid", "pos", "lo", "hi", "size")
    buckets = materialize(shared.unionByName(own))
    mixed = buckets.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("rows")).where("lo <> hi").select("token", F.ceil(F.col("rows") / cell).cast("int").alias("parts"))
    dealt = buckets.select("token", "gid", "pos").join(mixed, "token").join(known.select("gid", "node", "root", "n"), "gid")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).cast("int")
    cells = dealt.select(name.alias("cell"), "node", "root", "n", "pos", side.alias("side"), (F.col("mine") != F.col("other")).alias("two"))
    return cells.repartition("cell").sortWithinPartitions("cell")


def ngram_jaccard(docs: DataFrame, *, words: int = 4, percent: int = 85, cell: int = 2_048) -> DataFrame:
    """doc_id, n_shingles (distinct) and component_id, the smallest doc_id that links reach, for each row of ``docs``.

    Texts are lower-cased in A-Z and split at ASCII white space. A document's set has its distinct shingles of ``words``
    words; of fewer words the whole sequence is the only one; without words it is empty and linked with nothing. Two sets
    are linked when 100 times their intersection is at least ``percent`` times their union.

    A null text has no words. A null doc_id counts as the smallest, so that its component's component_id is null. Rows
    that repeat a doc_id get a row each, by their own texts. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes"))
    found = materialize(rows.mapInArrow(_sets(words), "key long, c1 long, c2 long, n long, set binary").withColumn("node", F.monotonically_increasing_id()))
    classes = materialize(found.where("n > 0").groupBy("c1", "c2").agg(F.min("node").alias("node"), F.min("key").alias("rep"), F.first("n").alias("n")))
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = classes.select("node")
    sets = found.join(F.broadcast(first) if n <= BROADCAST_KEYS else first, "node", "left_semi").select("node", "n", "set")
    sets = sets if n <= BROADCAST_KEYS else materialize(sets)

    bits = min(31, (int(total) // _PART).bit_length())
    order = sets.sparkSession.sparkContext.broadcast(frequencies(sets, bits))
    fronts = materialize(sets.mapInArrow(_prefixes(percent, order, bits), "node long, n long, p1 long, p2 long, prefix array<long>"))
    counts = materialize(fronts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"))
    groups = fronts.groupBy("p1", "p2", "n").agg(F.min("node").alias("gid"), F.count("*").alias("size"))
    members = materialize(fronts.select("node", "n", "p1", "p2").join(groups, ["p1", "p2", "n"]).select("node", "n", "gid", "size"))
    leaders = members.where("node = gid").select("node")
    front = fronts.join(_small(leaders), "node", "left_semi").select(F.col("node").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    named = materialize(front.join(_small(counts), "token").select("token", "gid", "n", F.col("pos").cast("long").alias("pos"), "rows"))

    pairs = materialize(_proposed(members, named, percent, cell))
    wanted = materialize(sets.join(_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi").select("node", "set"))
    full = pairs.join(wanted.toDF("a", "x"), "a").join(wanted.toDF("b", "y"), "b")
    edges = materialize(full.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))
    roots = components(edges)

    cells = _left(members, named, roots, cell)
    left = materialize(cells.mapInArrow(_still_open(percent), cells.schema))
    prefixed = fronts.select("node", "prefix").join(_small(left), "node").select(*left.columns, "prefix")
    left = materialize(prefixed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_first_shared(percent), left.schema))
    again = sets.select("node", "set").join(_small(left), "node").select(*left.columns, "set").repartition("cell").sortWithinPartitions("cell")
    more = materialize(again.mapInArrow(_forest(percent), "a long, b long"))

    final = components(edges.unionByName(more))
    reached = classes.join(final, "node", "left").select("c1", "c2", "rep", F.coalesce("root", "node").alias("root"))
    least = reached.groupBy("root").agg(F.min("rep").alias("least"))
    reached = materialize(reached.join(least, "root").select("c1", "c2", "least"))
    out = found.select("key", "c1", "c2", "n").join(_small(reached), ["c1", "c2"], "left")
    out = out.withColumn("component", F.coalesce("least", "key"))
    return out.select(id_of().alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component").alias("component_id"))


#: The same in SQL: all pairs that share a shingle.
SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) USING (doc_id)"""
