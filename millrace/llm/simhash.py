"""SimHash near-duplicates: fingerprints within a few bits, found by exact comparison of tiles.

Documents with one fingerprint are combined first. Fingerprints that differ in at most ``radius`` bits agree in some of
their groups of bits, and meet in a cell named by these. The cells of a task lie side by side, each sorted by population
count, and are cut into tiles; tiles that share a cell are compared by exclusive-or and bit counts, and pairs of tiles
whose population counts lie beyond the radius are skipped. Cells with more than ``cell`` members are split, and every
pair of parts is compared in a task of its own. A task gives a spanning forest of its links, not all pairs, and
components are then joined across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import bands, join_alike, minima, signature
from .common import BROADCAST_KEYS, each, giving_back, hash_of, id_of, key_of, lists, materialize, release, text_of, without
from .components import components

SEED = 42
#: Fingerprints of a tile, and pairs of tiles that are compared at once.
_TILE, _PAIRS = 256, 16
#: Bits of each value of a byte.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMNS = np.arange(8) * 256


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed number: zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    x = np.array(hashes, np.uint64)
    counts = np.bincount((x.view(np.uint8).reshape(-1, 8) + _COLUMNS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(x), bitorder="little").view(np.int64)[0])


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """The digests, 16 bytes each, of a text's shingles; of fewer words one."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 16), np.uint8)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[min(shingle, len(words)) - 1 :])]), np.uint8).reshape(-1, 16)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([fingerprint(t, shingle) for t in each(batch.column("bytes"))], pa.int64())], names=["key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """key (doc_id, or the smallest long for null) and fp of every document."""
    return docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes")).mapInArrow(_fingerprints(shingle), "key long, fp long")


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i[k] and j[k]; the smallest member stays each set's parent."""
    while len(i):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def tile_pairs(cell: np.ndarray, ones: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of tiles, of rows sorted by cell and population count, that may hold a link; and how many others share a cell."""
    first = np.arange(0, len(cell), _TILE)
    last = np.minimum(first + _TILE, len(cell)) - 1
    x, y = [np.arange(len(first))], [np.arange(len(first))]
    at, d, skipped = np.arange(len(first)), 0, 0
    while len(at):
        d += 1
        at = at[at + d < len(first)]
        at = at[cell[first[at + d]] == cell[last[at]]]
        # within the cell they share, the first tile ends with its largest count and the second begins with its smallest
        near = ones[first[at + d]] - ones[last[at]] <= radius
        skipped += int((~near).sum())
        at = at[near]
        x.append(at)
        y.append(at + d)
    return np.concatenate(x), np.concatenate(y), skipped


def _linked(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, both: np.ndarray, ones: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one cell whose fingerprints are near, tile by tile; of a pair of parts, rows of different parts."""
    x, y, _ = tile_pairs(cell, ones, radius)
    within, n = np.arange(_TILE), len(fp)
    for k in range(0, len(x), _PAIRS):
        a, b = x[k : k + _PAIRS, None] * _TILE + within, y[k : k + _PAIRS, None] * _TILE + within
        near = np.bitwise_count(fp[np.minimum(a, n - 1)][:, :, None] ^ fp[np.minimum(b, n - 1)][:, None, :]) <= radius
        t, i, j = np.nonzero(near)
        i, j = a[t, i], b[t, j]
        keep = (i < j) & (j < n)
        i, j = i[keep], j[keep]
        keep = (cell[i] == cell[j]) & (~both[i] | (side[i] != side[j]))
        yield i[keep], j[keep]


def _forest(radius: int):
    def solve(table: pa.Table) -> pa.RecordBatch:
        cell, fp, rep, side = (table.column(n).to_numpy() for n in ("cell", "fp", "rep", "side"))
        both = table.column("two").to_numpy(zero_copy_only=False)
        fp = fp.view(np.uint64)
        ones = np.bitwise_count(fp).astype(np.int64)
        o = np.lexsort((ones, cell))
        cell, fp, rep, side, both, ones = (x[o] for x in (cell, fp, rep, side, both, ones))
        parent = np.arange(len(cell))
        for i, j in _linked(fp, cell, side, both, ones, radius):
            _unite(parent, i, j)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[parent[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if waiting[0].column("cell")[0] == batch.column("cell")[-1]:
                continue  # still the first cell, of ``cell`` members or two parts at most
            table = pa.Table.from_batches(waiting)
            cell = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            yield solve(table.slice(0, cut).combine_chunks())
            waiting = table.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield solve(pa.Table.from_batches(waiting).combine_chunks())

    return run


def links(classes: DataFrame, radius: int = 3, *, cell: int = 16_384) -> DataFrame:
    """A spanning forest of the links between fingerprints: rows a, b of their representatives.

    ``classes`` has distinct fp and their rep. Of b groups of bits, fingerprints within the radius agree in at least
    b - radius, so each goes to a cell for every choice of that many groups. b is the least number beyond the radius for
    which cells have about ``cell`` members; a larger cell is split. Exact always.
    """
    rows, b = classes.count(), radius + 1
    while b < 16 and rows > cell << (64 // b) * (b - radius):
        b += 1
    width = 64 // b
    part = [F.shiftrightunsigned("fp", g * width).bitwiseAND(F.lit(2 ** (64 - g * width if g == b - 1 else width) - 1).cast("long")) for g in range(b)]
    homes = F.array(*[F.xxhash64(F.lit(n), *[part[g] for g in chosen]) for n, chosen in enumerate(combinations(range(b), b - radius))])
    dealt = classes.select("fp", "rep", F.explode(homes).alias("home"))
    large = dealt.groupBy("home").count().where(F.col("count") > cell).select("home", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    dealt = dealt.join(large, "home", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("home", F.least("mine", "other"), F.greatest("mine", "other"))
    cells = dealt.select(name.alias("cell"), "fp", "rep", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).cast("int").alias("side"), (F.col("mine") != F.col("other")).alias("two"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(giving_back(_forest(radius)), "a long, b long")


def simhash_groups(docs: DataFrame, *, shingle: int = 3, radius: int = 3, cell: int = 16_384) -> DataFrame:
    """Fingerprint and group of every document.

    Texts are lower-cased in A-Z and split at ASCII white space; shingles of ``shingle`` words count as often as they
    occur; fewer words are one shingle, none give fingerprint zero. A fingerprint's bit is 1 if more than half of the
    shingles' XXH64 (seed 42) have it. Fingerprints of at most ``radius`` different bits are linked.

    Returns doc_id, fingerprint (long) and component_id, the smallest doc_id that links reach, for each row of ``docs``.
    A null text has no words. A null doc_id counts as the smallest, so that its group's component_id is null. Rows that
    repeat a doc_id get a row each. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle))
    classes = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")))
    groups = components(links(classes, radius, cell=cell))
    roots = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    return prints.select("key", "fp").join(roots, "fp").select(id_of().alias("doc_id"), F.col("fp").alias("fingerprint"), id_of("root").alias("component_id"))


def shingle_set(digests: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel())


def _signed(shingle: int, second: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                fp, band, sig = [], [], []
                for text in each(batch.column("bytes")):
                    digests = _shingles(text, second)
                    least = minima(shingle_set(digests))
                    fp.append(fingerprint(text, shingle))
                    band.append(bands(least) if len(digests) else np.zeros(0, np.int64))
                    sig.append(signature(least))
                named = lists(pa.array(np.concatenate([np.zeros(0, np.int64), *band])), np.array([len(b) for b in band], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array(fp, pa.int64()), named, pa.array(sig, pa.binary())], names=["key", "node", "fp", "bands", "sig"])

    return run


def _sets(second: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [shingle_set(_shingles(t.as_py(), second)).tobytes() for t in part.column("bytes")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    return run


def near_dedup(docs: DataFrame, *, shingle: int = 3, radius: int = 3, second: int = 5, alike: float = 0.8, cell: int = 16_384) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id, with all columns of ``docs``.

    Two texts belong together if their fingerprints are linked as in ``simhash_groups``, or if their sets of shingles of
    ``second`` words have a Jaccard similarity of at least ``alike``, whatever their fingerprints are; and so do the groups
    of two such texts.

    Rows are told apart by doc_id and text. Of a group's rows with the smallest doc_id (null is smallest) the one with the
    smallest hash of its text stays; rows that repeat both stay together. A null text has no words, and texts without
    words are one group. An empty table gives an empty result.
    """
    rows = docs.select(key_of().alias("key"), hash_of().alias("node"), text_of().cast("binary").alias("bytes"))
    prints = materialize(rows.mapInArrow(giving_back(_signed(shingle, second)), "key long, node long, fp long, bands array<long>, sig binary"))
    texts = materialize(prints.groupBy("node").agg(F.min("key").alias("key"), *[F.any_value(c).alias(c) for c in ("fp", "bands", "sig")]))
    classes = materialize(texts.groupBy("fp").agg(F.min(F.struct("key", "node")).alias("m")).select("fp", F.col("m.node").alias("rep")))
    linked = components(links(classes, radius, cell=cell)).withColumnRenamed("node", "rep")
    roots = classes.join(linked, "rep", "left").select("fp", F.coalesce("root", "rep").alias("group"))
    groups = materialize(texts.select("node", "fp").join(roots, "fp").select("node", "group"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        side = F.broadcast(nodes) if nodes.count() <= BROADCAST_KEYS else nodes
        wanted = rows.select("node", "bytes").join(side, "node", "left_semi").dropDuplicates(["node"])
        return wanted.select("node", "bytes").mapInArrow(giving_back(_sets(second)), "node long, set binary")

    groups = join_alike(texts.select("node", "bands", "sig"), groups, sets_of, share=alike)
    first = prints.select("key", "node").join(groups, "node").groupBy("group").agg(F.min(F.struct("key", "node")).alias("first"), F.count("*").alias("rows"))
    first = materialize(first.where("rows > 1").drop("rows"))
    first = F.broadcast(first) if first.count() <= BROADCAST_KEYS else first
    gone = prints.select("key", "node").join(groups, "node").join(first, "group").where("key <> first.key OR node <> first.node")
    return without(docs, gone.select("key", "node"))
