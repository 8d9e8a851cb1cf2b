"""Suffix-array de-duplication: bytes covered by a long string that also starts earlier are removed.

Equal windows of ``length`` bytes are found in four steps, none of which holds more than a block of bytes or ``hot`` runs:

1. Every window is filed under its anchor, the q-gram in it with the least bucket identifier, so equal windows meet in
   the anchor's bucket. Windows in a row with the same anchor form one run, and identical runs of a batch are
   combined before the shuffle. Anchors that are frequent in a sample of the documents are dealt by kind of run too;
   the sample decides where a run goes, never what is found.
2. In a bucket, all but the first of identical runs are covered as a whole. Buckets with one run are done.
3. Of the others, one run of each kind gets its bytes back from the documents and goes to its bucket once more.
4. Bucket-pointer refinement sorts a bucket's suffixes: the first buckets are refined by sorting on the pointers of
   later offsets, again and again, up to ``length`` bytes. Of the windows that stay together, the first one stays.

A bucket of more than ``hot`` kinds of runs would meet in one task. Its windows go one by one instead, by 128 bits of
identifiers of all their bytes; equal windows of a batch are combined before that shuffle, and step 2 settles them.
Runs are told apart by 128 bits, those of their anchor and those of all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, id_of, key_of, lists, materialize, numbers, text_of
from .suffix_core import BLOCK, U, anchors, digests, mix, refine

_RUNS = "copied boolean, h long, sig long, key long, var long, at long"
_FOUND = "copied boolean, h long, key long, var long, lo long, hi long, p long"
_CONTEXTS = "h long, key long, var long, lo long, n int, first int, bytes binary"
_SPANS = "key long, var long, lo long, hi long"
#: Buckets with many runs up to which they are broadcast; beyond, the runs are shuffled to them.
BROADCAST_BUCKETS = 200_000
#: Rows of a bucket task that are refined at once, if their buckets allow it.
_ROWS = 4_000
#: Windows of hot buckets that are combined at once.
_WINDOWS = 1 << 18
#: Documents whose anchors tell which ones are frequent, about; and kinds of runs in them from which an anchor is.
_SAMPLE, _FREQUENT = 4_000, 8


def _merged(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of intervals that touch or overlap, for each owner."""
    if not len(owner):
        return owner, lo, hi
    o = np.lexsort((lo, owner))
    owner, lo, hi = owner[o], lo[o], hi[o]
    base = owner.astype(np.int64) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(base + hi)
    new = np.r_[True, base[1:] + lo[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(owner) - 1]
    return owner[at], lo[at], (reach - base)[last]


def _blocks(texts: list[memoryview | bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, start, end) of about BLOCK bytes; longer documents come in pieces that share length-1 bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        start, n = 0, len(text)
        while n - start >= length:
            end = min(n, start + BLOCK)
            if group and size + end - start > BLOCK:
                yield group
                group, size = [], 0
            group.append((i, start, end))
            size += end - start
            start = end if end == n else end - length + 1
    if group:
        yield group


def _runs_of(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, var = numbers(batch, "key", "var")
            order = np.lexsort((var, key))
            texts, key, var = batch.column("bytes").to_pylist(), key[order], var[order]
            texts = [texts[i] for i in order]
            parts = []
            for group in _blocks(texts, length):
                buf = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in group]), np.uint8)
                who, begin, end = (np.array(x, np.int64) for x in zip(*group, strict=True))
                stop = np.cumsum(end - begin)
                start = stop - (end - begin)
                d, h, sig, p, lo, hi = anchors(buf, start, stop, q, length)
                parts.append((who[d], h, sig, p + (back := (begin - start)[d]), lo + back, hi + back))
            if not parts:
                continue
            d, h, sig, p, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield _combined(key[d], var[d], h, sig, p, lo, hi, length)

    return run


def _combined(key: np.ndarray, var: np.ndarray, h: np.ndarray, sig: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of a batch in order of document and place: the first of each kind, and the spans that all others cover."""
    doc = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (var[1:] != var[:-1])]) - 1
    first_of = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    o = np.argsort(mix(h ^ (sig << U(1))), kind="stable")
    same = np.r_[False, (h[o][1:] == h[o][:-1]) & (sig[o][1:] == sig[o][:-1])]
    first = o[np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))]
    again = np.zeros(len(o), bool)
    again[o] = same
    moved = np.zeros(len(o), bool)
    moved[o] = same & ((doc[first] != doc[o]) | (p[first] != p[o]))
    who, a, b = _merged(doc[moved], lo[moved], hi[moved] + length)
    who = first_of[who] if len(who) else who
    left = np.flatnonzero(~again)
    at = p[left] << 14 | (p - lo)[left] << 7 | (p - hi)[left]
    spread = mix(key[who].astype(U) ^ var[who].astype(U)).view(np.int64)
    columns = (np.r_[np.ones(len(who), bool), np.zeros(len(left), bool)], np.r_[spread, h[left].view(np.int64)], np.r_[a, sig[left].view(np.int64)], np.r_[key[who], key[left]], np.r_[var[who], var[left]], np.r_[b, at])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["copied", "h", "sig", "key", "var", "at"])


def _buckets_of(length: int):
    """Reads runs sorted by bucket; gives the covered spans, and one run of each kind where a bucket has several.

    A bucket that is dealt to several tasks (``dealt``) counts as one with several kinds.
    """

    def out(copied, *columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (copied, *columns)], names=["copied", "h", "key", "var", "lo", "hi", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, kind, first document and place of that kind, whether dealt, whether its kind was given out
        for batch in batches:
            copied, h, sig, key, var, at, dealt = numbers(batch, "copied", "h", "sig", "key", "var", "at", "dealt")
            done = np.flatnonzero(copied)
            if len(done):
                yield out(copied[done], h[done], key[done], var[done], sig[done], at[done], sig[done])
            rest = np.flatnonzero(~copied)
            if not len(rest):
                continue
            h, sig, key, var, at, dealt = (x[rest] for x in (h, sig, key, var, at, dealt))
            held = last is not None
            if held:
                h, sig, key, var, at, dealt = (np.r_[x, y] for x, y in zip(last[:6], (h, sig, key, var, at, dealt), strict=True))
            bucket = np.r_[True, h[1:] != h[:-1]]
            kind = bucket | np.r_[True, sig[1:] != sig[:-1]]
            b = np.cumsum(bucket) - 1
            many = (np.bincount(b, kind)[b] > 1) | dealt
            if held and last[6]:
                many[b == 0] = True
            rep = kind & many
            if held and last[6]:
                rep[0] = False
            first = np.maximum.accumulate(np.where(kind, np.arange(len(h)), 0))
            moved = ~kind & ((key != key[first]) | (var != var[first]) | (at >> 14 != at[first] >> 14))
            p = at >> 14
            lo, hi = p - (at >> 7 & 127), p - (at & 127)
            take = np.flatnonzero(moved | rep)
            if len(take):
                yield out(moved[take], h[take], key[take], var[take], lo[take], np.where(moved[take], hi[take] + length, hi[take]), p[take])
            end = first[-1]
            last = (*(x[end : end + 1] for x in (h, sig, key, var, at, dealt)), bool(many[end]))

    return run


def _contexts_of(length: int):
    """Cuts the bytes of the wanted runs out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, var, text, runs in zip(*(batch.column(n).to_pylist() for n in ("key", "var", "bytes", "runs")), strict=True):
                rows += [(r["h"], key, var, r["lo"], r["hi"] - r["lo"] + 1, r["p"] - r["lo"], text[r["lo"] : r["hi"] + length]) for r in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["h", "key", "var", "lo", "n", "first", "bytes"])

    return run


def _windows_of(length: int):
    """The windows of runs one by one, as runs of a single window whose anchor are all its bytes."""

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        key, var, d1, d2, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _combined(key, var, d1, d2, p, p, p, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, var = numbers(batch, "key", "var")
            texts, runs = batch.column("bytes"), batch.column("runs").to_pylist()
            parts, held = [], 0
            for i in np.lexsort((var, key)).tolist():
                text = np.frombuffer(texts[i].as_buffer(), np.uint8)
                _, lo, hi = _merged(np.zeros(len(runs[i]), np.int64), np.array([r["lo"] for r in runs[i]]), np.array([r["hi"] for r in runs[i]]) + 1)
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    for c in range(a, b, BLOCK):
                        n = min(b, c + BLOCK) - c
                        parts.append((np.full(n, key[i]), np.full(n, var[i]), *digests(text[c : c + n + length - 1], length), np.arange(c, c + n)))
                        held += n
                        if held >= _WINDOWS:
                            yield combined(parts)
                            parts, held = [], 0
            if parts:
                yield combined(parts)

    return run


def _spans_of(length: int):
    """Refines whole buckets of contexts, sorted by bucket, and gives the covered spans."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        h, key, var, lo, n, first = (table.column(x).to_numpy() for x in ("h", "key", "var", "lo", "n", "first"))
        data = table.column("bytes").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        buf = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]]
        begin = at[:-1] - at[0]
        _, group = np.unique(h, return_inverse=True)
        o = np.lexsort((lo, var, key))
        rank = np.zeros(len(o), np.int64)
        same = np.r_[False, (key[o][1:] == key[o][:-1]) & (var[o][1:] == var[o][:-1])]
        base = np.cumsum(~same) - 1
        rank[o] = base
        # windows of one document keep their order by position: the rank is document, then context start
        spread = int(lo.max()) + 256 if len(lo) else 1
        ctx, nth, _ = refine(buf, begin, first.astype(np.int64), n.astype(np.int64), group, rank * spread + lo, length)
        who, a, b = _merged(ctx, lo[ctx] + nth, lo[ctx] + nth + length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[who], var[who], a, b)], names=["key", "var", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < _ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield solve(table.slice(0, cut).combine_chunks())
                waiting = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
        if rows:
            yield solve(pa.Table.from_batches(waiting).combine_chunks())

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("bytes").to_pylist(), batch.column("covered")
        flat = spans.flatten()
        counts = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
        who, a, b = _merged(np.repeat(np.arange(len(texts)), counts), flat.field("lo").to_numpy(), flat.field("hi").to_numpy())
        kept, edge = [], np.searchsorted(who, np.arange(len(texts) + 1))
        for i, text in enumerate(texts):
            if edge[i] == edge[i + 1]:
                kept.append(text)
                continue
            starts, ends = a[edge[i] : edge[i + 1]].tolist(), b[edge[i] : edge[i + 1]].tolist()
            kept.append(b"".join([text[x:y] for x, y in zip([0, *ends], [*starts, len(text)], strict=True)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([len(t) for t in texts], pa.int64()), lists(pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]), np.diff(edge)), pa.array(kept, pa.binary())],
            names=["key", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, *, length: int = 100, q: int = 32, hot: int = 2_000) -> DataFrame:
    """Removes every byte that lies in a ``length``-byte string which also starts earlier.

    Earlier is a smaller doc_id, or the same document at an earlier start; strings may overlap, never cross documents,
    and are judged on the input. Texts are taken as UTF-8 bytes.

    Parameters
    ----------
    docs : columns doc_id (integer) and text; others are ignored, whatever their names.
    length : bytes of a string that counts, 65 to 128.
    q : bytes of an anchor, a power of two of at most ``length`` / 2.
    hot : kinds of runs of one bucket beyond which its windows are dealt one by one.

    Returns
    -------
    doc_id, n_bytes long, spans array<struct<start,end>> (maximal removed runs), kept binary; a row for each row of ``docs``.

    A null text is empty; a text shorter than ``length`` stays whole. A null doc_id counts as the smallest. Rows that
    repeat doc_id and text are one document and get the same result each; different texts of one doc_id, or of none, are
    documents of their own, in the order of two hashes of the text. An empty table gives an empty result.
    """
    if not 65 <= length <= 128 or q & (q - 1) or not 8 <= q <= length // 2:
        raise ValueError("length must be 65 to 128, q a power of two from 8 to length / 2")
    keyed = _documents(docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes")))
    runs = keyed.mapInArrow(_runs_of(length, q), _RUNS)
    share = min(1.0, _SAMPLE / max(1, docs.count()))
    some = keyed.sample(share, seed=7) if share < 1 else keyed
    frequent = materialize(some.mapInArrow(_runs_of(length, q), _RUNS).where("NOT copied").groupBy("h").count().where(F.col("count") >= _FREQUENT).select("h", F.lit(True).alias("dealt")))
    runs = runs.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_BUCKETS else frequent, "h", "left").withColumn("dealt", F.coalesce("dealt", F.lit(False)))
    dealt = runs.repartition("h", F.when(F.col("dealt"), F.col("sig")).otherwise(0))
    found = materialize(dealt.sortWithinPartitions("copied", "h", "sig", "key", "var", "at").mapInArrow(_buckets_of(length), _FOUND))
    wanted = found.where("NOT copied")
    heavy = materialize(wanted.groupBy("h").count().where(F.col("count") > hot).select("h"))
    side = F.broadcast(heavy) if heavy.count() <= BROADCAST_BUCKETS else heavy
    per_doc = lambda df: keyed.join(df.groupBy("key", "var").agg(F.collect_list(F.struct("h", "lo", "hi", "p")).alias("runs")), ["key", "var"])
    contexts = per_doc(wanted.join(side, "h", "left_anti")).mapInArrow(_contexts_of(length), _CONTEXTS)
    refined = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_spans_of(length), _SPANS)
    spans = found.where("copied").select("key", "var", "lo", "hi").unionByName(refined)
    if heavy.count():
        windows = per_doc(wanted.join(side, "h", "left_semi")).mapInArrow(_windows_of(length), _RUNS).withColumn("dealt", F.lit(False))
        settled = windows.repartition("h", "sig").sortWithinPartitions("copied", "h", "sig", "key", "var", "at").mapInArrow(_buckets_of(length), _FOUND)
        spans = spans.unionByName(settled.where("copied").select("key", "var", "lo", "hi"))
    covered = spans.groupBy("key", "var").agg(F.collect_list(F.struct("lo", "hi")).alias("covered"))
    cut = keyed.join(covered, ["key", "var"], "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    result = cut.select("key", "bytes", "covered").mapInArrow(_cut, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return result.select(id_of().alias("doc_id"), "n_bytes", "spans", "kept")


def _documents(rows: DataFrame) -> DataFrame:
    """``rows`` (key, bytes) with var, a number that tells texts of one key apart, in order; zero for a key that stands alone."""
    again = materialize(rows.groupBy("key").count().where("count > 1").select("key"))
    if not again.count():
        return rows.select("key", F.lit(0).cast("long").alias("var"), "bytes")
    side = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    hashed = rows.withColumn("x", F.xxhash64("bytes")).withColumn("y", F.xxhash64(F.lit(1), "bytes"))
    names = hashed.join(side, "key", "left_semi").select("key", "x", "y").distinct()
    # numbers go up with (key, x, y): partitions are ranges, and the id holds the partition, then the row
    names = names.repartitionByRange("key", "x", "y").sortWithinPartitions("key", "x", "y")
    names = materialize(names.withColumn("var", F.monotonically_increasing_id() + 1))
    few = names.count() <= BROADCAST_KEYS
    return hashed.join(F.broadcast(names) if few else names, ["key", "x", "y"], "left").select("key", F.coalesce("var", F.lit(0).cast("long")).alias("var"), "bytes")
