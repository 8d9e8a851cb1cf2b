"""Ranked lexical search, reversed: items wait in an inverted index, documents stream through it.

The queries are few and the corpus is large, so the index is built over the items' terms and broadcast, in blocks of at
most ``POSTINGS`` postings and ``ITEMS`` items. Two passes read the corpus for a block. The first sums the counts that
weights need: documents and terms over all of it, and documents by term of the index. The second takes the term counts of
one document after the other through the index, adds up the scores of the items that share a term with it, and offers
those that may still enter to the item's heap, which holds ``top`` documents. A task hands on its heaps, at most ``top``
rows an item, and heaps of tasks are merged in two steps, so that no task gets more than a part of them.

Scores are integers: they do not depend on the order in which documents or terms are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each, id_of, key_of, text_of

#: Postings and items of a block of the index: what is broadcast at once.
POSTINGS, ITEMS = 1_000_000, 8_192
#: Cells of the table of documents by items that is filled at once.
_CELLS = 2_000_000
#: Parts that the tasks' heaps are merged in before the last merge.
_PARTS = 64
#: ASCII characters that are not letters or digits part terms; capital letters are lowered.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.translate(_TABLE).split()


class Index:
    """The items' terms, numbered, and for each term its items and how often they hold it."""

    def __init__(self, items: list[tuple[int, Counter]]):
        self.items = [n for n, _ in items]
        by: dict[bytes, list[tuple[int, int]]] = {}
        for at, (_, counts) in enumerate(items):
            for term, n in counts.items():
                by.setdefault(term, []).append((at, n))
        self.terms = {t: k for k, t in enumerate(sorted(by))}
        lists = [by[t] for t in self.terms]
        self.starts = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        self.at = np.array([a for x in lists for a, _ in x], np.int64)
        self.times = np.array([n for x in lists for _, n in x], np.int64)

    def found(self, text: bytes) -> tuple[list[int], list[int], int]:
        """Numbers and counts of the index terms in a text, and the number of all its terms."""
        words = terms(text)
        counts = Counter(map(self.terms.get, words))
        counts.pop(None, 0)
        return list(counts), list(counts.values()), len(words)


def _count(index: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        df, docs, total = np.zeros(len(own.terms), np.int64), 0, 0
        for batch in batches:
            for text in each(batch.column("bytes")):
                numbers, _, n = own.found(text)
                df[numbers] += 1
                docs += n > 0
                total += n
        some = np.flatnonzero(df)
        # the totals have numbers of their own, below those of the terms
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some], pa.int32()), pa.array(np.r_[docs, total, df[some]], pa.int64())], names=["term", "n"])

    return run


def _offer(heap: list[tuple[int, int]], top: int, score: int, doc: int) -> None:
    """Heaps have the row that goes first at their root: the lowest score, of equals the largest doc_id."""
    if len(heap) < top:
        heapq.heappush(heap, (score, -doc))
    elif (score, -doc) > heap[0]:
        heapq.heapreplace(heap, (score, -doc))


def _score(index: Any, weights: np.ndarray, docs: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in own.items]
        least = np.ones(len(heaps), np.int64)  # scores below cannot enter
        most = max(1, _CELLS // len(heaps))

        def settle(keys: list[int], rows: list[tuple[list[int], list[int], int]]) -> None:
            sizes = [len(numbers) for numbers, _, _ in rows]
            doc = np.repeat(np.arange(len(rows)), sizes)
            term = np.array([t for numbers, _, _ in rows for t in numbers], np.int64)
            tf = np.array([n for _, counts, _ in rows for n in counts], np.int64)
            m = np.array([75 + 25 * n * docs // total for _, _, n in rows], np.int64)[doc]
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            width = own.starts[term + 1] - own.starts[term]
            posting = np.repeat(own.starts[term] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            scores = np.zeros(len(rows) * len(heaps), np.int64)
            np.add.at(scores, np.repeat(doc, width) * len(heaps) + own.at[posting], np.repeat(gain, width) * own.times[posting])
            scores = scores.reshape(len(rows), -1)
            for d, item in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
                _offer(heaps[item], top, int(scores[d, item]), keys[d])
                if len(heaps[item]) == top:
                    least[item] = heaps[item][0][0]

        for batch in batches:
            keys, rows, size = [], [], 0
            for key, text in zip(each(batch.column("key")), each(batch.column("bytes")), strict=True):
                row = own.found(text)
                if row[0]:
                    keys.append(key)
                    rows.append(row)
                    size += len(row[0])
                if len(rows) >= most or size >= 50_000:
                    settle(keys, rows)
                    keys, rows, size = [], [], 0
            if rows:
                settle(keys, rows)
        found = [(own.items[at], score, -doc) for at, heap in enumerate(heaps) for score, doc in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["item", "score", "key"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, Any, Counter]]]:
    """The items in blocks of a bounded size: number, item_id, term counts. Items without terms are left out."""
    block, postings = [], 0
    rows = items.select("item_id", text_of().cast("binary").alias("bytes")).orderBy(F.asc_nulls_first("item_id"), "bytes")
    for number, r in enumerate(rows.toLocalIterator()):
        counts = Counter(terms(bytes(r.bytes)))
        if not counts:
            continue
        block.append((number, r.item_id, counts))
        postings += len(counts)
        if postings >= POSTINGS or len(block) >= ITEMS:
            yield block
            block, postings = [], 0
    if block:
        yield block


def _merged(heaps: DataFrame, top: int) -> DataFrame:
    """The best rows of every item: of each part of the tasks' heaps first, then of what the parts keep."""
    order = [F.desc("score"), F.asc("key")]
    parts = heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, *, top: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` documents with the highest scores above 0 for each item.

    Terms are the maximal runs of characters that are no ASCII control, blank or punctuation character; only A-Z are
    lowered. N counts the documents with a term, L all terms of all documents, df the documents that hold a term, tf its
    occurrences in one. A term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms scores
    weight * (10^9 tf div (1000 tf + 12 m)) for each term of the item, repeats included, with m = 75 + 25nN div L.
    Equal scores go by ascending doc_id, null before all.

    A null or empty text has no terms: such an item has no rows, such a document is in none. Rows that repeat a doc_id are
    documents of their own, rows that repeat an item_id are items of their own and each have their ranks. An empty table
    on either side gives an empty result; other columns are ignored. Items are read in blocks, so any number may be given.
    """
    spark = docs.sparkSession
    rows = docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        own = Index([(number, counts) for number, _, counts in block])
        index = spark.sparkContext.broadcast(own)
        counts = {r.term: r.n for r in rows.select("bytes").mapInArrow(_count(index), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counts.get(-2, 0), counts.get(-1, 0)
        if not n:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(own.terms))], np.int64)
        heaps = rows.mapInArrow(_score(index, weights, n, total, top), "item long, score long, key long")
        names = spark.createDataFrame([(number, item_id) for number, item_id, _ in block], "item long, item_id long")
        best = _merged(heaps, top).join(F.broadcast(names), "item")
        found = found.unionByName(best.select("item_id", "rank", id_of().alias("doc_id"), "score"))
    return found


#: The same in SQL.
SQL = """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS gain FROM t JOIN n USING (doc_id) JOIN w USING (term), a),
s AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN g USING (term) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
