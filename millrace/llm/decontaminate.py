"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask picks some of the words that follow a position and ignores the others, so that a seed survives a changed word at
an ignored place. Seeds of the benchmark and of the documents are joined, and every hit is verified: document and item
are laid side by side at the hit, and a stretch of ``window`` words must agree but for a share of substitutions.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_of, id_of, key_of, text_of, without

#: The places, after a position, whose words make up a seed.
MASKS = ((0, 1, 2, 4, 6), (0, 1, 3, 6, 7), (0, 2, 3, 5, 8))
#: Words of the benchmark up to which its seeds and words are broadcast; beyond, both sides are shuffled by seed.
BROADCAST_WORDS = 200_000


def _fits(span: int, equal: int) -> bool:
    """Whether, wherever ``span - equal`` words of ``span`` differ, some mask meets equal words alone."""
    return math.comb(span, equal) < 100_000 and all(any(all(at + k in same for k in mask) for mask in MASKS for at in range(span - mask[-1])) for same in map(set, combinations(range(span), equal)))


def masks_of(span: int, agree: float) -> tuple[tuple[int, ...], ...]:
    """The masks that find every ``span`` words of which the share ``agree`` is equal.

    Where the spaced masks would miss some, as in short items, the words in a row that must be equal somewhere: d words
    that differ leave d + 1 stretches.
    """
    equal = math.ceil(agree * span)
    return MASKS if _fits(span, equal) else (tuple(range(math.ceil(equal / (span - equal + 1)))),)


def _words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, position: str, masks: dict[tuple[int, ...], Column]) -> DataFrame:
    """A row for each position and mask that fits, with its seed; w is the array of word hashes. Masks have conditions."""
    least = min((m[-1] for m in masks), default=0)
    at = rows.withColumn(position, F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - least, F.lit(0)))))
    name = lambda m: F.lit(",".join(map(str, m)))
    keys = F.array(*[F.when(on & (F.col(position) + m[-1] < F.size("w")), F.xxhash64(name(m), *[F.get("w", F.col(position) + k) for k in m])) for m, on in masks.items()])
    return at.withColumn("seed", F.explode(keys.cast("array<bigint>"))).where("seed IS NOT NULL")


def _verified(docs: DataFrame, benchmark: DataFrame, window: int, agree: float) -> DataFrame:
    """key and text_hash of every leaking row, the item_id and n_equal; rows of one id and text are one."""
    items = benchmark.select("item_id", hash_of().alias("item_hash"), _words(text_of()).alias("w")).distinct().withColumn("span", F.least(F.lit(window), F.size("w")))
    sizes = items.groupBy("span").agg(F.sum(F.size("w")).alias("words")).where("span > 0").collect()  # a row for each span up to the window
    uses: dict[tuple[int, ...], list[int]] = {}
    for r in sizes:
        for mask in masks_of(r["span"], agree):
            uses.setdefault(mask, []).append(r["span"])
    item_seeds = _seeds(items, "at", {m: F.col("span").isin(spans) for m, spans in uses.items()}).select("seed", "item_id", "item_hash", F.col("at").alias("item_at"))
    words = items.select("item_id", "item_hash", "span", F.col("w").alias("item_w"))
    texts = docs.select(key_of().alias("key"), hash_of().alias("text_hash"), _words(text_of()).alias("w"))
    doc_seeds = _seeds(texts, "at", dict.fromkeys(uses, F.lit(True)))
    row, item = ("key", "text_hash"), ("item_id", "item_hash")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    from_doc, from_item = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    size = F.least(F.size("w") - from_doc, F.size("item_w") - from_item)
    laid = (F.slice("w", from_doc + 1, size).alias("a"), F.slice("item_w", from_item + 1, size).alias("b"), "span")
    of_item = lambda left, right: left["item_id"].eqNullSafe(right["item_id"]) & (left["item_hash"] == right["item_hash"])
    if sum(r["words"] for r in sizes) <= BROADCAST_WORDS:
        # One generated stage: a position's row meets the seeds before the words that it carries are copied anywhere.
        hits = doc_seeds.join(F.broadcast(item_seeds), "seed").select(*row, *item, shift, "w")
        hits = hits.join(F.broadcast(words), of_item(hits, words)).select(*row, *[hits[c] for c in item], "shift", *laid)
        hits = hits.groupBy(*row, *item, "shift").agg(*[F.any_value(c).alias(c) for c in ("a", "b", "span")])
    else:
        pairs = doc_seeds.select(*row, "at", "seed").join(item_seeds, "seed").select(*row, *item, shift).distinct()
        hits = pairs.join(words, of_item(pairs, words)).select(*[pairs[c] for c in (*row, *item, "shift")], "item_w", "span")
        hits = hits.join(texts, [*row]).select(*row, *item, "shift", *laid).distinct()
    flags = F.zip_with("a", "b", lambda a, b: F.when(a == b, 1).otherwise(0))
    hits = hits.select(*row, "item_id", "span", flags.alias("flags"))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("flags") - F.col("span") + 1, F.lit(1))), lambda i: F.aggregate(F.slice("flags", i, F.col("span")), F.lit(0), lambda s, x: s + x))
    best = hits.select(*row, "item_id", "span", F.array_max(sums).cast("long").alias("n_equal"))
    return best.where(F.col("n_equal") >= F.ceil(F.lit(agree) * F.col("span"))).select(*row, "item_id", "n_equal")


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, agree: float = 0.8) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and which.

    Words are lower-cased runs of letters and digits. Where a seed of both agrees, the item is laid over the document;
    it leaks if among some ``window`` words in a row (all words of a shorter item) at least the share ``agree``, rounded
    up, are equal. Every such document is found: for short items, where the spaced masks would miss some, seeds are words
    in a row. Items without words are in no document.

    Returns doc_id, item_id and n_equal (most equal words in a window), a row for each pair. Null texts have no words;
    a null doc_id or item_id stays null; of rows that repeat a doc_id or an item_id every text is searched, and they
    give one row. Other columns are ignored, whatever their names; an empty table on either side gives an empty result.
    """
    found = _verified(docs, benchmark, window, agree).groupBy("key", "item_id").agg(F.max("n_equal").alias("n_equal"))
    return found.select(id_of().alias("doc_id"), "item_id", "n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, agree: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns.

    Of rows with one doc_id, or with none, only those go whose own text holds a passage.
    """
    return without(docs, _verified(docs, benchmark, window, agree).select("key", "text_hash"))


#: Candidates share the words in a row that must be equal, whatever masks the operator has.
SQL = """
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT item_id, w, least(13, len(w)) AS span, CAST(ceil(0.8 * least(13, len(w))) AS INTEGER) AS need FROM i WHERE len(w) > 0),
q AS (SELECT *, CAST(ceil(need / (span - need + 1)) AS INTEGER) AS k FROM n),
ks AS (SELECT DISTINCT k FROM q),
ip AS (SELECT item_id, k, unnest(range(len(w) - k + 1)) AS p, w FROM q),
si AS (SELECT item_id, k, p, w[p + 1 : p + k] AS seed FROM ip),
dp AS (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k),
sd AS (SELECT doc_id, k, p, w[p + 1 : p + k] AS seed FROM dp),
h AS (SELECT DISTINCT doc_id, item_id, sd.p - si.p AS s FROM sd JOIN si ON sd.k = si.k AND sd.seed = si.seed),
a AS (SELECT doc_id, item_id, span, need, greatest(s, 0) AS fd, greatest(-s, 0) AS fi,
             least(len(d.w) - greatest(s, 0), len(q.w) - greatest(-s, 0)) AS n, d.w AS dw, q.w AS iw
      FROM h JOIN d USING (doc_id) JOIN q USING (item_id)),
f AS (SELECT doc_id, item_id, span, need, list_transform(range(n), lambda k: CASE WHEN dw[fd + k + 1] = iw[fi + k + 1] THEN 1 ELSE 0 END) AS flags FROM a),
b AS (SELECT doc_id, item_id, need, list_max(list_transform(range(greatest(len(flags) - span + 1, 1)), lambda k: list_sum(flags[k + 1 : k + span]))) AS n FROM f)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_equal FROM b WHERE n >= need GROUP BY ALL
"""
