"""Ranked search, clustering and the n-gram join against plain versions, with nulls, ties, repeats, hot groups and parts."""

import collections
import hashlib
import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_join, ranked_search, vafile
from millrace.llm import queries as Q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(items):
    return sorted(items, key=str)


def ranks(docs, items, top=20):
    """docs, items: (id, text); (item_id, rank, doc_id, score) by the formula."""
    terms = lambda t: TERM.findall(brute.lower(t or ""))
    counts = [(i, collections.Counter(w), len(w)) for i, t in docs for w in [terms(t)]]
    n, total = sum(c > 0 for _, _, c in counts), sum(c for _, _, c in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, t in items:
        q, rows = terms(t), []
        for i, c, size in counts:
            score = 0
            for term in q:
                if tf := c[term]:
                    m = 75 + 25 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                rows.append((-score, -math.inf if i is None else i, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(rows, key=lambda r: r[:2])[:top], 1)]
    return bag(out)


def searched(df):
    return bag((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [1, 8_192])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "ITEMS", block)
    monkeypatch.setattr(ranked_search, "_CELLS", 40)
    r = random.Random(3)
    word = lambda: r.choice(["Ab", "ab", "AB", "é", "É", "x1", "日本", "zz", "q", "common"])
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 12))) + " common") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\t-!\x00"), (None, "ab x1 common"), (None, "ab x1 common"), (7, "ab x1 common"), (103, "long " * 50_000 + "ab"), (104, "ab-x1_common\x7fé q")]
    items = [(1, "ab AB x1"), (2, None), (3, " - "), (None, "é 日本"), (1, "common common zz"), (4, "absent words"), (5, "É q")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit(2)).withColumn("item_id", F.lit(3)).repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit(2))
    assert searched(ranked_search.ranked_search(a, b)) == ranks(docs, items)
    assert searched(ranked_search.ranked_search(a, b, top=3)) == ranks(docs, items, 3)
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.where("doc_id IN (100, 101)"), b)):
        assert ranked_search.ranked_search(x, y).count() == 0


def test_search_ties(spark):
    """Copies beyond the bound: equal scores go by ascending doc_id, whatever task has them."""
    docs = [(i, "same words here") for i in range(300)] + [(1000, "same")]
    got = searched(ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "words")], "item_id long, text string")))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [*range(20)]


def test_search_sf(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    assert searched(Q.op11_ranked_search(spark, sf)) == ranks(read("documents", "doc_id"), read("benchmark", "item_id"))


def clusters(rows, k=16, rounds=3, dim=64, scale=64):
    """rows: (id, vector); (id, cluster, distance) and the centroids, all distances looked at."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return bag((i, n, d) for i, v in kept for d, n in [near(v)]), centroids


def test_clusters(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in g.normal(i % 7, 1 + i % 3, 64)]) for i in range(200)]
    rows += [(None, rows[0][1]), (3, rows[9][1]), (3, rows[3][1]), (300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 63 + [None]), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [1e6] + [0.0] * 63), (307, [-1e5] * 64)]
    rows += [(400 + i, [0.5] * 64) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(1)).withColumn("v", F.lit("x")).repartition(6)
    found = vafile.cluster_vectors(df)
    want, centroids = clusters(rows)
    got = found.collect()
    assert bag((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert all(r.centroid == centroids[r.cluster] for r in got)
    sums = collections.Counter()
    for _, n, d in want:
        sums[n] += d
    assert all((r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values())) for r in vafile.with_inertia(found).collect())
    assert vafile.cluster_vectors(df.limit(0)).count() == 0 and vafile.cluster_vectors(df.where("vec_id BETWEEN 300 AND 305")).count() == 0
    few = vafile.cluster_vectors(df.where("vec_id IN (5, 6, 7)")).collect()
    assert bag((r.vec_id, r.cluster, r.distance) for r in few) == clusters([r for r in rows if r[0] in (5, 6, 7)])[0]
    odd = [(i, [float(x) for x in g.integers(-9, 9, 5)]) for i in range(40)]
    got = vafile.cluster_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), k=4, rounds=2, dim=5, scale=3).collect()
    assert bag((r.vec_id, r.cluster, r.distance) for r in got) == clusters(odd, 4, 2, 5, 3)[0]


def test_clusters_beyond_the_range(spark):
    """Components are held to 2^26; sums that no long can hold are null."""
    rows = [(i, [(-1.0) ** i * 1e30] * 64) for i in range(400)] + [(900, [0.0] * 64)]
    found = vafile.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=1, rounds=0)
    got = vafile.with_inertia(found).collect()
    assert {r.distance for r in got} <= {0, 64 * 2**52, 64 * 2**54} and all(r.inertia is None for r in got)


def test_intervals_skip_vectors():
    """Every distance lies in its interval, and rows with one centroid left are settled without their vector."""
    g = np.random.default_rng(2)
    centroids = g.integers(-60, 60, (16, 64))
    v = np.concatenate([centroids[g.integers(0, 16, 500)] + g.integers(-12, 13, (500, 64)), g.integers(-70, 70, (100, 64))])
    low, high = v.min(0), v.max(0)
    borders = np.ceil(v.mean(0)[:, None] + np.linspace(-7 / 3, 7 / 3, 15) * v.std(0)[:, None]).astype(np.int64)
    cells, (least, most) = vafile.pack(v, borders), vafile.tables(centroids, borders, low, high)
    away = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    lo = sum(least[k][cells[:, k]] for k in range(cells.shape[1]))
    hi = sum(most[k][cells[:, k]] for k in range(cells.shape[1]))
    assert (lo <= away).all() and (away <= hi).all()
    asked = []
    found, fetched = vafile.nearest(cells, lambda rows: asked.append(rows) or v[rows], centroids, least, most)
    assert (found == away.argmin(1)).all() and fetched.sum() == len(asked[0]) < 300


def jaccard(rows, words=4, percent=85):
    """rows: (key, text) of distinct keys; number of shingles and the smallest key that links reach. All pairs are looked at."""
    sets = {}
    for i, t in rows:
        w = brute.WORD.findall(brute.lower(t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(seed, n, words, changes, base=None):
    """Copies of a text with a few words changed."""
    r = random.Random(seed)
    base = base or [f"b{seed}x{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for place in r.sample(range(len(w)), r.randint(0, changes)):
            w[place] = f"q{seed}x{i}x{place}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("part", "cell"), [(1_000_000, 2_048), (2_000, 4)])
def test_join(spark, monkeypatch, part, cell):
    """Families with links and chains, passages that all share, short texts; with parts of numbers and split buckets too."""
    monkeypatch.setattr(prefix_join, "_PART", part)
    passage = [f"p{k}" for k in range(60)]
    texts = family(1, 60, 150, 3) + family(2, 40, 80, 4) + family(3, 25, 300, 12)
    texts += [" ".join([*passage, *(f"own{i}x{k}" for k in range(i % 25))]) for i in range(70)]
    texts += ["a b c", "A b  c", "a b", "a", "a b c d", "a b c d e", "", "\t", "Ä ß x y", "ä ß x y", "x y " * 400, "x y " * 200]
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[i : i + 120]) for i in range(0, 80, 3)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).withColumn("node", F.lit(2)).repartition(6)
    assert joined(prefix_join.ngram_jaccard(docs, cell=cell)) == jaccard(rows)


def test_join_rows(spark, monkeypatch):
    """Null and repeated ids, copies, null and long texts, empty tables; also with tables too large to broadcast."""
    near = [" ".join(f"n{k}" for k in range(100)), " ".join(f"n{k}" for k in range(99))]
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(5, near[0]), (None, near[1]), (6, near[0]), (6, near[0]), (7, "other words stand in here"), (6, "other words stand in here"), (8, None), (None, None), (9, long), (4, long + " end"), (10, "")]
    want = bag([(5, 97, None), (None, 96, None), (6, 97, None), (6, 97, None), (7, 2, 6), (6, 2, 6), (8, 0, 8), (None, 0, None), (9, 59_997, 4), (4, 59_998, 4), (10, 0, 10)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c1", F.lit(1)).withColumn("root", F.lit("r"))
    for most in (1_000_000, 0):
        monkeypatch.setattr(prefix_join, "BROADCAST_KEYS", most)
        assert bag((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.ngram_jaccard(docs).collect()) == want
    assert prefix_join.ngram_jaccard(docs.limit(0)).count() == 0
    assert bag(tuple(r) for r in prefix_join.ngram_jaccard(docs.where("doc_id IN (8, 10)")).collect()) == [(10, 0, 10), (8, 0, 8)]


def test_join_threshold(spark):
    """Pairs exactly at, and just under, the share."""
    rows = []
    for n in (20, 40, 100, 185):
        for gone in range(1, 40):
            a = [f"t{n}x{gone}x{k}" for k in range(n + 3)]
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a[: max(4, len(a) - gone)]))]
    assert joined(prefix_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))) == jaccard(rows)


def test_join_prefixes(monkeypatch):
    """Sets of enough similarity share a shingle of their prefixes, whatever the table of frequencies holds."""
    monkeypatch.setattr(prefix_join, "_SLOTS", 64)
    g = np.random.default_rng(4)
    for bits in range(300):
        x = np.unique(g.integers(0, 2**63, g.integers(1, 60), np.uint64))
        y = np.unique(np.r_[g.permutation(x)[: g.integers(1, len(x) + 1)], g.integers(0, 2**63, g.integers(0, 6), np.uint64)])
        table = g.integers(0, 4, 64).astype(np.uint8)
        p, q = prefix_join.prefix(x, 85, table, bits % 20), prefix_join.prefix(y, 85, table, bits % 20)
        order = sorted(x, key=lambda t, table=table, bits=bits: (table[prefix_join.slots(np.array([t]), bits % 20)[0]], t))
        assert p.tolist() == order[: prefix_join.prefix_length(len(x), 85)]
        exact = 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
        assert prefix_join.linked(x, y, 85) == exact and (not exact or len(np.intersect1d(p, q)))


def test_join_frequencies(spark):
    """Counts by part and slot are those of all sets, however they are cut."""
    g = np.random.default_rng(6)
    sets = [np.unique(g.choice(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 150)) for _ in range(40)]
    df = spark.createDataFrame([(s.tobytes(),) for s in sets], "set binary").repartition(5)
    for bits in (0, 3, 9):
        u, n = np.unique(np.concatenate(sets), return_counts=True)
        want = np.zeros(prefix_join._SLOTS, np.uint8)
        np.maximum.at(want, prefix_join.slots(u, bits), np.ceil(np.log2(n)).astype(np.uint8))
        assert np.array_equal(prefix_join.frequencies(df, bits), want)
