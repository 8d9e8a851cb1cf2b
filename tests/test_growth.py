"""Queries whose memory or order of rows went wrong on larger tables."""

import random
import re
from collections import Counter as bag

import duckdb
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from millrace.operators import intervals, joins, rally, validation
from millrace.plans.catalog import ORACLE_SQL, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_boxes_are_not_broadcast(spark, sf):
    assert "Broadcast" not in plan(QUERIES["contact_candidates"](spark, sf))


def test_samples_of_pairs_are_not_broadcast(spark):
    samples = spark.range(40).selectExpr("id % 2 AS court", "id % 8 AS track", "id div 8 AS t", "id / 40 AS x", "id / 50 AS y")
    pairs = spark.range(6).selectExpr("id % 2 AS court", "id AS a", "id + 2 AS b")
    found = rally.pair_conflicts(samples, pairs, ["court"], "a", "b")
    text = plan(found)
    # the two joins with samples; what they find, a row for each pair, may be broadcast
    assert text.count("SortMergeJoin [court") >= 2 and sum(r.shared for r in found.collect()) == 30


def test_mean_at_the_cut(spark, tmp_path):
    """The mean of doubles added one by one falls short of a cut that their mean reaches."""
    short = [[81.81, 82.78, 64.44, 96.5, 5.65, 78.68, 10.14], [29.61, 15.0, 90.28, 41.82, 5.31, 110.28, 127.7], [86.4, 27.54, 107.58, 44.71, 33.77], [13.39, 43.7, 59.78, 48.42, 92.47, 87.53, 74.71]]
    groups = {**dict(enumerate(short)), 10: [45.05, 44.95], 11: [45.0, 44.99], 12: [float("inf"), 1.0], 13: [None]}
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, 'click', ?)", [(u, v) for u, values in groups.items() for v in values])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = QUERIES["confidence_band"](spark, str(tmp_path))
    assert {r.user_id: r.band for r in df.collect()} == {u: {10: "medium", 11: "low", 13: "low"}.get(u, "high") for u in groups}
    assert rows_of(df) == rows_of_sql(connect(tmp_path), ORACLE_SQL["confidence_band"], df.columns)


def test_equally_late_reviews(spark):
    base = spark.createDataFrame([(k, "P") for k in range(200)], "k int, v string")
    reviews = spark.createDataFrame([(k, v, 3) for k in range(199) for v in (("F", "O") if k % 2 else ("O", "F"))] + [(0, "X", 2)], "k int, v string, n int")
    assert {(r.k, r.v) for r in joins.override(base, reviews, ["k"], "v", "n").collect()} == {(k, "O") for k in range(199)} | {(199, "P")}


def test_join_by_any_key_holds_no_pairs(spark):
    left = spark.createDataFrame([(1, 5, 7), (1, 6, 7), (2, 5, None), (2, 5, None), (3, None, 8), (4, 6, 9), (None, 5, 7)], "l int, a int, b int")
    right = spark.createDataFrame([(10, 5, 7), (10, 6, 7), (11, 6, 9), (12, None, 8), (12, 4, 8), (13, 3, None)], "r int, x long, y int")
    got = joins.join_any(left, right, [("a", "x"), ("b", "y")], ("l", "r"))
    assert bag(map(tuple, got.collect())) == bag([(1, 10), (1, 11), (2, 10), (3, 12), (4, 10), (4, 11), (None, 10)])
    # pairs leave the joins as they are: nothing is grouped above them
    assert not re.search(r"Aggregate.*\n(.*\n)*.*Union", got._jdf.queryExecution().optimizedPlan().toString())


def test_near_points_are_not_broadcast(spark):
    r = random.Random(3)
    points = [(h, k, r.randrange(-60, 60) / 20, r.randrange(-60, 60) / 20) for h in (1, 2) for k in range(150)] + [(1, 5, 0.1, 0.1), (1, None, 0.1, 0.1)]
    df = spark.createDataFrame(points, "h int, k int, x double, y double")
    got = intervals.near_pairs(df, ["h"], "k", "x", "y", 0.15, 0.25)
    want = [(p, q) for p in points for q in points if p[0] == q[0] and None not in (p[1], q[1]) and p[1] < q[1] and abs(p[2] - q[2]) <= 0.15 and abs(p[3] - q[3]) <= 0.25]
    assert bag(((x.h, *x.a), (x.h, *x.b)) for x in got.collect()) == bag(want) and len(want) > 100
    few = spark.range(50).selectExpr("id % 2 AS h", "id AS k", "id / 50 AS x", "id / 60 AS y")
    assert "Broadcast" not in plan(intervals.near_pairs(few, ["h"], "k", "x", "y", 0.15, 0.25))


def test_near_points_of_many_parts(spark, monkeypatch):
    """Parts, pieces and tasks change neither pairs nor their number; points that have no place or key are in none."""
    for name, n in (("_PART", 24), ("_PIECE", 4), ("_PARTS", 3)):
        monkeypatch.setattr(intervals, name, n, raising=False)
    r, inf = random.Random(4), float("inf")
    points = [(h, k, r.randrange(-9, 9) / 20, r.randrange(-9, 9) / 10) for h in (1, 2, None) for k in range(-200, 200)]
    points += [(1, k, x, y) for k in (600, 601) for x, y in ((1e300, 0.1), (-1e300, 1e18), (1e20, -1e300))]
    points += [(1, 2**62, 0.1, 0.1), (1, -(2**62) - 2**61, 0.1, 0.1), (2, 7, 0.1, 0.1), (2, 7, 0.1, 0.1)]
    points += [(2, k, x, y) for k in (500, 501, None) for x, y in ((inf, 0.1), (-inf, -inf), (float("nan"), 0.1), (None, 0.1), (0.1, None))]
    got = intervals.near_pairs(spark.createDataFrame(points, "h int, k long, x double, y double"), ["h"], "k", "x", "y", 0.15, 0.4)
    sound = [p for p in points if None not in p and abs(p[2]) < inf and abs(p[3]) < inf]
    want = bag((p, q) for p in sound for q in sound if p[0] == q[0] and p[1] < q[1] and abs(p[2] - q[2]) <= 0.15 and abs(p[3] - q[3]) <= 0.4)
    assert bag(((x.h, *x.a), (x.h, *x.b)) for x in got.collect()) == want and sum(want.values()) > 10_000


def test_near_pairs_take_little_space(spark, tmp_path, monkeypatch):
    """There are far more pairs than points: files hold them in less than half a byte each, as lists of points come again."""
    monkeypatch.setattr(intervals, "_PART", 512, raising=False)
    r = random.Random(9)
    spots = [(r.random() * 0.35, r.random() * 0.75) for _ in range(90)]
    points = [(1, i * 7, *spots[r.randrange(90)]) for i in range(3000)]
    pairs = intervals.near_pairs(spark.createDataFrame(points, "h int, k long, x double, y double"), ["h"], "k", "x", "y", 0.18, 0.38)
    pairs.select("h", "a.key", F.col("b.key").alias("other")).write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert rows > 2_000_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.45 * rows


def test_keyframes_without_a_table_of_names(spark):
    packages = spark.createDataFrame([(k, 0.0, 10.0, 10.0) for k in range(6)] + [(7, None, 10.0, 10.0)], "k int, start double, end double, duration double")
    frames = [(0, f"n{i}", float(i)) for i in range(7)] + [(1, f"n{i % 6}", float(i)) for i in range(7)] + [(2, f"n{i}" if i else None, float(i)) for i in range(7)]
    frames += [(3, f"n{i}", i + 4.5) for i in range(7)] + [(4, f"n{i}", None if i else -1.0) for i in range(7)] + [(7, f"n{i}", i + 4.5) for i in range(7)] + [(9, "n", 1.0)]
    got = validation.keyframe_checks(packages, spark.createDataFrame(frames, "k int, name string, at double"), "k")
    want = [(1, "keyframe_names"), (2, "keyframe_names"), (3, "outside_window"), (4, "outside_window"), (5, "keyframe_count"), (7, "outside_window"), (7, "duration")]
    assert bag(map(tuple, got.collect())) == bag(want)
    assert "Aggregate" not in plan(got)


def test_words_are_encoded_without_collections():
    """No search for cycles runs inside a batch of documents, and it is allowed again behind it."""
    import gc

    import pyarrow as pa

    from millrace.llm import bpe

    seen = []
    texts = [f"word{i} again {i * 7} é".encode() for i in range(3000)]
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts, pa.binary())], names=["key", "bytes"])
        out = [b.num_rows for b in bpe._digest(bpe.default_path(), False)(iter([batch.slice(0, 1)]))]
        seen.clear()
        out += [b.num_rows for b in bpe._digest(bpe.default_path(), False)(iter([batch]))]
    finally:
        gc.callbacks.pop()
    assert out == [1, 3000] and len(seen) < 20 and gc.isenabled()


def words_of_documents(n: int, each: int, long: int = 0):
    import pyarrow as pa

    texts = [" ".join(f"Wo{i * each + k}rd{'é' * (k % 3)}" for k in range(each)).encode() + b" again and" * long for i in range(n)]
    return texts, pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.binary())], names=["key", "bytes"])


def test_no_calls_for_each_word():
    """Words go through the transducer side by side, in arrays; what Python does grows with documents and letters of a word."""
    import cProfile

    from millrace.llm import bpe

    _, batch = words_of_documents(20, 1000)
    run = bpe._digest(bpe.default_path(), False)
    assert [b.num_rows for b in run(iter([batch.slice(0, 1)]))] == [1]
    profile = cProfile.Profile()
    assert profile.runcall(lambda: sum(b.num_rows for b in run(iter([batch])))) == 20
    assert sum(e.callcount for e in profile.getstats()) < 20_000


def test_ids_of_a_batch_come_in_groups():
    """A worker does not hold the ids of all documents of a batch at once; they are those of each word alone."""
    from millrace.llm import bpe, bpe_core

    texts, batch = words_of_documents(6, 300, 150_000)
    out = [*bpe._digest(bpe.default_path(), True)(iter([batch]))]
    assert len(out) > 1 and [k for b in out for k in b.column("key").to_pylist()] == [*range(6)]
    own = bpe_core.WordBpe(bpe.default_path())
    again = own.ids("again") + own.ids("and")
    for text, ids in zip(texts, (x for b in out for x in b.column("ids")), strict=True):
        first = [i for w in text.split(b" again", 1)[0].split() for i in own.ids(w.decode())]
        assert ids.as_py() == first + again * 150_000
