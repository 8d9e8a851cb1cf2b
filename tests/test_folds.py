"""Order-dependent operators against plain loops."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import greedy, intervals
from millrace.operators.ranking import greedy_next, stratified_sample
from millrace.operators.series import numbered
from millrace.operators.tracking import stable_choice
from millrace.plans import interval_queries
from millrace.plans.catalog import QUERIES


def _intervals(spark, sf, kind):
    groups = defaultdict(list)
    for r in interval_queries.intervals(spark, sf).where(F.col("event_type") == kind).collect():
        groups[r.user_id].append(r)
    return groups


def test_suppression(spark, sf):
    want = {}
    for user, rows in _intervals(spark, sf, "view").items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.value, r.event_id)):
            if len(kept) < 8 and all(max(0, min(r.e, k.e) - max(r.s, k.s)) <= 0.45 * min(r.e - r.s, k.e - k.s) for k in kept):
                kept.append(r)
        want[user] = ",".join(str(k.event_id) for k in kept)
    got = {r.user_id: r.kept for r in QUERIES["nms_overlap"](spark, sf).collect()}
    assert got == want


def test_duplicates(spark, sf):
    want = {}
    for rows in _intervals(spark, sf, "purchase").values():
        kept = []
        for r in sorted(rows, key=lambda r: r.event_id):
            dup = None
            for k in kept:
                both = max(0, min(r.e, k.e) - max(r.s, k.s))
                if r.event_id % 2 == k.event_id % 2 and both / (r.e - r.s + k.e - k.s - both) >= 0.5:
                    dup = k.event_id
                    break
            want[r.event_id] = dup
            if dup is None:
                kept.append(r)
    assert {r.event_id: r.duplicate_of for r in QUERIES["dup_mark_iou"](spark, sf).collect()} == want


def test_peaks(spark, sf):
    got = {r.vec_id: r.peaks for r in QUERIES["peak_decode"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        kept = []
        for _, i in sorted((-v, i) for i, v in enumerate(r.embedding)):
            if len(kept) < 3 and all(abs(i - k) > 3 for k in kept):
                kept.append(i)
        assert got[r.vec_id] == ",".join(map(str, kept))


def test_stable_choice(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 5.0), (1, 0, 2, 1.0, 1.0, 9.0), (1, 1, 3, 0.1, 0.0, 99.0), (1, 1, 4, 1.1, 1.0, 1.0), (1, 2, 5, 9.0, 9.0, 1.0), (1, 2, 6, 8.0, 9.0, 2.0), (2, 0, 7, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, f long, k long, x double, y double, size double")
    assert sorted((r.g, r.f, r.k) for r in stable_choice(df, "g", "f", "k", "x", "y", "size", 0.5).collect()) == [(1, 0, 2), (1, 1, 4), (1, 2, 6), (2, 0, 7)]
    assert stable_choice(df.limit(0), "g", "f", "k", "x", "y", "size", 0.5).count() == 0


def test_greedy_picks(spark):
    df = spark.createDataFrame([([(1, 10, "a"), (2, 11, "a"), (3, 12, None), (4, 13, "b")],)], "items array<struct<seq:long,id:long,drill:string>>")
    assert df.select(greedy_next(F.col("items"), 2).alias("ids")).first().ids == [10, 12]
    times = spark.createDataFrame([(1, t, t % 3) for t in (0, 5, 10, 14, 30, 41)] + [(None, 3, 0)], "g long, t long, m long")
    assert sorted((r.g or 0, r.t) for r in greedy.spaced(times, ["g"], [F.asc("t")], "t", 10).collect()) == [(0, 3), (1, 0), (1, 10), (1, 30), (1, 41)]
    assert sorted(r.t for r in greedy.spaced(times.where("g = 1"), ["g"], [F.desc("t")], "t", 10, "m").collect()) == [10, 30, 41]
    assert greedy.spaced(times.limit(0), ["g"], [F.asc("t")], "t", 10).count() == 0


def test_non_overlapping_in_any_order(spark):
    r = random.Random(3)
    rows = [(g, i, s := r.randrange(500), s + r.choice((0, 1, 5, 40)), r.randrange(9)) for g in range(3) for i in range(120)]
    want = []
    for g in range(3):
        kept = []
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[4], x[2], x[1])):
            if all(x[2] >= y[3] or x[3] <= y[2] for y in kept):
                kept.append(x)
        want += [(g, x[1], n) for n, x in enumerate(kept, 1)]
    df = spark.createDataFrame(rows, "g long, id long, s long, e long, c long")
    got = greedy.non_overlapping(df, ["g"], [F.desc("c"), F.asc("s"), F.asc("id")], "s", "e")
    assert sorted((x.g, x.id, x.place) for x in got.collect()) == sorted(want)
    marked = greedy.mark_duplicates(df, ["g"], [F.asc("id")], "id", "s", "e", 0.4).collect()
    for g in range(3):
        kept = []
        for x in [x for x in rows if x[0] == g]:
            hit = [y for y in kept if (b := max(0, min(x[3], y[3]) - max(x[2], y[2]))) and b / (x[3] - x[2] + y[3] - y[2] - b) >= 0.4]
            assert next(m.duplicate_of for m in marked if (m.g, m.id) == x[:2]) == (hit[0][1] if hit else -1)
            if not hit:
                kept.append(x)


def test_places_and_shares_in_parts(spark):
    r = random.Random(5)
    rows = [(g, r.randrange(1000) if g else 7, i) for g in (0, 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, t long, id long")
    got = {(x.g, x.id): (x["__n"], x["__of"]) for x in numbered(df, ["g"], ["t", "id"], rows_per_part=20).collect()}
    for g in (0, 1, None):
        order = sorted((t, i) for k, t, i in rows if k == g)
        assert all(got[g, i] == (n, 300) for n, (_, i) in enumerate(order))
    sample = {(x.g, x.id) for x in stratified_sample(df, ["g"], F.col("id")).collect()}
    first = sorted(range(300), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())[:60]
    assert sample == {(g, i) for g in (0, 1, None) for i in first}


def test_near_pairs(spark):
    r = random.Random(8)
    points = [(h, k, r.random() * 2 - 1, r.random() * 2 - 1) for h in range(2) for k in range(60)]
    got = {(x.h, x.a.key, x.b.key) for x in intervals.near_pairs(spark.createDataFrame(points, "h long, k long, x double, y double"), ["h"], "k", "x", "y", 0.18, 0.38).collect()}
    assert got == {(a[0], a[1], b[1]) for a in points for b in points if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 0.18 and abs(a[3] - b[3]) <= 0.38}
