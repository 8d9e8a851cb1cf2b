"""Job streams over several batches, tracks and contacts, nested documents, peaks, and frameworks in blocks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import holds
from millrace.operators import documents, geometry, rally, ranking, rules
from millrace.streaming import jobs, lifecycle

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
HOUR = 3_600_000


def bag(items):
    return sorted(items, key=str)


def folder_stream(spark, tmp_path, schema, batches):
    """A stream that reads one file, in order, per batch."""
    src = tmp_path / "in"
    for n, rows in enumerate(batches):
        path = str(tmp_path / f"part{n}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        src.mkdir(exist_ok=True)
        found = next(p for p in (tmp_path / f"part{n}").iterdir() if p.suffix == ".parquet")
        found.rename(src / f"{n:03}.parquet")
        # the source takes older files first
        import os

        os.utime(src / f"{n:03}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def run(spark, stream, tmp_path):
    with lifecycle.rocksdb(spark):
        return jobs.run_to_end(stream, str(tmp_path / "run"))


SCHEMA = "job string, seq long, ts timestamp, request string, target string, asked int"


def lives(spark, tmp_path, batches, ttl_hours=24):
    rows = [[(j, s, None if h is None else START + dt.timedelta(hours=h), r, t, p) for j, s, h, r, t, p in b] for b in batches]
    s = lifecycle.job_lifecycle(folder_stream(spark, tmp_path, SCHEMA, rows), "job", "seq", "ts", "request", "target", "asked", ttl_ms=ttl_hours * HOUR, late="0 seconds")
    base = int(START.timestamp() * 1000)
    return bag((r.job, (r.at_ms - base) / HOUR, r.seq, r.step, r.outcome, r.state, r.progress, r.batch) for r in run(spark, s, tmp_path).collect())


def test_jobs_live_and_end(spark, tmp_path):
    batches = [
        [("a", 1, 0, "create", None, None), ("a", 2, 1, "claim", None, None), ("b", 3, 1, "report", None, None), (None, 4, 1, "create", None, None), ("x", 5, None, "create", None, None)],
        [("a", 6, 2, "claim", None, None), ("a", 7, 3, "advance", "needs_player_selection", 140), ("c", 8, 4, "create", None, None), ("a", 9, 4, "advance", "expired", 50)],
        [("a", 10, 5, "setup", None, None), ("a", 11, 6, "setup", None, None), ("a", 12, 7, "report", None, None), ("c", 13, 8, "delete", None, None), ("c", 14, 9, "report", None, None)],
        [("d", 15, 40, "create", None, None)],
        [("a", 16, 41, "report", None, None), ("d", 17, 41, "odd", None, None)],
    ]
    got = [r[:7] for r in lives(spark, tmp_path, batches)]
    want = [
        ("a", 0, 1, 0, "accepted", "uploaded", 0),
        ("a", 1, 2, 0, "accepted", "normalizing", 8),
        ("b", 1, 3, 0, "unknown", None, None),
        ("a", 2, 6, 0, "refused", "normalizing", 8),  # a claim is final
        ("a", 3, 7, 0, "accepted", "needs_player_selection", 100),
        ("c", 4, 8, 0, "accepted", "uploaded", 0),
        ("a", 4, 9, 0, "refused", "needs_player_selection", 100),
        ("a", 5, 10, 0, "accepted", "queued", 100),  # progress never falls
        ("a", 6, 11, 0, "refused", "queued", 100),
        ("a", 7, 12, 0, "accepted", "queued", 100),
        ("c", 8, 13, 0, "accepted", "deleting", 0),
        ("c", 8, 13, 1, "accepted", "purge", 0),
        ("c", 8, 13, 2, "accepted", "expired", 100),
        ("c", 9, 14, 0, "unknown", None, None),
        ("d", 40, 15, 0, "accepted", "uploaded", 0),
        ("a", 24, None, 0, "timer", "deleting", 100),  # in order, at the time it expires
        ("a", 24, None, 1, "timer", "purge", 100),
        ("a", 24, None, 2, "timer", "expired", 100),
        ("a", 41, 16, 0, "unknown", None, None),
        ("d", 41, 17, 0, "refused", "uploaded", 0),
    ]
    assert bag(got) == bag(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_jobs_do_not_depend_on_batches(spark, tmp_path, parts):
    """The same log in one batch or five, with expiry between the rows of a batch."""
    r = random.Random(4)
    log = [(f"j{r.randrange(6)}", n, n / 4, r.choice(lifecycle.REQUESTS), r.choice(["analyzing", "needs_player_selection"]), r.randrange(120)) for n in range(300)]
    got = [x[:7] for x in lives(spark, tmp_path, [log[k * 300 // parts : (k + 1) * 300 // parts] for k in range(parts)], 5)]
    held, want = {}, []

    def end(job, at, seq, how):
        p = held.pop(job)[1]
        want.extend((job, at, seq, n, how, s, v) for n, (s, v) in enumerate([("deleting", p), ("purge", p), ("expired", 100)]))

    for job, n, h, request, target, asked in log:
        if job in held and held[job][2] <= h:
            end(job, held[job][2], None, "timer")
        if job in held and request == "delete":
            end(job, h, n, "accepted")
            continue
        outcome = "accepted"
        if job not in held:
            if request == "create":
                held[job] = ("uploaded", 0, h + 5)
            else:
                outcome = "unknown"
        else:
            state, p, until = held[job]
            after = {"claim": state in ("uploaded", "queued") and ("normalizing", 8), "advance": (target, max(0, min(100, asked))), "setup": state == "needs_player_selection" and ("queued", max(p, 32)), "report": (state, p)}.get(request)
            outcome = "accepted" if after else "refused"
            held[job] = (*after, until) if after else held[job]
        want.append((job, h, n, 0, outcome, *(held[job][:2] if job in held else (None, None))))
    for job in [j for j, (_, _, until) in held.items() if until <= log[-1][2]]:
        end(job, held[job][2], None, "timer")
    assert bag(got) == bag(want)


def test_claims_stay(spark, tmp_path):
    """A later batch cannot take a claim away, and its state goes after its time."""
    t = lambda h: START + dt.timedelta(hours=h)
    schema = "job long, seq long, ts timestamp, state string"
    batches = [[(1, 5, t(5), "queued"), (1, 6, t(6), "queued"), (2, 7, t(6), "done"), (None, 8, t(6), "queued")], [(1, 2, t(6), "queued"), (2, 9, t(7), "uploaded")], [(3, 10, t(60), "queued")], [(1, 11, t(61), "queued")]]
    s = lifecycle.final_claims(folder_stream(spark, tmp_path, schema, batches), "job", "seq", "ts", ["uploaded", "queued"], "state", F.lit(True), keep_ms=24 * HOUR, late="0 seconds")
    assert bag((r.job, r.seq) for r in run(spark, s, tmp_path).collect()) == bag([(1, 5), (2, 9), (3, 10), (1, 11)])


def test_lanes(spark):
    """Halves are told apart by x."""
    rows = [(0.55, 0.40, 0.45, 0.45, False), (0.20, 0.45, 0.25, 0.60, True), (0.20, 0.1, 0.38, 0.48, True), (0.20, 0.1, 0.39, 0.2, False), (0.6, 0.1, 0.7, 0.49, False)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, want boolean")
    got = df.select(geometry.lane_conflict((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    h = geometry.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (0.75, 0.5), (0.25, 0.5)])
    x, y = geometry.project(h, F.col("x"), F.col("y"))
    # the second point lies on the horizon, where w is 0
    assert [(r.u is None, r.v is None) for r in spark.createDataFrame([(0.5, 0.5), (0.5, -h[8] / h[7])], "x double, y double").select(x.alias("u"), y.alias("v")).collect()] == [(False, False), (True, True)]


def test_pairs_and_roles(spark):
    near, far = (0.2, 0.4), (0.8, 0.4)
    track = lambda c, name, steps: [(c, name, t, *p) for t, p in steps]
    rows = track(1, "a", [(t, near) for t in range(0, 1000, 100)]) + track(1, "b", [(t, near if 200 <= t <= 400 or t >= 700 else far) for t in range(0, 1000, 100)])
    rows += track(2, "a", [(0, near), (200, near), (600, near), (800, near)]) + track(2, "b", [(0, near), (200, near), (600, near), (800, near)]) + track(3, "a", [(0, near)]) + track(3, "b", [(50, near)])
    rows += track(4, "a", [(t, near) for t in range(0, 2000, 100)]) + track(4, "b", [(t, near if t in (300, 400) else far) for t in range(0, 2000, 100)])
    samples = spark.createDataFrame(rows, "court int, track string, t long, x double, y double")
    pairs = spark.createDataFrame([(c, "a", "b") for c in (1, 2, 3, 4)], "court int, a string, b string")
    found = rally.pair_conflicts(samples, pairs, ["court"], "a", "b")
    assert bag((r.court, r.shared, r.conflicts, r.ratio, r.longest) for r in found.collect()) == [(1, 10, 6, 0.6, 200), (2, 4, 4, 1.0, 200), (3, 0, 0, None, 0), (4, 20, 2, 0.1, 100)]
    contacts = spark.createDataFrame([(3, "k1", ["c"]), (4, "k2", ["a", "c"]), (4, "k3", ["b"])], "court int, contact string, tracks array<string>")
    roles = lambda c: {r.court: (r.pair_rotation, r.contacts, r.next_shot_role) for r in rally.pair_roles(found, c, ["court"], "a", "b").collect()}
    assert roles(contacts) == {1: ("same_lane_conflict", 0, "unclear"), 2: ("same_lane_conflict", 0, "unclear"), 3: ("unknown", 0, "unknown"), 4: ("two_lanes_available", 2, "assigned")}
    both = contacts.unionByName(spark.createDataFrame([(4, "k4", ["b", "a", "a"])], contacts.schema))
    assert roles(both)[4] == ("two_lanes_available", 3, "unclear")


def test_contacts(spark):
    r = random.Random(8)
    points = [(g, n, n * 40 + r.randrange(20), round(r.random(), 3), round(r.random(), 3), r.random(), r.random() < 0.3) for g in range(3) for n in range(60)]
    boxes = [(g, f"t{r.randrange(4)}", r.randrange(2400), round(r.random() * 0.7, 3), round(r.random() * 0.6, 3), 0.3, 0.4, r.random()) for g in range(3) for _ in range(150)]
    got = rally.contact_candidates(spark.createDataFrame(points, "g int, point int, t long, x double, y double, confidence double, interpolated boolean"), spark.createDataFrame(boxes, "g int, track string, bt long, bx double, by double, width double, height double, bconf double"), ["g"], turn=1.15).collect()
    import math

    want = []
    for g in range(3):
        path, made = sorted((p for p in points if p[0] == g), key=lambda p: (p[2], p[1])), 0
        for a, b, c in zip(path, path[1:], path[2:], strict=False):
            u, v = (b[3] - a[3], b[4] - a[4]), (c[3] - b[3], c[4] - b[4])
            cos = (u[0] * v[0] + u[1] * v[1]) / (max(math.hypot(*u), 1e-9) * max(math.hypot(*v), 1e-9))
            if math.acos(max(-1, min(1, cos))) < 1.15:
                continue
            near = [x for x in boxes if x[0] == g and abs(x[2] - b[2]) <= 120 and x[3] - 0.035 <= b[3] <= x[3] + 0.335 and x[4] - 0.035 <= b[4] <= x[4] + 0.435]
            best = {}
            for x in near:
                key = ((x[3] + 0.15 - b[3]) ** 2 + (x[4] + 0.2 - b[4]) ** 2, -x[7])
                best[x[1]] = min(best.get(x[1], key), key)
            if near:
                made += 1
                tracks = sorted(best, key=lambda t: (*best[t], t))
                level = "high" if len(tracks) == 1 and b[5] >= 0.85 and not b[6] else "medium" if b[5] >= 0.65 else "low"
                want.append((g, f"contact-{b[2]}-{made}", (a[2] + b[2]) // 2, (b[2] + c[2]) // 2, [a[1], b[1], c[1]], tracks, level))
    assert bag((x.g, x.contact, x.start, x.end, list(x.points), list(x.tracks), x.level) for x in got) == bag(want) and len(want) > 60


def test_walk(spark):
    deep = {"a": [{"b": {"c": ["x PRIVATE y", 3, None, {"d": "clean"}]}}], "e": "private", "f": {"g": True}}
    far = "plain"
    for _ in range(40):
        far = {"n": [far]}
    rows = [(1, json.dumps(deep)), (2, None), (3, "no json"), (4, '"private"'), (5, "[]"), (None, json.dumps({"k.x": "my private/path"})), (6, json.dumps(far)), (6, json.dumps({"v": "Private"}))]
    df = spark.createDataFrame(rows, "key long, document string").withColumn("path", F.lit(1)).withColumn("pos", F.lit(2))
    got = documents.marker_hits(df, ["key"], "document", ["private", "/path"])
    assert bag(tuple(r) for r in got.collect()) == bag([(1, "$.a[0].b.c[0]", "private"), (1, "$.e", "private"), (4, "$", "private"), (None, "$.k.x", "private"), (None, "$.k.x", "/path"), (6, "$.v", "private")])
    walked = documents.walk_strings(df.select(F.col("key").alias("id"), "document"), ["id"], "document")
    assert ("$" + ".n[0]" * 40, "plain") in {(r.path, r.text) for r in walked.collect()}
    assert documents.marker_hits(df.limit(0), ["key"], "document", ["x"]).count() == 0


def test_merge(spark):
    cases = [
        ('{"a":{"b":1,"c":{"d":2}},"k":"ü"}', '{"a":{"c":{"e":3}}}', {"a": {"b": 1, "c": {"d": 2, "e": 3}}, "k": "ü"}),
        ('{"a":{"b":1}}', '{"a":[1]}', {"a": [1]}),
        ('{"a":[1]}', '{"a":{"b":2}}', {"a": {"b": 2}}),
        ('{"a":1}', '{"a":null}', {"a": None}),
        ('{"a":1}', None, {"a": 1}),
        (None, '{"a":1}', {"a": 1}),
        ("broken", '{"a":1}', {"a": 1}),
        ("[1]", '{"a":1}', {"a": 1}),
        (None, None, None),
    ]
    df = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(cases)], "n int, a string, b string")
    got = {r.n: r.m and json.loads(r.m) for r in df.select("n", documents.merge_json(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(cases)}
    put = df.where("n < 3").select("n", documents.path_update(F.col("a"), "a.c.z", F.lit("v")).alias("m")).collect()
    assert {r.n: json.loads(r.m) for r in put} == {0: {"a": {"b": 1, "c": {"d": 2, "z": "v"}}, "k": "ü"}, 1: {"a": {"b": 1, "c": {"z": "v"}}}, 2: {"a": {"c": {"z": "v"}}}}


def test_peaks(spark):
    r = random.Random(2)
    grids = [[round(r.choice([0.1, 0.4, 0.5, 0.9, r.random()]), 3) for _ in range(30)] for _ in range(40)] + [[], None, [0.9], [0.5] * 30, [0.2] * 30]
    df = spark.createDataFrame(list(enumerate(grids)), "n int, grid array<double>")
    got = {x.n: x.p and [(p.confidence, p.x, p.y) for p in x.p] for x in df.select("n", ranking.grid_peaks("grid", 6, threshold=0.35, radius=1, most=3).alias("p")).collect()}

    def plain(g):
        tall, kept = len(g) // 6, []
        for v, y, x in sorted((-v, i // 6, i % 6) for i, v in enumerate(g) if v >= 0.35):
            if len(kept) < 3 and all(max(abs(x - a), abs(y - b)) > 1 for _, b, a in kept):
                kept.append((v, y, x))
        return [(-v, x / 5, y / max(1, tall - 1)) for v, y, x in kept]

    assert got == {n: g and plain(g) if g is not None else None for n, g in enumerate(grids)}


def test_frameworks_in_blocks(spark, monkeypatch):
    profiles = spark.createDataFrame([(1, "pro", ["h0", "h1", "h1"], "smash", "speed", {"band": "high"}), (2, None, None, None, None, {})], "id int, level string, habits array<string>, action string, goal string, facts map<string,string>")
    frames = [("a", ["smash"], [], {"habits": ["h0", "h1"]}, {}, [("band", "equals", ["high"], None)], []), ("b", [], [], {}, {"habits": ["h1"], "level": ["pro"]}, None, []), ("c", [], ["speed", "power"], {"level": ["pro"]}, {}, [("band", "equals", [], 9), ("band", "in", ["high", "low"], 2)], []), ("d", ["smash"], [], {"habits": ["h0", "h1"]}, {}, [("band", "equals", ["high"], 4)], [])]
    table = spark.createDataFrame(frames, rules.FRAMEWORK_SCHEMA)
    for most in (10_000, 3, 1):
        monkeypatch.setattr(rules, "BROADCAST_RULES", most)
        s = rules.framework_scores(profiles, table, fields=["level"], lists=["habits"], action="action", goal="goal", facts="facts")
        got = {r.id: ([x.score for x in r.scores], r.best) for r in s.select("id", "scores", rules.best_framework(F.col("scores"))["framework_id"].alias("best")).collect()}
        # of equal scores the first wins
        assert got == {1: ([13, -6, 13, 13], "a"), 2: ([-2, 0, 0, -2], "b")}
    turned = table.withColumn("position", F.when(F.col("framework_id") == "d", 0).otherwise(1))
    s = rules.framework_scores(profiles, turned, fields=["level"], lists=["habits"], action="action", goal="goal", facts="facts")
    assert s.where("id = 1").select(rules.best_framework(F.col("scores"))["framework_id"]).first()[0] == "d"
    assert rules.framework_scores(profiles, table.limit(0), fields=["level"], action="action", goal="goal").select(F.size("scores")).first()[0] == 0
    assert spark.range(1).select(holds(F.lit("x"), F.lit("equals"), F.array().cast("array<string>"))).first()[0] is False


def test_stage_is_resumed(spark, tmp_path):
    """A run that is repeated asks nobody twice, another model asks again, and answers are parsed anew."""
    import pyarrow as pa

    from millrace.operators.stage import run_stage

    def says(prefix):
        def call(batches):
            for b in batches:
                ids = b.column("id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{prefix}{i}" if i != 4 else "?" for i in ids], pa.string())], names=["id", "raw"])

        return call

    def number(raw):
        return F.nullif(F.regexp_extract(raw, "[0-9]+", 0), F.lit("")).cast("long")

    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    run = lambda todo, model, n, prefix="x", parse=number: bag(tuple(r) for r in run_stage(todo, str(tmp_path / "log"), key="id", model=model, call=says(prefix), parse=parse, reject=F.lit(-1).cast("long"), run=n).collect())
    first = [(1, 1, 1, True), (2, 2, 1, True), (4, -1, 1, False)]
    assert run(rows(1, 2, 2, 4, None), "m", 1) == bag(first)
    assert run(rows(1, 2, 2, 4, None), "m", 1) == bag(first)  # the same run once more replaces itself
    assert run(rows(1, 2, 3, 4), "m", 2, "y") == bag([*first, (3, 3, 2, True)])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert run(rows(1), "other", 3, "z7") == [(1, 71, 3, True)]
    assert run(rows(1, 4), "m", 4, parse=lambda raw: F.length(raw).cast("long")) == bag([(1, 2, 1, True), (4, 1, 1, True)])
    assert run(rows(), "m", 5) == []


def test_writers(spark, tmp_path):
    from millrace.sources import writers

    path = str(tmp_path / "table")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, family string")
    writers.write_documents(df, path)
    # what is read from the table itself may replace it
    writers.write_documents(spark.read.schema(df.schema).json(path).where("id > 1"), path)
    assert bag(tuple(r) for r in spark.read.schema(df.schema).json(path).collect()) == [(2, "b"), (3, "a")]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    index = writers.publish(df, str(tmp_path / "shards"), "family")
    assert bag(tuple(r) for r in index.collect()) == [("a", 2, "family=a"), ("b", 1, "family=b")]


def test_ordered_distinct_and_passes(spark):
    from millrace.operators import aggregates, inventory

    rows = [("g", 3, "b"), ("g", 1, "a"), ("g", 2, "b"), ("g", 4, None), ("h", 1, "z"), ("h", 0, "z")]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    assert bag((r.g, r.list) for r in aggregates.ordered_distinct(df, ["g"], ["at"], "v").collect()) == [("g", ["a", "b", None]), ("h", ["z"])]
    videos = spark.createDataFrame([("s", 1, 5, "late", "T5", None), ("s", 0, 9, "first", None, 3), ("s", 0, 7, "first", "T7", 4), ("t", 1, 1, "late", "T1", 1)], "source string, pri int, at int, pass string, title string, size int")
    got = inventory.merge_passes(videos, ["source"], ["pri", "at"], "pass", ["title", "size"]).collect()
    assert bag(tuple(r) for r in got) == [("s", "T7", 4, ["first", "late"], 3), ("t", "T1", 1, ["late"], 1)]
