"""Ties, nulls, empty tables and documented behaviour of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.functions.slots import detect, review_status
from millrace.operators import intervals as I
from millrace.operators import joins as J
from millrace.operators import ranking as R
from millrace.operators import rules
from millrace.operators import series as S
from millrace.operators import validation as V
from millrace.operators.geometry import homography, inside, is_convex, project
from millrace.operators.routing import Route, first_route, more_specific, one_system, top_routes
from millrace.operators.state import final_states, pending, upsert
from millrace.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_missing_is_two_valued(spark):
    none = F.lit(None).cast("string")
    declared = F.array(F.lit("foot"))
    r = one(spark, X.is_missing(none, declared, "a").alias("a"), X.is_missing(F.lit("late"), declared, "foot.step").alias("b"), X.is_missing(F.lit("late"), F.lit(None).cast("array<string>"), "x").alias("c"), X.is_missing(F.lit("unknown"), declared, "x").alias("d"))
    assert (r.a, r.b, r.c, r.d) == (True, True, False, True)
    r = one(spark, X.holds(none, F.lit("equals"), F.array(F.lit("a"))).alias("a"), X.holds(F.lit("a"), F.lit("in"), F.array(F.lit("b"), F.lit("a"))).alias("b"), X.holds(F.lit("b"), F.lit("in"), F.array(F.lit("a"))).alias("c"))
    assert (r.a, r.b, r.c) == (False, True, False)
    for wrong in (X.holds(F.lit("a"), F.lit("other"), F.array(F.lit("a"))), X.label_of({"a": "A"}, F.lit("b"))):
        with pytest.raises(Exception, match="unknown condition|no label"):
            one(spark, wrong.alias("x"))
    assert one(spark, X.label_of({"a": "A"}, F.lit("a")).alias("x")).x == "A"
    assert one(spark, X.safe_path(F.lit("a+b"), ["a.b"]).alias("x"), X.safe_path(F.lit("xA.b"), ["a.b"]).alias("y"))[:] == (True, False)


def test_paths_and_links(spark):
    r = one(spark, X.path_get(F.lit('{"a": {"b": 3}}'), "a.b", "long").alias("a"), X.path_get(F.lit('{"a": 1}'), "a.b", "long").alias("b"), X.path_get(F.lit("no json"), "a").alias("c"), X.path_set({"a.b": F.lit(1), "a.c.d": F.lit("x")}).alias("d"))
    assert (r.a, r.b, r.c) == (3, None, None) and json.loads(r.d) == {"a": {"b": 1, "c": {"d": "x"}}}
    links = {"http://h/v": "http://h/v#t=7", "http://h/v?p=2&t=9": "http://h/v?p=2&t=7", "http://h/v?t=9&p=2#x": "http://h/v?p=2&t=7"}
    for url, want in links.items():
        assert one(spark, X.link_at(F.lit(url), F.lit("7")).alias("x")).x == want


def test_rules_need_evidence(spark):
    table = spark.createDataFrame([("r1", "i", 2, ["hit"], ["grip"], [("grip", "equals", ["late"], "late grip"), ("foot", "in", ["a", "b"], "foot")], 2), ("r2", "j", 1, None, [], [("grip", "equals", ["late"], "x")], 1)], rules.RULE_SCHEMA)
    obs = spark.createDataFrame([(1, "hit", {"grip": "late", "foot": "a"}, []), (2, "hit", {"foot": "a"}, []), (3, "hit", {"grip": "late", "foot": "c"}, []), (4, "miss", {"grip": "late"}, []), (5, "hit", {}, ["grip"])], "id long, action string, facts map<string,string>, declared array<string>")
    got = {r.id: (r.matched, r.evidence, r.blocked) for r in rules.evaluate_rules(obs, table).collect()}
    assert got == {1: (True, ["late grip", "foot"], []), 2: (False, ["foot"], ["grip"]), 3: (False, ["late grip"], []), 5: (False, [], [])}
    d = {r.id: (r.main_issue, r.confidence) for r in rules.diagnose(obs, table, key="id").collect()}
    assert d[1] == ("r1", "high") and d[2] == (None, "low") and d[4] == (None, "low")
    none = spark.createDataFrame([("r0", "i", 1, ["hit"], [], [("grip", "equals", ["never"], "x")], 0), ("r3", "k", 1, ["hit"], [], [("grip", "equals", ["late"], "y")], None)], rules.RULE_SCHEMA)
    found = rules.diagnose(obs.where("id = 1"), none, key="id", positions={"r3": 4}).first()
    assert found.issues == ["r3", "r0"] and found.found[0].evidence == ["y"] and found.found[1].position == 999


def test_rankings_break_ties(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("b", 4, None)], "g string, id long, v double")
    assert [(r.g, r.id) for r in R.top_per_group(df, ["g"], [F.desc("v"), F.desc("id")]).orderBy("g").collect()] == [("a", 2), ("b", 4)]
    tier = R.preferred_tier(df, ["g"], F.coalesce(F.col("v") == 4.0, F.lit(False)))
    assert sorted(r.id for r in tier.collect()) == [3, 4]
    assert R.stratified_sample(df.limit(0), ["g"], F.col("id")).count() == 0
    assert one(spark, R.best_position(F.array(F.lit(1), F.lit(7), F.lit(7))).alias("x")).x == 1


def test_interval_joins(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 5, 5)], "a long, s long, e long").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(7, 10, 12), (8, 0, 100)], "b long, bs long, be long").withColumn("k", F.lit(1))
    assert sorted((r.a, r.b) for r in I.overlap_join(a, b, ["k"], "s", "e", "bs", "be", 4).collect()) == [(1, 8), (2, 7), (2, 8), (3, 8)]
    p = spark.createDataFrame([(1, 10), (2, 13)], "p long, t long").withColumn("k", F.lit(1))
    assert sorted((r.p, r.a) for r in I.points_in(p, a, ["k"], "t", "s", "e", 3).collect()) == [(1, 1), (1, 2), (2, 2)]
    near = I.nearest(p.withColumnRenamed("t", "lt"), spark.createDataFrame([(1, 8, 1), (2, 12, 1)], "r long, rt long, k int"), ["k"], ["p"], "lt", "rt", 2, "r")
    assert sorted((x.p, x.r) for x in near.collect()) == [(1, 1), (2, 2)]


def test_series(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 30, 3), (1, 31, 4), (1, 32, 5)], "u long, t long, id long")
    assert sorted((r.id, r.session) for r in S.sessions(e, ["u"], "t", "id", 10, 2).collect()) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]
    g = spark.createDataFrame([(1, 0, 0.0, 0.8), (1, 3, 3.0, 0.6), (1, 9, 1.0, 1.0)], "u long, f long, v double, c double")
    assert [(r.f, r.v, r.c) for r in S.fill_gaps(g, ["u"], "f", "v", "c").where("interpolated").orderBy("f").collect()] == [(1, 1.0, 0.3), (2, 2.0, 0.3)]
    assert S.streaks(e.limit(0), ["u"], "t", "id", F.lit(True), 5).count() == 0


def test_joins(spark):
    rows = spark.createDataFrame([(1, ["b", "x", "a"]), (2, [])], "id long, ids array<string>")
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    assert {r.id: r.found for r in J.lookup_in_order(rows, "id", "ids", dim, "k", "v").collect()} == {1: ["B", "A"], 2: []}
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a long, b long")
    assert [tuple(r) for r in J.missing_reverse(edges, edges, "a", "b").collect()] == [(2, 3)]
    start = spark.createDataFrame([(1,)], "a long")
    assert sorted((r.node, r.steps) for r in J.reachable(edges, start, "a", "b", 5).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_routing(spark):
    routes = [Route("g", "clear"), Route("s", "high clear", 9), Route("t", "drop", 9)]
    r = one(spark, first_route(F.lit("High CLEAR"), routes, "x").alias("a"), first_route(F.lit("none"), routes, "x").alias("b"), first_route(F.lit("ad clear"), routes, "x", "^ad").alias("c"), top_routes(F.lit("drop high clear"), routes, 2, "x").alias("d"), more_specific(F.array(F.lit("g"), F.lit("s")), {"g": ["s"]}).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == ("s", "x", None, ["s", "t"], ["s"])


def test_geometry(spark):
    square = [(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    bow = [square[0], square[2], square[1], square[3]]
    r = one(spark, is_convex(square).alias("a"), is_convex(bow).alias("b"), inside(square, (F.lit(1.0), F.lit(0.5))).alias("c"), inside(square, (F.lit(1.1), F.lit(0.5))).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False)
    flat = [(F.lit(x), F.lit(x)) for x in (0.0, 1.0, 2.0, 3.0)]
    back = square[::-1]
    r = one(spark, is_convex(flat).alias("a"), inside(flat, (F.lit(1.0), F.lit(1.0))).alias("b"), is_convex(back).alias("c"), inside(back, (F.lit(0.5), F.lit(1.0))).alias("d"), inside(back, (F.lit(0.5), F.lit(-0.1))).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (False, False, True, True, False)
    h = homography([(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    u, v = project(h, F.lit(1.0), F.lit(2.2))
    assert tuple(one(spark, F.round(u, 6).alias("u"), v.alias("v"))) == (0.5, 1.0)
    far, _ = project(h, F.lit(9.0), F.lit(1.0))
    assert one(spark, far.alias("x")).x is None


def test_states(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "deleting"), (1, 3, "running"), (2, 1, "queued"), (2, 2, "running")], "job long, seq long, state string")
    assert sorted((r.job, r.state) for r in final_states(log, ["job"], "seq", "state", ["deleting", "expired"]).collect()) == [(1, "deleting"), (2, "running")]
    assert sorted((r.job, r.seq) for r in upsert(log.where("seq = 1"), log.where("job = 2"), ["job"], "seq").collect()) == [(1, 1), (2, 2)]
    assert pending(log, log.where("job = 1"), ["job"]).count() == 2


def test_validation(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, v long")
    assert [tuple(r) for r in V.violations(df, "id", [("positive", F.col("v") > 0)]).collect()] == [(1, "positive")]
    assert [tuple(r) for r in V.dangling(df, "id", "v", df.where("false"), "id", "lost").collect()] == [(2, "lost")]
    assert V.same_rows(df, df).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\ttitle\n1\tx\n")
    assert readers.read_tsv(spark, str(tmp_path / "a.tsv"), ["id", "title"]).first().title == "x"
    with pytest.raises(ValueError):
        readers.read_tsv(spark, str(tmp_path / "a.tsv"), ["id", "name"])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "d.json").write_text('{"schema_version": "2", "x": 1}')
    assert readers.read_json_document(spark, str(tmp_path / "d.json"), "2").first().x == 1
    with pytest.raises(ValueError):
        readers.read_json_document(spark, str(tmp_path / "d.json"), "3")
    assert readers.read_optional(spark, str(tmp_path / "none.json"), "a long").count() == 0
    with pytest.raises(ValueError):
        readers.keyed(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    df = spark.createDataFrame([("f1", 1), ("f2", 2), ("f1", 3)], "family string, n long")
    index = writers.publish(df, str(tmp_path / "pub"), "family")
    assert sorted((r.family, r.rows) for r in index.collect()) == [("f1", 2), ("f2", 1)]
    assert not writers.is_stale(spark.read.json(str(tmp_path / "pub")).select("family", "n"), df)
    with pytest.raises(ValueError):
        readers.read_sharded(spark, str(tmp_path), spark.createDataFrame([("../x",)], "p string"), "p", "a long")
    for _ in range(2):
        writers.write_documents(df, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 3
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_yaml_and_lessons(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a-rubric.yaml").write_text("- {id: r1, n: 1}\n- {id: r2, n: 2}\n")
    (tmp_path / "b-rubric.yaml").write_text("- {id: r1, n: 3}\n")
    items = readers.read_yaml_list(spark, str(tmp_path / "*-rubric.yaml"), "id string, n long")
    assert [(r.id, r.n) for r in readers.in_file_order(items).orderBy("__order").collect()] == [("r1", 1), ("r2", 2), ("r1", 3)]
    assert {r.id: r.n for r in readers.in_file_order(items, "id").collect()} == {"r1": 3, "r2": 2}
    (tmp_path / "c.yaml").write_text("id: c\nx: 1\n")
    assert readers.read_yaml_mapping(spark, str(tmp_path / "c.yaml"), "id string, x long").first().x == 1
    assert readers.read_yaml_mapping(spark, str(tmp_path / "none.yaml"), "id string").count() == 0
    with pytest.raises(Exception, match="no YAML list"):
        readers.read_yaml_list(spark, str(tmp_path / "c.yaml"), "id string").count()
    with pytest.raises(Exception):
        readers.read_yaml_list(spark, str(tmp_path / "none.yaml"), "id string").count()
    files = spark.createDataFrame([("file:/x/c.yaml", "c")], "file string, id string")
    assert readers.named_like_file(files, "id").count() == 1
    with pytest.raises(ValueError):
        readers.named_like_file(files.withColumn("id", F.lit("d")), "id")
    lessons = spark.createDataFrame([("l1", "s1", 1.5)], "lesson string, source string, at double")
    known = spark.createDataFrame([("s1",)], "source string")
    assert readers.load_lessons(lessons, known, key="lesson", source="source", seconds=["at"]).first()["at"] == 1500
    with pytest.raises(ValueError):
        readers.load_lessons(lessons, known.limit(0), key="lesson", source="source", seconds=["at"])
    with pytest.raises(ValueError):
        readers.load_lessons(lessons.union(lessons), known, key="lesson", source="source", seconds=["at"])


def test_requests_and_conflicts(spark):
    V.check_request(2, required={"id": "a"}, choices={"kind": ("x", ["x", "y"])})
    for bad in ({"limit": 4}, {"limit": 1, "required": {"id": " "}}, {"limit": 1, "choices": {"kind": ("z", ["x"])}}):
        with pytest.raises(ValueError):
            V.check_request(**bad)
    topics = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "topic string, system string")
    with pytest.raises(ValueError):
        one_system(topics, "topic", "system")
    assert one_system(topics.where("topic = 'u'"), "topic", "system").count() == 1


def test_packages_and_shards(spark, tmp_path):
    for name in ("p1", "p2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "lesson.json").write_text(f'{{"id": "{name}"}}')
    assert sorted((r.package, r.id) for r in readers.read_packages(spark, str(tmp_path), "lesson.json", "id string").collect()) == [("p1", "p1"), ("p2", "p2")]
    (tmp_path / "s1.json").write_text('{"a": 1}\n')
    index = spark.createDataFrame([("s1.json",), ("s1.json",)], "p string")
    assert readers.read_sharded(spark, str(tmp_path), index, "p", "a long").count() == 1


def test_slots_are_closed(spark):
    assert detect(spark.range(3), None, "id long").count() == 0
    r = one(spark, review_status(F.lit(None).cast("boolean"), F.lit(True)).alias("a"), review_status(F.lit(True), F.lit(None).cast("boolean")).alias("b"))
    assert (r.a, r.b) == ("unavailable", "rejected")
