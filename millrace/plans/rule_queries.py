"""Queries on rule evaluation: events are observations, with facts from their type, value band and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import band, path_get
from ..operators import rules as R
from .registry import query, table

_RULES = [
    ("r-late", "late-arrival", 1, ["click", "purchase"], ["band"], [("band", "equals", ["high"], "value is high"), ("k3", "in", ["0", "1"], "k falls low")], 1),
    ("r-odd", "odd-structure", 2, ["click", "view", "error"], ["k3", "k7"], [("k7", "in", ["1", "3", "5"], "k is odd"), ("band", "equals", ["low"], "value is low")], 2),
    ("r-err", "error-seen", 1, ["error"], [], [("type", "equals", ["error"], "an error")], 1),
    ("r-none", "never", 0, [], [], [("type", "equals", ["view"], "a view")], 1),
    ("r-zero", "zero-key", 3, ["view", "signup", "purchase"], ["k7"], [("k7", "equals", ["0"], "k divides"), ("k3", "equals", ["2"], "k is two")], None),
]

#: Facts of an event: the band of its value, k modulo 3 and 7; every 11th key is declared missing, and k7 = 6 unknown.
_OBS_SQL = """
o AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
f AS (SELECT event_id, user_id, event_type, k % 11 = 0 AS gone,
             CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS band,
             CAST(k % 3 AS VARCHAR) AS k3, CASE WHEN k % 7 = 6 THEN 'unknown' ELSE CAST(k % 7 AS VARCHAR) END AS k7 FROM o),
m AS (SELECT *, gone OR k7 = 'unknown' AS k7_missing FROM f),
e AS (
  SELECT event_id, user_id, 'r-late' AS rule_id, 1 AS priority, (CASE WHEN band = 'high' THEN 1 ELSE 0 END) + (CASE WHEN k3 IN ('0', '1') THEN 1 ELSE 0 END) AS n, false AS lacks, 0 AS n_lacks, 1 AS need FROM m WHERE event_type IN ('click', 'purchase')
  UNION ALL SELECT event_id, user_id, 'r-odd', 2, (CASE WHEN NOT k7_missing AND k7 IN ('1', '3', '5') THEN 1 ELSE 0 END) + (CASE WHEN band = 'low' THEN 1 ELSE 0 END), k7_missing, CAST(k7_missing AS INT), 2 FROM m WHERE event_type IN ('click', 'view', 'error')
  UNION ALL SELECT event_id, user_id, 'r-err', 1, 1, false, 0, 1 FROM m WHERE event_type = 'error'
  UNION ALL SELECT event_id, user_id, 'r-zero', 3, (CASE WHEN NOT k7_missing AND k7 = '0' THEN 1 ELSE 0 END) + (CASE WHEN k3 = '2' THEN 1 ELSE 0 END), k7_missing, CAST(k7_missing AS INT), 1 FROM m WHERE event_type IN ('view', 'signup', 'purchase'))
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = path_get("props", "k", "long")
    facts = F.create_map(F.lit("type"), F.col("event_type"), F.lit("band"), band(F.col("value"), [(60, "high"), (20, "medium")], "low"), F.lit("k3"), (k % 3).cast("string"), F.lit("k7"), F.when(k % 7 == 6, "unknown").otherwise((k % 7).cast("string")))
    declared = F.when(k % 11 == 0, F.array(F.lit("k7"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("action"), facts.alias("facts"), declared.alias("declared"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, R.RULE_SCHEMA)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate_rules(observations(spark, sf_dir), rule_table(spark))


@query(f"""WITH {_OBS_SQL}, h AS (SELECT DISTINCT user_id, rule_id, priority FROM e WHERE NOT lacks AND n >= need),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, rule_id) AS x FROM h)
SELECT user_id, rule_id, CAST(priority AS BIGINT) AS priority FROM r WHERE x = 1""")
def rule_match_top_issue(spark, sf_dir):
    return R.top_issue(_matches(spark, sf_dir), key="user_id").select("user_id", "rule_id", F.col("priority").cast("long").alias("priority"))


@query(f"""WITH {_OBS_SQL} SELECT rule_id, count(*) AS tried, count(*) FILTER (WHERE NOT lacks AND n >= need) AS matched, count(*) FILTER (WHERE NOT lacks AND n < need) AS short_of_evidence,
count(*) FILTER (WHERE lacks AND n > 0) AS blocked_with_evidence FROM e GROUP BY rule_id""")
def rule_min_evidence(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumn("n_blocked", F.size("blocked"))
    lacks = F.exists("required", lambda p: F.coalesce(F.array_contains("declared", p), F.lit(False)) | F.coalesce(F.try_element_at("facts", p).isin("", "missing", "unknown", "not_visible"), F.lit(True)))
    return m.groupBy("rule_id").agg(F.count("*").alias("tried"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched") & ~lacks).alias("short_of_evidence"), F.count_if(F.col("n_blocked") > 0).alias("blocked_with_evidence"))


@query(f"""WITH {_OBS_SQL} SELECT event_id, rule_id, 'k7' AS path FROM e WHERE lacks AND n > 0""")
def rule_missing_evidence(spark, sf_dir):
    return _matches(spark, sf_dir).select("event_id", "rule_id", F.explode("blocked").alias("path"))


@query(f"""WITH {_OBS_SQL}, g AS (SELECT event_id, count(*) FILTER (WHERE NOT lacks AND n >= need) AS issues, max(CASE WHEN lacks AND n > 0 THEN 1 ELSE 0 END) AS lost FROM e GROUP BY event_id),
j AS (SELECT m.event_id, m.gone, coalesce(issues, 0) AS issues, coalesce(lost, 0) AS lost, (event_id IN (SELECT event_id FROM e)) AS tried FROM m LEFT JOIN g USING (event_id)),
t AS (SELECT event_id, rule_id, row_number() OVER (PARTITION BY event_id ORDER BY priority, rule_id) AS x FROM e WHERE NOT lacks AND n >= need)
SELECT j.event_id, issues AS n_issues, t.rule_id AS main_issue, CASE WHEN issues > 0 AND lost = 0 AND NOT (tried AND gone) THEN 'high' WHEN issues > 0 THEN 'medium' ELSE 'low' END AS confidence
FROM j LEFT JOIN t ON j.event_id = t.event_id AND t.x = 1""")
def full_diagnosis(spark, sf_dir):
    d = R.diagnose(observations(spark, sf_dir), rule_table(spark), key="event_id")
    return d.select("event_id", F.size("issues").cast("long").alias("n_issues"), "main_issue", "confidence")


#: Framework positions of rules: r-late second, r-err first; others have none.
_POSITIONS = {"r-err": 1, "r-late": 2}
_MORE = {"r-late": (["d1", "d2"], ["m1"], "late effect"), "r-odd": ([], ["m2"], "odd effect"), "r-err": (["d3"], [], "error effect")}


@query(f"""WITH {_OBS_SQL}, h AS (SELECT *, CASE rule_id WHEN 'r-err' THEN 1 WHEN 'r-late' THEN 2 ELSE 999 END AS place,
CASE rule_id WHEN 'r-late' THEN 'd1,d2' WHEN 'r-err' THEN 'd3' ELSE '' END AS drills, CASE rule_id WHEN 'r-late' THEN 'm1' WHEN 'r-odd' THEN 'm2' ELSE '' END AS metrics,
CASE rule_id WHEN 'r-late' THEN 'late effect' WHEN 'r-odd' THEN 'odd effect' WHEN 'r-err' THEN 'error effect' END AS effect FROM e WHERE NOT lacks AND n >= need)
SELECT event_id, rule_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY priority, place, rule_id) AS BIGINT) AS place, CAST(n AS BIGINT) AS n_evidence, drills, metrics, effect FROM h""")
def issue_rows(spark, sf_dir):
    """A row for each issue of an observation, in order, with evidence, drills, retest metrics and likely effect."""
    extra = spark.createDataFrame([(k, *v) for k, v in _MORE.items()], "rule_id string, drills array<string>, retest_metrics array<string>, likely_effect string")
    d = R.diagnose(observations(spark, sf_dir), rule_table(spark).join(extra, "rule_id", "left"), key="event_id", positions=_POSITIONS)
    i = d.select("event_id", F.posexplode("found").alias("at", "f"))
    text = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",")
    return i.select("event_id", "f.rule_id", (F.col("at") + 1).cast("long").alias("place"), F.size("f.evidence").cast("long").alias("n_evidence"), text("f.drills").alias("drills"), text("f.retest_metrics").alias("metrics"), F.col("f.likely_effect").alias("effect"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, list(l_linenumber * 10 ORDER BY l_linenumber) AS ts, list(DISTINCT l_returnflag) AS tags FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
t AS (SELECT *, 100 + 20 * len(list_intersect(tags, ['A', 'N'])) + least(len(ts), 3) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM t),
w AS (SELECT *, CASE WHEN list_contains(tags, 'N') THEN 15 ELSE 0 END AS a, CASE WHEN list_contains(tags, 'N') THEN 35 ELSE 25 END AS b FROM r WHERE n <= 3),
x AS (SELECT *, list_filter(ts, lambda t: t BETWEEN a AND b) AS inner_ts FROM w)
SELECT o_custkey, o_orderkey AS source_id, CAST(score AS BIGINT) AS score, CAST(a AS BIGINT) AS window_start, array_to_string((CASE WHEN len(inner_ts) > 0 THEN inner_ts ELSE ts END)[1:3], ',') AS timestamps FROM x""")
def evidence_selection(spark, sf_dir):
    """Of each customer the three orders that bear most on two return flags, with a window and timestamps in it."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber") * 10)).alias("timestamps"), F.collect_set("l_returnflag").alias("topic_tags"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    window = lambda a, b, tag: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.array(F.lit(tag)).alias("topics"))
    windows = F.when(F.array_contains("topic_tags", "N"), F.array(window(0, 25, "R"), window(15, 35, "N"))).otherwise(F.array(window(0, 25, "R"), window(15, 35, "Z")))
    s = o.select("o_custkey", F.col("o_orderkey").alias("source_id"), F.array(F.lit("fw")).alias("framework_ids"), "topic_tags", "timestamps", windows.alias("windows"))
    e = R.select_evidence(s, framework=F.lit("fw"), topics=F.array(F.lit("A"), F.lit("N")), by=["o_custkey"])
    return e.select("o_custkey", "source_id", "score", F.col("window.start").cast("long").alias("window_start"), F.array_join("timestamps", ",").alias("timestamps"))


@query(f"""WITH {_OBS_SQL}, g AS (SELECT user_id, count(*) FILTER (WHERE NOT lacks AND n >= need) AS issues, count(*) FILTER (WHERE lacks AND n > 0) AS lost FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN issues > 0 AND lost = 0 THEN 'high' WHEN issues > 0 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def diagnosis_confidence(spark, sf_dir):
    g = _matches(spark, sf_dir).groupBy("user_id").agg(F.count_if("matched").alias("issues"), F.count_if(F.size("blocked") > 0).alias("lost"))
    return g.select("user_id", R.diagnosis_confidence(F.col("issues"), F.col("lost")).alias("confidence"))


_FRAMES = [
    ("fw-a", ["BUILDING"], ["F", "O"], {"c_mktsegment": ["BUILDING", "MACHINERY"]}, {"half": ["neg"]}),
    ("fw-b", ["BUILDING", "AUTOMOBILE", "FURNITURE"], ["O"], {"half": ["pos"]}, {"c_mktsegment": ["FURNITURE"]}),
    ("fw-c", [], [], {"half": ["pos", "neg"], "third": ["0"]}, {}),
    ("fw-d", ["HOUSEHOLD", "MACHINERY"], ["F"], {"third": ["1", "2"]}, {"half": ["pos"], "c_mktsegment": ["BUILDING"]}),
]


@query("""
WITH p AS (SELECT c_custkey, c_mktsegment AS s, CASE WHEN c_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS half, CAST(c_custkey % 3 AS VARCHAR) AS third, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS goal FROM customer),
x AS (
  SELECT c_custkey, 'fw-a' AS f, (CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END) - (CASE WHEN half = 'neg' THEN 3 ELSE 0 END) + (CASE WHEN s = 'BUILDING' THEN 7 ELSE -2 END) + (CASE WHEN goal IN ('F', 'O') THEN 10 ELSE 0 END) AS score FROM p
  UNION ALL SELECT c_custkey, 'fw-b', (CASE WHEN half = 'pos' THEN 1 ELSE 0 END) - (CASE WHEN s = 'FURNITURE' THEN 3 ELSE 0 END) + (CASE WHEN s IN ('BUILDING', 'AUTOMOBILE', 'FURNITURE') THEN 5 ELSE -2 END) + (CASE WHEN goal = 'O' THEN 11 ELSE 0 END) FROM p
  UNION ALL SELECT c_custkey, 'fw-c', 1 + (CASE WHEN third = '0' THEN 1 ELSE 0 END) FROM p
  UNION ALL SELECT c_custkey, 'fw-d', (CASE WHEN third IN ('1', '2') THEN 1 ELSE 0 END) - (CASE WHEN half = 'pos' THEN 3 ELSE 0 END) - (CASE WHEN s = 'BUILDING' THEN 3 ELSE 0 END) + (CASE WHEN s IN ('HOUSEHOLD', 'MACHINERY') THEN 6 ELSE -2 END) + (CASE WHEN goal = 'F' THEN 11 ELSE 0 END) FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, f) AS n FROM x)
SELECT c_custkey, f AS framework_id, CAST(score AS BIGINT) AS score FROM r WHERE n = 1""")
def framework_score_argmax(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, "pos").otherwise("neg").alias("half"), (F.col("c_custkey") % 3).cast("string").alias("third"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("goal"))
    frames = spark.createDataFrame(_FRAMES, "framework_id string, actions array<string>, goals array<string>, suitable_for map<string,array<string>>, avoid_for map<string,array<string>>")
    s = R.framework_scores(c, frames, fields=["c_mktsegment", "half", "third"], action="c_mktsegment", goal="goal")
    return s.select("c_custkey", R.best_framework(F.col("scores")).alias("best")).select("c_custkey", "best.framework_id", "best.score")


@query("""
WITH l AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1),
n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ['A', 'R'] WHEN o_orderstatus = 'O' THEN ['N'] ELSE ['A', 'N', 'R'] END AS needs, coalesce(have, []) AS have FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
m AS (SELECT o_orderkey, list_filter(needs, lambda x: NOT list_contains(have, x)) AS lack, len(have) AS student FROM n)
SELECT o_orderkey, array_to_string(list_transform(lack, lambda x: 'action_package.' || x), ',') AS lacking, len(lack) = 0 AS allowed,
CASE WHEN len(lack) > 0 OR student = 0 THEN 'insufficient' WHEN o_orderkey % 5 = 0 THEN 'unavailable' ELSE 'matched' END AS status FROM m""")
def action_package_gate(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    o = table(spark, sf_dir, "orders").join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    s = F.col("o_orderstatus")
    needs = F.when(s == "F", F.array(F.lit("A"), F.lit("R"))).when(s == "O", F.array(F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    g = R.phase_gate(o, needs=needs, have=F.col("have"))
    status = R.evidence_status(F.size("missing_phases"), F.size("have"), F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1))
    return g.select("o_orderkey", F.array_join("missing_phases", ",").alias("lacking"), "allowed", status.alias("status"))


@query("""SELECT p_partkey, CASE WHEN contains(replace(lower(p_type), '_', '-'), 'brass') THEN 'contact' WHEN contains(replace(lower(p_type), '_', '-'), 'steel') THEN 'recovery' WHEN contains(replace(lower(p_type), '_', '-'), 'a_b') THEN 'ready' ELSE 'preparation' END AS phase FROM part""")
def issue_phase(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.issue_phase(F.col("p_type"), [("brass", "contact"), ("steel", "recovery"), ("a_b", "ready")]).alias("phase"))


_HABITS = [("h0", 2), ("h1", 3), ("h2", 5)]
_GUIDES = [
    ("fw-a", ["click", "purchase"], ["speed"], {"level": ["pro"], "habits": ["h0", "h1"]}, {"habits": ["h2"]}, [("band", "equals", ["high"], 6)], ["error-seen", "late-arrival"]),
    ("fw-b", ["error"], ["power", "control"], {"level": ["new"]}, {"level": ["pro"]}, [("k3", "in", ["0", "1"], None)], ["odd-structure", "error-seen"]),
    ("fw-c", [], [], {"habits": ["h0", "h2"]}, {}, [("type", "equals", ["view"], 5), ("k7", "equals", ["3"], 2)], []),
]
_PHASES = [("late", "contact"), ("odd", "recovery")]

#: The choice of a framework, the gate of phases and the order of issues, on top of the rules' results.
_GUIDED = f"""{_OBS_SQL},
p AS (SELECT m.*, o.k, CASE WHEN o.k % 2 = 0 THEN 'pro' ELSE 'new' END AS level, o.k % 2 = 0 AS h0, o.k % 3 = 0 AS h1, o.k % 5 = 0 AS h2, CASE o.k % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'power' ELSE 'control' END AS goal FROM m JOIN o USING (event_id) WHERE o.k IS NOT NULL),
s AS (
  SELECT event_id, 'fw-a' AS fw, (CASE WHEN level = 'pro' THEN 1 ELSE 0 END) + (CASE WHEN h0 THEN 1 ELSE 0 END) + (CASE WHEN h1 THEN 1 ELSE 0 END) - (CASE WHEN h2 THEN 3 ELSE 0 END) + (CASE WHEN event_type IN ('click', 'purchase') THEN 6 ELSE -2 END) + (CASE WHEN goal = 'speed' THEN 11 ELSE 0 END) + (CASE WHEN band = 'high' THEN 6 ELSE 0 END) AS score FROM p
  UNION ALL SELECT event_id, 'fw-b', (CASE WHEN level = 'new' THEN 1 ELSE -3 END) + (CASE WHEN event_type = 'error' THEN 7 ELSE -2 END) + (CASE WHEN goal IN ('power', 'control') THEN 10 ELSE 0 END) + (CASE WHEN k3 IN ('0', '1') THEN 4 ELSE 0 END) FROM p
  UNION ALL SELECT event_id, 'fw-c', (CASE WHEN h0 THEN 1 ELSE 0 END) + (CASE WHEN h2 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'view' THEN 5 ELSE 0 END) + (CASE WHEN k7 = '3' THEN 2 ELSE 0 END) FROM p),
b AS (SELECT event_id, fw, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, fw) AS n FROM s) WHERE n = 1),
j AS (SELECT e.event_id, rule_id, priority, n, lacks, need, CASE rule_id WHEN 'r-late' THEN 'late-arrival' WHEN 'r-odd' THEN 'odd-structure' WHEN 'r-err' THEN 'error-seen' ELSE 'zero-key' END AS issue, CASE rule_id WHEN 'r-late' THEN 'contact' WHEN 'r-odd' THEN 'recovery' ELSE 'preparation' END AS phase, NOT lacks AND n >= need AS hit FROM e),
g AS (SELECT j.*, fw, hit AND k % 5 <> 0 AND NOT ((phase = 'preparation') OR (phase = 'contact' AND k % 2 = 1) OR (phase = 'recovery' AND k % 3 > 0)) AS lost FROM j JOIN p USING (event_id) JOIN b USING (event_id)),
q AS (SELECT *, CASE WHEN fw = 'fw-a' AND issue = 'error-seen' THEN 0 WHEN fw = 'fw-a' AND issue = 'late-arrival' THEN 1 WHEN fw = 'fw-b' AND issue = 'odd-structure' THEN 0 WHEN fw = 'fw-b' AND issue = 'error-seen' THEN 1 ELSE 999 END AS place FROM g),
i AS (SELECT event_id, string_agg(issue, ',' ORDER BY priority, place, issue) AS issues, CAST(sum(n) AS BIGINT) AS n_evidence FROM q WHERE hit AND NOT lost GROUP BY event_id),
l AS (SELECT event_id, string_agg(what, ',' ORDER BY at_) AS missing FROM (SELECT event_id, what, min(at_) AS at_ FROM (SELECT event_id, 'k7' AS what, '' AS at_ FROM p WHERE gone UNION ALL SELECT event_id, 'k7', rule_id || '1' FROM g WHERE lacks AND n > 0 UNION ALL SELECT event_id, 'action_package.' || phase, rule_id || '2' FROM g WHERE lost) GROUP BY ALL) GROUP BY event_id),
d AS (SELECT p.event_id, p.event_type, fw AS framework_id, coalesce(issues, '') AS issues, coalesce(n_evidence, 0) AS n_evidence, coalesce(missing, '') AS missing, CASE WHEN issues IS NOT NULL AND missing IS NULL THEN 'high' WHEN issues IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM p JOIN b USING (event_id) LEFT JOIN i USING (event_id) LEFT JOIN l USING (event_id))"""


def _guides(spark):
    return spark.createDataFrame(_GUIDES, R.FRAMEWORK_SCHEMA)


def _profiles(spark, sf_dir):
    k = F.col("k")
    o = observations(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", path_get("props", "k", "long").alias("k")).where("k IS NOT NULL"), "event_id")
    habits = F.filter(F.array(*[F.when(k % n == 0, h) for h, n in _HABITS]), lambda h: h.isNotNull())
    o = o.withColumn("level", F.when(k % 2 == 0, "pro").otherwise("new")).withColumn("habits", habits)
    return o.withColumn("goal", F.when(k % 3 == 0, "speed").when(k % 3 == 1, "power").otherwise("control"))


def _diagnoses(spark, sf_dir):
    k = F.col("k")
    phases = F.when(k % 5 != 0, F.array_compact(F.array(F.lit("preparation"), F.when(k % 2 == 1, "contact"), F.when(k % 3 > 0, "recovery"))))
    return R.match_diagnosis(_profiles(spark, sf_dir), rule_table(spark), _guides(spark), key="event_id", fields=["level"], lists=["habits"], goal="goal", phases=phases, keywords=_PHASES)


@query(f"""WITH {_GUIDED} SELECT event_id, fw AS framework_id, CAST(score AS BIGINT) AS score FROM b""")
def framework_triggers(spark, sf_dir):
    """The best framework of each observation, with list-valued fields and triggers that weigh facts."""
    s = R.framework_scores(_profiles(spark, sf_dir), _guides(spark), fields=["level"], lists=["habits"], action="action", goal="goal", facts="facts")
    return s.select("event_id", R.best_framework(F.col("scores")).alias("best")).select("event_id", "best.framework_id", "best.score")


@query(f"""WITH {_GUIDED} SELECT event_id, framework_id, issues, n_evidence, missing, confidence FROM d""")
def match_diagnosis(spark, sf_dir):
    """Framework, rules, gate of phases, order and confidence in one plan."""
    d = _diagnoses(spark, sf_dir)
    text = lambda c: F.array_join(c, ",").alias(c)
    return d.select("event_id", "framework_id", text("issues"), F.size("evidence").cast("long").alias("n_evidence"), text("missing"), "confidence")


#: Parts as sources: frameworks by key, brand and container as topics, sizes as times.
_ALIASES = {"purchase": "PROMO", "view": "LARGE"}


@query(f"""WITH {_GUIDED},
c AS (SELECT p_partkey, 'fw-' || chr(CAST(97 + p_partkey % 3 AS INTEGER)) AS fw, string_split(p_type, ' ') AS tags, p_size, p_partkey % 4 = 0 AS seq FROM part),
y AS (SELECT DISTINCT framework_id, event_type FROM d),
z AS (SELECT y.*, p_partkey, 100 + 20 * len(list_filter(list_distinct(tags), lambda t: t IN (event_type, CASE event_type WHEN 'purchase' THEN 'PROMO' WHEN 'view' THEN 'LARGE' ELSE '' END))) + (CASE WHEN seq THEN 5 ELSE 0 END) + least(p_size, 3) AS score FROM y JOIN c ON c.fw = y.framework_id),
t AS (SELECT framework_id, event_type, string_agg(p_partkey || ':' || score, ',' ORDER BY n) AS corpus FROM (SELECT *, row_number() OVER (PARTITION BY framework_id, event_type ORDER BY score DESC, p_partkey) AS n FROM z) WHERE n <= 3 GROUP BY ALL)
SELECT event_id, d.framework_id, corpus FROM d JOIN t ON t.framework_id = d.framework_id AND t.event_type = d.event_type""")
def corpus_evidence(spark, sf_dir):
    """Each diagnosis with the three sources that bear most on its framework and action; sequences count five."""
    tags = F.array_distinct(F.split("p_type", " "))
    sequence = F.when(F.col("p_partkey") % 4 == 0, F.array(F.struct(tags.alias("topics")))).otherwise(F.array().cast("array<struct<topics:array<string>>>"))
    none = F.array().cast("array<struct<start:int,end:int,topics:array<string>>>")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.array(F.concat(F.lit("fw-"), F.char((97 + F.col("p_partkey") % 3).cast("int")))).alias("framework_ids"), tags.alias("topic_tags"), none.alias("windows"), F.sequence(F.lit(1), F.col("p_size")).alias("timestamps"), sequence.alias("sequences"))
    found = R.with_corpus_evidence(_diagnoses(spark, sf_dir), parts, aliases=_ALIASES, sequences="sequences")
    return found.select("event_id", "framework_id", F.array_join(F.transform("corpus", lambda e: F.concat_ws(":", e["source_id"], e["score"])), ",").alias("corpus"))
