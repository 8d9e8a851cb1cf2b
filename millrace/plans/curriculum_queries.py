"""Queries on a curriculum of parts: brands are techniques, types with a size digit topics, orders courses and lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curriculum as C
from .registry import query, table

#: Techniques: brands in order, each with the one before as prerequisite and the one after as next; some links are broken.
_TECHNIQUES = """br AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS n, count(*) AS c FROM part GROUP BY p_brand),
tq AS (SELECT p_brand AS technique, n, 's' || n % 4 AS system, CASE WHEN n % 6 = 0 THEN [] ELSE ['t' || (n - 1)] END AS prerequisites, CASE WHEN n % 7 = 0 THEN ['t' || n] ELSE ['t' || (n + 1)] END AS next, ['r' || n % 5, 'r' || n % 3] AS rule_ids, CASE WHEN n % 3 = 0 THEN ['c' || n, 'c' || (n + 1)] WHEN n % 3 = 1 THEN ['c' || n] ELSE [] END AS courses, CASE WHEN n % 4 = 0 THEN 'knowledge_only' ELSE 'teaching_ready' END AS availability FROM br),
tc AS (SELECT 't' || n AS technique, n, system, prerequisites, next, rule_ids, courses, availability FROM tq),
cs AS (SELECT 'c' || n AS course, CASE WHEN n % 5 = 0 THEN 't' || (n + 40) ELSE 't' || n END AS technique FROM br WHERE n % 8 < 7)"""


def _techniques(spark, sf_dir):
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("n", F.row_number().over(Window.orderBy("p_brand")))  # a few brands
    n, name = F.col("n"), lambda p, x: F.concat(F.lit(p), x.cast("string"))
    none = F.array().cast("array<string>")
    t = brands.select(
        name("t", n).alias("technique"),
        "n",
        name("s", n % 4).alias("system"),
        F.when(n % 6 == 0, none).otherwise(F.array(name("t", n - 1))).alias("prerequisites"),
        F.when(n % 7 == 0, F.array(name("t", n))).otherwise(F.array(name("t", n + 1))).alias("next"),
        F.array(name("r", n % 5), name("r", n % 3)).alias("rule_ids"),
        F.when(n % 3 == 0, F.array(name("c", n), name("c", n + 1))).when(n % 3 == 1, F.array(name("c", n))).otherwise(none).alias("courses"),
        F.when(n % 4 == 0, "knowledge_only").otherwise("teaching_ready").alias("availability"),
    )
    courses = brands.where("n % 8 < 7").select(name("c", n).alias("course"), F.when(n % 5 == 0, name("t", n + 40)).otherwise(name("t", n)).alias("technique"))
    return t, courses


@query(f"""WITH {_TECHNIQUES}, e AS (SELECT technique, 'prerequisites' AS f, unnest(prerequisites) AS t FROM tc UNION ALL SELECT technique, 'next', unnest(next) FROM tc), b AS (SELECT technique, unnest(courses) AS course FROM tc),
r AS (SELECT DISTINCT technique, unnest(rule_ids) AS r FROM tc)
SELECT technique AS key, 'unknown_system' AS violation, system AS what FROM tc WHERE system = 's3'
UNION ALL SELECT technique, 'unknown_rule_ids', r FROM r WHERE r = 'r4'
UNION ALL SELECT technique, 'leads_to_itself', f FROM e WHERE technique = t
UNION ALL SELECT technique, 'unknown_technique', t FROM e WHERE technique <> t AND t NOT IN (SELECT technique FROM tc)
UNION ALL SELECT e.technique, 'no_way_back', t FROM e WHERE f = 'next' AND technique <> t AND t IN (SELECT technique FROM tc) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.f = 'prerequisites' AND x.technique = e.t AND x.t = e.technique)
UNION ALL SELECT technique, 'unknown_course', course FROM b WHERE course NOT IN (SELECT course FROM cs)
UNION ALL SELECT b.technique, 'course_of_another', course FROM b JOIN cs USING (course) WHERE cs.technique <> b.technique
UNION ALL SELECT course, 'bound_more_than_once', CAST(count(*) AS VARCHAR) FROM b GROUP BY course HAVING count(*) > 1
UNION ALL SELECT technique, 'ready_without_course', NULL FROM tc WHERE availability = 'teaching_ready' AND len(courses) = 0
UNION ALL SELECT technique, 'media_without_review', NULL FROM tc WHERE availability = 'knowledge_only' AND len(courses) > 0
UNION ALL SELECT course, 'course_without_technique', technique FROM cs WHERE technique NOT IN (SELECT technique FROM tc)
UNION ALL SELECT course, 'course_not_bound', technique FROM cs WHERE technique IN (SELECT technique FROM tc) AND NOT EXISTS (SELECT 1 FROM b WHERE b.course = cs.course AND b.technique = cs.technique)""")
def graph_rules(spark, sf_dir):
    """All rules of the graph of techniques as one table of violations."""
    t, courses = _techniques(spark, sf_dir)
    known = lambda c, ids: spark.createDataFrame([(x,) for x in ids], f"{c} string")
    return C.graph_violations(t, courses, known("system", ["s0", "s1", "s2"]), {"rule_ids": known("id", ["r0", "r1", "r2", "r3"])})


#: Sources are parts; their topic is a type with a digit of the size; its parent a technique by topic, or by system.
_TOPICS = f"""{_TECHNIQUES}, src AS (SELECT 'p' || p_partkey AS source, p_type || ' ' || p_size % 10 AS topic, p_type AS system FROM part),
sy AS (SELECT system, 't' || (row_number() OVER (ORDER BY system) * 5) AS technique FROM (SELECT DISTINCT system FROM src)),
tp AS (SELECT DISTINCT topic, system FROM src), pn AS (SELECT topic, tp.system, CASE WHEN topic LIKE '% 3' THEN 't4' WHEN topic LIKE '% 4' THEN 't99' ELSE technique END AS wanted FROM tp JOIN sy USING (system)),
pr AS (SELECT pn.topic, pn.system, wanted, technique, prerequisites, next, rule_ids FROM pn LEFT JOIN tc ON technique = wanted),
ls AS (SELECT 'l' || p_partkey AS lesson, 'p' || p_partkey AS source, p_type || ' ' || (CASE WHEN p_partkey % 14 = 0 THEN (p_size + 1) % 10 WHEN p_partkey % 35 = 0 THEN 11 ELSE p_size % 10 END) AS topic FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'lost', 'p0', 'no topic'),
co AS (SELECT 'p' || p_partkey AS source, 't' || (p_partkey % 30) AS technique, 'k' || p_partkey % 100 AS course FROM part WHERE p_partkey % 3 = 0)"""


def _curriculum(spark, sf_dir):
    from pyspark.sql import Window

    t, _ = _techniques(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey"), lambda x, c: F.concat(F.lit(x), c.cast("string"))
    topic = lambda digit: F.concat_ws(" ", "p_type", digit.cast("string"))
    sources = p.select(name("p", key).alias("source"), topic(F.col("p_size") % 10).alias("topic"), F.col("p_type").alias("system"))
    by_system = p.select(F.col("p_type").alias("system")).distinct().select("system", name("t", F.row_number().over(Window.orderBy("system")) * 5).alias("technique"))
    named = sources.select("topic").distinct()
    by_topic = named.where("topic LIKE '% 3' OR topic LIKE '% 4'").select("topic", F.when(F.col("topic").like("% 3"), "t4").otherwise("t99").alias("technique"))
    digit = F.when(key % 14 == 0, (F.col("p_size") + 1) % 10).when(key % 35 == 0, 11).otherwise(F.col("p_size") % 10)
    lessons = p.where("p_partkey % 7 = 0").select(name("l", key).alias("lesson"), name("p", key).alias("source"), topic(digit).alias("topic")).unionByName(spark.createDataFrame([("lost", "p0", "no topic")], "lesson string, source string, topic string"))
    courses = p.where("p_partkey % 3 = 0").select(name("p", key).alias("source"), name("t", key % 30).alias("technique"), name("k", key % 100).alias("course"))
    return sources, by_topic, by_system, t.select("technique", "prerequisites", "next", "rule_ids"), courses, lessons


@query(f"""WITH {_TOPICS}, s AS (SELECT topic, count(DISTINCT source) AS n FROM src GROUP BY 1), c AS (SELECT pr.topic, string_agg(DISTINCT course, ',' ORDER BY course) AS courses FROM pr JOIN src USING (topic) JOIN co ON co.source = src.source AND co.technique = pr.technique GROUP BY 1),
l AS (SELECT topic, count(DISTINCT lesson) AS n FROM ls JOIN src USING (topic, source) GROUP BY 1),
ne AS (SELECT a.topic, string_agg(DISTINCT b.topic, ',' ORDER BY b.topic) AS near FROM (SELECT topic, unnest(next) AS t FROM pr) a JOIN pr b ON b.technique = a.t GROUP BY 1),
pe AS (SELECT a.topic, string_agg(DISTINCT b.topic, ',' ORDER BY b.topic) AS near FROM (SELECT topic, unnest(prerequisites) AS t FROM pr) a JOIN pr b ON b.technique = a.t GROUP BY 1)
SELECT pr.topic, pr.system, s.n AS n_sources, technique AS parent, CASE WHEN technique IS NULL THEN 'source_context_only' ELSE 'parent_curriculum_bound' END AS knowledge, CASE WHEN l.n IS NULL THEN 'no_reliable_topic_bound_media' ELSE 'teaching_ready' END AS media, coalesce(l.n, 0) AS n_lessons, coalesce(array_to_string(rule_ids, ','), '') AS rule_ids, coalesce(courses_.courses, '') AS courses, coalesce(ne.near, '') AS next_topics, coalesce(pe.near, '') AS prerequisite_topics
FROM pr JOIN s USING (topic) LEFT JOIN c courses_ ON courses_.topic = pr.topic LEFT JOIN l ON l.topic = pr.topic LEFT JOIN ne ON ne.topic = pr.topic LEFT JOIN pe ON pe.topic = pr.topic""")
def topic_unit_rows(spark, sf_dir):
    """A unit for each topic, with what it inherits from its parent and what is bound to it."""
    u = C.topic_units(*_curriculum(spark, sf_dir), ["rule_ids"])
    text = lambda c, name: F.array_join(c, ",").alias(name)
    return u.select("topic", "system", F.size("sources").cast("long").alias("n_sources"), "parent", "knowledge", "media", F.size("lessons").cast("long").alias("n_lessons"), text("rule_ids", "rule_ids"), text("courses", "courses"), text("next_topics", "next_topics"), text("prerequisites_topics", "prerequisite_topics"))


@query(f"""WITH {_TOPICS} SELECT topic AS key, 'unknown_parent:' || wanted AS violation FROM pr WHERE wanted IS NOT NULL AND technique IS NULL
UNION ALL SELECT lesson, 'unknown_topic:' || topic FROM ls WHERE topic NOT IN (SELECT topic FROM src)
UNION ALL SELECT lesson, 'unknown_source:' || source FROM ls WHERE source NOT IN (SELECT source FROM src)
UNION ALL SELECT lesson, 'lesson_of_another_topic' FROM ls WHERE topic IN (SELECT topic FROM src) AND source IN (SELECT source FROM src) AND NOT EXISTS (SELECT 1 FROM src WHERE src.topic = ls.topic AND src.source = ls.source)""")
def unresolved_bindings(spark, sf_dir):
    """What the units' links name and is not there."""
    sources, by_topic, by_system, t, _, lessons = _curriculum(spark, sf_dir)
    return C.unresolved(sources, by_topic, by_system, t, lessons)
