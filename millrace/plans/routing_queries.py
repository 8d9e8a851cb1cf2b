"""Queries on routing by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as T
from ..operators.routing import Route
from .registry import query, table

_ROUTES = [Route("steel", "steel", 1), Route("brass", "brass|copper", 5), Route("promo", "^promo", 5), Route("small", "small", 3)]


def _case(col, hits):
    return " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') THEN '{i}'" for i, p in hits)


_ORDER = [("brass", "brass|copper"), ("promo", "^promo"), ("small", "small"), ("steel", "steel")]


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'tin', 'i') THEN NULL ELSE CASE {_case('p_type', _ORDER)} ELSE 'other' END END AS route FROM part")
def route_first_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.first_route(F.col("p_type"), _ROUTES, "other", "tin").alias("route"))


_LIST = ", ".join(f"CASE WHEN regexp_matches(p_type, '{p}', 'i') THEN '{i}' END" for i, p in _ORDER)


@query(f"WITH h AS (SELECT p_partkey, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS h FROM part) SELECT p_partkey, CASE WHEN len(h) > 0 THEN array_to_string(h[1:3], ',') ELSE 'general' END AS routes, CASE WHEN len(h) > 0 THEN h[1] ELSE 'general' END AS parent FROM h")
def route_top3(spark, sf_dir):
    r = T.top_routes(F.col("p_type"), _ROUTES, 3, "general")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(r, ",").alias("routes"), F.get(r, F.lit(0)).alias("parent"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'secret' WHEN contains(lower(text), 'idiot') THEN 'abuse' ELSE 'prose' END AS class FROM documents""")
def keyword_fallback(spark, sf_dir):
    groups = [("legal", ["license", "copyright"]), ("secret", ["token", "password"]), ("abuse", ["idiot"])]
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_class(F.col("text"), groups, "prose").alias("class"))


@query(f"WITH h AS (SELECT p_partkey, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS h FROM part) SELECT p_partkey, array_to_string(CASE WHEN list_has_any(h, ['brass', 'steel']) THEN list_filter(h, lambda x: x <> 'promo') ELSE h END, ',') AS routes FROM h WHERE len(h) > 0")
def specificity_suppress(spark, sf_dir):
    hits = T.top_routes(F.col("p_type"), _ROUTES, 9, "none")
    kept = T.more_specific(hits, {"promo": ["brass", "steel"]})
    return table(spark, sf_dir, "part").select("p_partkey", hits.alias("h"), F.array_join(kept, ",").alias("routes")).where(F.col("h")[0] != "none").drop("h")


@query("""SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'rush' WHEN '2-HIGH' THEN 'fast' END, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'running' END, 'rest') AS category FROM orders""")
def category_by_action(spark, sf_dir):
    c = T.category(F.col("o_orderpriority"), F.col("o_orderstatus"), {"1-URGENT": "rush", "2-HIGH": "fast"}, {"F": "closed", "O": "running"}, "rest")
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("category"))


@query("""SELECT event_id, round(least(value / 100 * 0.4 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 * 0.6 + CASE WHEN event_type = 'purchase' THEN 0.2 ELSE 0 END, 1.0), 6) AS score FROM events""")
def episode_score(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    s = T.capped_score([(F.col("value") / 100, 0.4), (k / 100, 0.6), (F.when(F.col("event_type") == "purchase", 1.0), 0.2)], 1.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(s, 6).alias("score"))


@query("""WITH w AS (SELECT p_brand, p_type || ' ' || CAST(p_size % 10 AS VARCHAR) AS topic, p_size > 25 AS system FROM part) SELECT topic, count(DISTINCT p_brand) AS sources, count(DISTINCT system) > 1 AS conflict FROM w GROUP BY 1""")
def topic_units(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_type", (F.col("p_size") % 10).cast("string")).alias("topic"), (F.col("p_size") > 25).alias("system"))
    return w.groupBy("topic").agg(F.count_distinct("p_brand").alias("sources"), (F.count_distinct("system") > 1).alias("conflict"))


@query("""WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80) SELECT s.user_id, string_agg(t.topic, ',' ORDER BY t.topic) AS topics FROM s JOIN (VALUES ('click', 'attention'), ('view', 'attention'), ('purchase', 'intent'), ('error', 'friction')) AS t(event_type, topic) USING (event_type) GROUP BY 1""")
def issue_topics(spark, sf_dir):
    topics = spark.createDataFrame([("click", "attention"), ("view", "attention"), ("purchase", "intent"), ("error", "friction")], "event_type string, topic string")
    s = table(spark, sf_dir, "events").where("value > 80").select("user_id", "event_type").distinct().join(F.broadcast(topics), "event_type")
    return s.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics"))


@query("""SELECT DISTINCT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' OR list_contains(string_split(p_type, ' '), 'TIN')""")
def topic_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where((F.col("p_brand") == "Brand#11") | F.array_contains(F.split("p_type", " "), "TIN")).select("p_partkey", "p_name")


_HIT = {i: f"regexp_matches(p_type, '{p}', 'i')" for i, p in _ORDER}
_SCOPED = ", ".join(f"CASE WHEN {h} AND list_contains(allowed, '{i}') THEN '{i}:title_scope' END" for i, h in _HIT.items())
_FREE = ", ".join(f"CASE WHEN {h} THEN '{i}:transcript' END" for i, h in _HIT.items())
_TAGGED = ", ".join(f"CASE WHEN list_contains(tags, '{i}') THEN '{i}:tag' END" for i in _HIT)


@query(f"""WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size % 3 = 0 THEN ['steel', 'small'] WHEN p_size % 3 = 1 THEN ['promo'] ELSE [] END AS allowed, CASE WHEN p_size > 25 THEN ['steel', 'none'] ELSE [] END AS tags FROM part),
h AS (SELECT p_partkey, list_filter(CASE WHEN len(allowed) > 0 THEN [{_SCOPED}] ELSE [{_FREE}] END, lambda x: x IS NOT NULL) AS h, list_filter([{_TAGGED}], lambda x: x IS NOT NULL) AS g FROM p)
SELECT p_partkey, array_to_string((CASE WHEN len(h) > 0 THEN h ELSE g END)[1:2], ',') AS routes FROM h""")
def transcript_routes(spark, sf_dir):
    """Routes of a text within the actions that its title allows, by the text alone, or by tags, with the basis."""
    lit = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    allowed = F.when(F.col("p_size") % 3 == 0, lit("steel", "small")).when(F.col("p_size") % 3 == 1, lit("promo")).otherwise(lit())
    r = T.scoped_routes(F.col("p_type"), allowed, F.when(F.col("p_size") > 25, lit("steel", "none")).otherwise(lit()), _ROUTES, 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(r, lambda x: F.concat(x["route"], F.lit(":"), x["basis"])), ",").alias("routes"))


@query("""SELECT p_brand || ' ' || p_type AS topic, string_agg(DISTINCT CAST(p_size // 26 AS VARCHAR), ',' ORDER BY CAST(p_size // 26 AS VARCHAR)) AS systems FROM part GROUP BY 1 HAVING count(DISTINCT p_size // 26) > 1""")
def topic_conflicts(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("topic"), F.floor(F.col("p_size") / 26).cast("string").alias("system"))
    return T.topic_conflicts(w, "topic", "system").select("topic", F.array_join("systems", ",").alias("systems"))
