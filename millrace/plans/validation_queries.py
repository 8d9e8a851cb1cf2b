"""Queries on violation reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .registry import query, table


@query("""SELECT l_orderkey * 10 + l_linenumber AS key, 'late_ship' AS violation FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01' UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'discount_range' FROM lineitem WHERE NOT (l_discount BETWEEN 0.0 AND 0.09) UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'flag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') OR (l_returnflag = 'R' AND l_linestatus <> 'F')""")
def record_violations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return V.violations(l, "key", [("late_ship", F.col("l_shipdate") <= F.lit("1998-06-01").cast("timestamp_ntz")), ("discount_range", F.col("l_discount").between(0.0, 0.09)), ("flag", F.col("l_returnflag").isin("A", "N", "R") & ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F")))])


@query("""SELECT DISTINCT l_partkey AS key, 'unknown_part' AS violation FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) UNION ALL SELECT DISTINCT o_custkey, 'unknown_customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)""")
def referential_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = V.dangling(t("lineitem").select("l_partkey", F.col("l_partkey").alias("key")).distinct(), "key", "l_partkey", t("part").where("p_size < 45"), "p_partkey", "unknown_part")
    b = V.dangling(t("orders").select("o_custkey", F.col("o_custkey").alias("key")).distinct(), "key", "o_custkey", t("customer").where("c_acctbal > -500"), "c_custkey", "unknown_customer")
    return V.union_all([a, b])


@query("""SELECT text AS key, 'duplicate_text' AS violation FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_key_report(spark, sf_dir):
    return V.duplicate_keys(table(spark, sf_dir, "documents"), "text", "duplicate_text")


@query("""WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation)
SELECT *, 'only_left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'only_right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def staleness_check(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return V.same_rows(a, a.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 6 == 0, 9).otherwise(F.col("n_regionkey"))))


@query("""WITH q AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem), p AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 48)
SELECT q.l_suppkey, count(*) AS required, count(*) FILTER (WHERE p.l_suppkey IS NULL) AS lacking, CASE WHEN count(*) FILTER (WHERE p.l_suppkey IS NULL) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM q LEFT JOIN p ON q.l_suppkey = p.l_suppkey AND q.l_returnflag = p.l_returnflag GROUP BY 1""")
def closure_audit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return V.closure(l, l.where("l_quantity > 48"), "l_suppkey", "l_returnflag")


@query("""SELECT o_orderkey AS key, 'line_count' AS violation FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(DISTINCT l_linenumber) AS d FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE NOT (n BETWEEN 3 AND 7 AND n = d)""")
def export_preconditions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return V.violations(o, "o_orderkey", [("line_count", F.coalesce(F.col("n"), F.lit(0)).between(3, 7) & (F.col("n") == F.col("d")))])


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'missing' WHEN count(*) FILTER (WHERE l_linestatus = 'O') = 0 THEN 'ready' WHEN count(*) FILTER (WHERE l_linestatus = 'F') = 0 THEN 'planned' ELSE 'partial' END AS state FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT state, count(*) AS n FROM s GROUP BY 1""")
def inventory_states(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    s = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("o").isNull(), "missing").when(F.col("o") == 0, "ready").when(F.col("f") == 0, "planned").otherwise("partial")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '([0-9]{3,})', 1) AS bv FROM pages), d AS (SELECT bv FROM p WHERE bv <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CASE WHEN p.bv = '' THEN 'no_id' WHEN d.bv IS NOT NULL THEN 'repeated' ELSE 'ok' END AS status FROM p LEFT JOIN d ON p.bv = d.bv""")
def catalogue_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([0-9]{3,})", 1).alias("bv"))
    d = p.where("bv <> ''").groupBy("bv").agg(F.count("*").alias("n")).where("n > 1")
    return p.join(d, "bv", "left").select("page_id", F.when(F.col("bv") == "", "no_id").when(F.col("n").isNotNull(), "repeated").otherwise("ok").alias("status"))


@query("""SELECT DISTINCT source AS key, 'no_english' AS violation FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND contains(lower(text), 'license'))""")
def contract_phrases(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    have = d.where((F.col("lang") == "en") & F.lower("text").contains("license"))
    return V.dangling(d.select("source", F.col("source").alias("key")).distinct(), "key", "source", have, "source", "no_english")


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber % 6) AS d, count(*) FILTER (WHERE l_quantity NOT BETWEEN 2 AND 49) AS o FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(o, 0) AS o, abs(47 - (46 + (o_orderkey % 4) * 0.5e0)) AS off FROM orders LEFT JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderkey, 'keyframe_count' AS violation FROM p WHERE n <> 7 UNION ALL SELECT o_orderkey, 'keyframe_names' FROM p WHERE d <> n UNION ALL SELECT o_orderkey, 'outside_window' FROM p WHERE o > 0 UNION ALL SELECT o_orderkey, 'duration' FROM p WHERE off > 0.25""")
def keyframe_checks(spark, sf_dir):
    """Orders as packages of keyframes: seven, uniquely named, in the window, of the stated duration."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(2.0).alias("start"), F.lit(49.0).alias("end"), (46 + (F.col("o_orderkey") % 4) * 0.5).alias("duration"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 6).alias("name"), F.col("l_quantity").alias("at"))
    return V.keyframe_checks(o, f, "o_orderkey").withColumnRenamed("key", "o_orderkey")


@query("""SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN 'cached ' || p_name ELSE p_name END AS title FROM part""")
def refresh_keeps_cached(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    cached = p.where("p_size < 20").select("id", F.concat(F.lit("cached "), F.col("title")).alias("title"))
    return V.refreshed(p.select("id", "title"), cached, "id")
