"""Queries on counts, roll-ups and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import query, table


@query("""SELECT 'o_orderstatus' AS dim, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""")
def count_by_dims(spark, sf_dir):
    return A.count_by_each(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"])


@query("""SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS BIGINT) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def ordered_count(spark, sf_dir):
    from pyspark.sql import Window

    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).cast("long"))


@query("""SELECT event_type, count(*) AS n, CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS BIGINT) AS place FROM events WHERE event_type IN ('purchase', 'refund', 'click', 'view') GROUP BY 1""")
def domain_count(spark, sf_dir):
    return A.domain_counts(table(spark, sf_dir, "events"), "event_type", ["purchase", "refund", "click", "view"])


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 25) AS large, count(*) FILTER (WHERE l_discount = 0) AS undiscounted, count(*) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    return A.conditional_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"large": F.col("l_quantity") >= 25, "undiscounted": F.col("l_discount") == 0, "taxed": F.col("l_tax") > 0.05})


@query("""SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, ['R', 'A', 'N'][min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)] AS state FROM lineitem GROUP BY 1""")
def state_rollup_priority(spark, sf_dir):
    return A.worst_child(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A", "N"])


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM f GROUP BY 1""")
def array_agg_ordered_distinct(spark, sf_dir):
    return A.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", F.array_join("list", ",").alias("types"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), '+' ORDER BY l_linenumber) AS ls FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || ls, ';' ORDER BY o_orderkey) AS tree FROM o GROUP BY 1""")
def nested_build(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.col("l_linenumber"))), "+").alias("ls"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "ls"))).alias("x"))
    return g.select("o_custkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["o_orderkey"], s["ls"])), ";").alias("tree"))


@query("""SELECT r.event_type, coalesce(round(avg(value), 6), 0) AS mean, count(value) AS n FROM (VALUES ('click'), ('refund'), ('view')) AS r(event_type) LEFT JOIN events e ON e.event_type = r.event_type GROUP BY 1""")
def role_means(spark, sf_dir):
    roles = spark.createDataFrame([("click",), ("refund",), ("view",)], "event_type string")
    m = A.null_safe_means(table(spark, sf_dir, "events"), roles, "event_type", "value")
    return m.select("event_type", F.round("mean", 6).alias("mean"), "n")


@query("""SELECT l_shipdate, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) AS n FROM lineitem GROUP BY 1""")
def conflict_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("ratio"), F.count("*").alias("n"))


@query("""SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) AS mean_cents FROM orders GROUP BY 1""")
def duration_stats(spark, sf_dir):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), (cents / F.count("*")).alias("mean_cents"))


@query("""SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def sorted_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part""")
def vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).distinct()


@query("""WITH c AS (SELECT DISTINCT source, text FROM documents) SELECT source, count(*) AS canonical, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY ROLLUP (source)""")
def canonical_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "text").distinct()
    return d.rollup("source").agg(F.count("*").alias("canonical"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("""SELECT count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(DISTINCT o_custkey) AS customers FROM orders""")
def batch_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("jobs"), F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("partial"), F.count_distinct("o_custkey").alias("customers"))
