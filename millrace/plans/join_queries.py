"""Queries on joins by shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sets as S
from .registry import query, table


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM r JOIN part ON p_partkey = l_partkey WHERE p_size > 10)
SELECT o.l_orderkey, coalesce(string_agg(h.p_brand, ',' ORDER BY h.l_linenumber, h.l_partkey), '') AS brands FROM (SELECT DISTINCT l_orderkey FROM r) o LEFT JOIN h ON o.l_orderkey = h.l_orderkey GROUP BY 1""")
def lookup_in_order(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.looked_up(l, "l_orderkey", ["l_linenumber", "l_partkey"], part, "l_partkey", "p_brand").select("l_orderkey", F.array_join("found", ",").alias("brands"))


@query("""WITH v AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, coalesce(l_linestatus, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN v ON o_orderkey = l_orderkey AND n = 1""")
def lookup_left_override(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    reviews = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), "l_linenumber")
    return J.override(base, reviews, ["o_orderkey"], "o_orderstatus", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_allowlist(spark, sf_dir):
    allowed = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(allowed, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_unresolved(spark, sf_dir):
    return J.unresolved(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("""SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def equi_filtered(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("""SELECT DISTINCT p_partkey, s_suppkey FROM part, supplier WHERE p_partkey % 100 = s_suppkey % 100 AND p_size = 7 OR p_size = s_suppkey AND p_size > 40""")
def or_join_union(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") == 7, F.col("p_partkey") % 100).alias("a"), F.when(F.col("p_size") > 40, F.col("p_size").cast("long")).alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100).alias("x"), F.col("s_suppkey").alias("y"))
    return J.join_any(p, s, [("a", "x"), ("b", "y")], ("p_partkey", "s_suppkey"))


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type FROM part), b AS (SELECT DISTINCT p_size, p_type FROM part)
SELECT p_brand, p_size, count(*) AS shared FROM a JOIN b USING (p_type) GROUP BY ALL""")
def array_overlap_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.groupBy("p_brand").agg(F.collect_set("p_type").alias("ta"))
    b = p.groupBy("p_size").agg(F.collect_set("p_type").alias("tb"))
    return J.shared_items(a, b, [], ("p_brand", "p_size"), "item", ("ta", "tb"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey % 1000 AS a, l_partkey % 1000 AS b FROM lineitem)
SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)""")
def graph_reciprocal(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 1000).alias("a"), (F.col("l_partkey") % 1000).alias("b"))
    return J.missing_reverse(e, e, "a", "b")


@query("""SELECT l_suppkey, string_agg(DISTINCT CAST(l_partkey % 100 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 100 AS VARCHAR)) AS neighbours FROM lineitem GROUP BY 1""")
def graph_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).cast("string").alias("p"))
    return J.neighbours(e, "l_suppkey", "p").select("l_suppkey", F.array_join("neighbours", ",").alias("neighbours"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, c_custkey % 25 AS b FROM customer), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS steps UNION SELECT CAST(b AS BIGINT), steps + 1 FROM r JOIN e ON r.node = e.a WHERE steps < 3)
SELECT node, CAST(min(steps) AS BIGINT) AS steps FROM r GROUP BY node""")
def graph_reachable(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b")).distinct()
    start = table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("a"))
    return J.reachable(e, start, "a", "b", 3)


@query("""SELECT c_custkey, coalesce(o.v, n.n_name) AS title FROM customer c LEFT JOIN (SELECT o_custkey, 'order ' || CAST(max(o_orderkey) AS VARCHAR) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def override_chain(spark, sf_dir):
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m")).select("c_custkey", F.concat(F.lit("order "), F.col("m")).alias("title"))
    second = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("title"))
    return J.override_chain(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", first, "c_nationkey", second, "title").select("c_custkey", "title")


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000""")
def four_way_inner(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").where("o_totalprice > 200000")
    return o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT p_brand, min(p_partkey) AS first_part, count(*) AS parts, string_agg(p_type, '|' ORDER BY p_partkey) AS types FROM part GROUP BY 1""")
def group_merge(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("x"))
    return g.select("p_brand", "first_part", "parts", F.array_join(F.transform("x", lambda s: s["p_type"]), "|").alias("types"))


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def set_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("""WITH r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders)
SELECT o_orderkey, o_custkey FROM r EXCEPT ALL SELECT o_orderkey, o_custkey FROM s""")
def manifest_subset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = o.select("o_orderkey", F.when(F.col("o_orderkey") % 30 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return S.not_stored(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), stored)


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_intersect(f, ['A', 'R'])) AS BIGINT) AS score, len(list_filter(['N'], lambda x: NOT list_contains(f, x))) = 0 AS has_new, array_to_string(list_sort(list_distinct(f || ['Z'])), ',') AS joined FROM s""")
def set_scores(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return g.select("l_orderkey", S.shared_count(F.col("f"), lit("A", "R")).alias("score"), S.is_subset(lit("N"), F.col("f")).alias("has_new"), F.array_join(F.array_sort(S.first_seen_union(F.col("f"), lit("Z"))), ",").alias("joined"))


@query("""SELECT source, count(*) AS rows, count(DISTINCT text) AS kinds FROM documents GROUP BY 1 HAVING count(*) > count(DISTINCT text)""")
def exact_dup(spark, sf_dir):
    return A.duplicated_groups(table(spark, sf_dir, "documents"), ["source"], F.sha2("text", 256))


@query("""SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier""")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))
