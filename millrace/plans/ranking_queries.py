"""Queries on rankings with contractual ties, samples and greedy picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from .registry import query, table


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_size, p_partkey DESC LIMIT 25""")
def topk_ties(spark, sf_dir):
    return R.top_rows(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_size"), F.desc("p_partkey")], 25).select("p_partkey", "p_retailprice")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderpriority, o_orderkey, CAST(n AS BIGINT) AS rank FROM r WHERE n <= 10""")
def topk_per_group(spark, sf_dir):
    r = R.ranked(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return r.where("rank <= 10").select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS a FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM b WHERE a = 1) SELECT lang, source, doc_id FROM c WHERE n <= 3""")
def one_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return R.one_per_source(d, ["lang"], "source", [F.desc("n_chars"), F.asc("doc_id")], 3).select("lang", "source", "doc_id")


@query("""WITH j AS (SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), m AS (SELECT *, max(CASE WHEN coalesce(quality = 1, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source, lang) AS x FROM j) SELECT doc_id FROM m WHERE x = 0 OR coalesce(quality = 1, false)""")
def tier_fallback(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.preferred_tier(j, ["source", "lang"], F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS f FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN f = 1 THEN 0 ELSE 1 END, l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM a) SELECT l_suppkey, l_orderkey, l_linenumber FROM b WHERE n <= 5""")
def fill_to_cap(spark, sf_dir):
    best = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return R.fill_to_cap(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", best, 5).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""WITH k AS (SELECT p_partkey, p_brand, sha256(CAST(p_partkey AS VARCHAR)) AS h, count(*) OVER (PARTITION BY p_brand) AS c FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS n FROM k) SELECT p_partkey, p_brand FROM r WHERE n <= least(c, greatest(10, ceil(c * 0.2)))""")
def stratified_sha_sample(spark, sf_dir):
    return R.stratified_sample(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_partkey")).select("p_partkey", "p_brand")


@query("""SELECT o_orderkey, o_orderkey % 8 AS shard FROM orders""")
def modulo_shard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", R.shard_of(F.col("o_orderkey"), 8).alias("shard"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE n = 1""")
def argmax_first_position(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.best_per_group(l, ["l_orderkey"], [-F.col("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT user_id, event_type AS drill, min(event_id) AS id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM f) SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS picked FROM r WHERE n <= 2 GROUP BY 1""")
def next_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_id").alias("id"), F.col("event_type").alias("drill"))
    first = e.groupBy("user_id", "drill").agg(F.min("seq").alias("seq")).withColumn("id", F.col("seq"))  # later ones of a drill are never picked
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "drill"))).alias("items"))
    return g.select("user_id", F.array_join(R.greedy_next(F.col("items"), 2), ",").alias("picked"))


@query("""WITH p(p_type, place) AS (VALUES ('PROMO', 0), ('SMALL', 1)), w AS (SELECT DISTINCT p_brand, string_split(p_type, ' ')[1] AS t FROM part), r AS (SELECT p_brand, t, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(place, 2147483647), t) AS n FROM w LEFT JOIN p ON p.p_type = t) SELECT p_brand, t AS word, CAST(n AS BIGINT) AS rank FROM r WHERE n <= 3""")
def preference_order(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_brand", F.get(F.split("p_type", " "), F.lit(0)).alias("word")).distinct()
    pref = spark.createDataFrame([("PROMO", 0), ("SMALL", 1)], "word string, place int")
    return R.by_preference(w, ["p_brand"], "word", pref, 3).select("p_brand", "word", F.col("rank").cast("long").alias("rank"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM x) SELECT vec_id, CAST(i AS BIGINT) AS peak FROM r WHERE n = 1""")
def signal_peak(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", R.best_position(F.col("embedding")).cast("long").alias("peak"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM x), p AS (SELECT vec_id, i AS i1 FROM a WHERE n = 1),
b AS (SELECT x.vec_id, i1, i, row_number() OVER (PARTITION BY x.vec_id ORDER BY v DESC, i) AS n FROM x JOIN p USING (vec_id) WHERE abs(i - i1) > 3), q AS (SELECT vec_id, i1, i AS i2 FROM b WHERE n = 1),
c AS (SELECT x.vec_id, i, row_number() OVER (PARTITION BY x.vec_id ORDER BY v DESC, i) AS n FROM x JOIN q USING (vec_id) WHERE abs(i - i1) > 3 AND abs(i - i2) > 3)
SELECT vec_id, i1 || ',' || i2 || ',' || i AS peaks FROM q JOIN (SELECT vec_id, i FROM c WHERE n = 1) USING (vec_id)""")
def peak_decode(spark, sf_dir):
    """Up to three peaks of a signal, none within three places of a higher one."""
    e = table(spark, sf_dir, "embeddings")
    cells = F.transform("embedding", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    item = "array<struct<v:float,i:int>>"
    kept = F.aggregate(F.array_sort(cells), F.array().cast(item), lambda acc, x: F.when((F.size(acc) < 3) & F.forall(acc, lambda y: F.abs(x["i"] - y["i"]) > 3), F.concat(acc, F.array(x))).otherwise(acc))
    return e.select("vec_id", F.array_join(F.transform(kept, lambda x: x["i"]), ",").alias("peaks"))
