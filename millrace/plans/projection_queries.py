"""Queries on projections, predicates, links and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.writers import compact, drop_private, report_lines
from .registry import query, table

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT event_id, {_K} AS k, CAST(json_extract_string(props, '$.a.b') AS BIGINT) AS deep FROM events")
def json_path_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.path_get("props", "k", "long").alias("k"), X.path_get("props", "a.b", "long").alias("deep"))


@query(f"""SELECT event_id, CAST(json_object('k', {_K}, 'meta', json_object('type', event_type, 'seen', json_object('n', {_K} * 2))) AS VARCHAR) AS doc FROM events""")
def json_path_set(spark, sf_dir):
    k = X.path_get("props", "k", "long")
    return table(spark, sf_dir, "events").select("event_id", X.path_set({"k": k, "meta.type": F.col("event_type"), "meta.seen.n": k * 2}).alias("doc"))


@query(f"""WITH o AS (SELECT event_id, {_K} AS k, event_type AS t FROM events)
SELECT event_id, (k % 5 = 0) OR coalesce(t IN ('', 'missing', 'unknown', 'not_visible'), true) AS type_missing, (k % 7 = 0) OR k % 4 = 0 AS nested_missing FROM o""")
def missing_predicate(spark, sf_dir):
    k = X.path_get("props", "k", "long")
    declared = F.concat(F.when(k % 5 == 0, F.array(F.lit("type"))).otherwise(F.array().cast("array<string>")), F.when(k % 7 == 0, F.array(F.lit("foot"))).otherwise(F.array().cast("array<string>")))
    nested = F.when(k % 4 == 0, "not_visible").otherwise("seen")
    return table(spark, sf_dir, "events").select("event_id", X.is_missing(F.col("event_type"), declared, "type").alias("type_missing"), X.is_missing(nested, declared, "foot.step").alias("nested_missing"))


@query(f"""WITH o AS (SELECT event_id, {_K} AS k, event_type AS t FROM events)
SELECT event_id, CASE WHEN k % 2 = 0 THEN t = 'click' ELSE t IN ('view', 'error') END AS ok FROM o""")
def condition_eval(spark, sf_dir):
    k = X.path_get("props", "k", "long")
    op = F.when(k % 2 == 0, "equals").otherwise("in")
    values = F.when(k % 2 == 0, F.array(F.lit("click"))).otherwise(F.array(F.lit("view"), F.lit("error")))
    return table(spark, sf_dir, "events").select("event_id", X.holds(F.col("event_type"), op, values).alias("ok"))


@query(f"""WITH p AS (SELECT event_id, 'event_type' AS path, event_type AS v FROM events UNION ALL SELECT event_id, 'k_mod', CAST({_K} % 10 AS VARCHAR) FROM events)
SELECT event_id, path, v AS value FROM p WHERE (path, v) IN (('event_type', 'click'), ('event_type', 'purchase'), ('k_mod', '3'))""")
def observation_whitelist(spark, sf_dir):
    k = X.path_get("props", "k", "long")
    pairs = F.array(F.struct(F.lit("event_type").alias("path"), F.col("event_type").alias("value")), F.struct(F.lit("k_mod").alias("path"), (k % 10).cast("string").alias("value")))
    vocabulary = spark.createDataFrame([("event_type", "click"), ("event_type", "purchase"), ("k_mod", "3")], "path string, value string")
    return table(spark, sf_dir, "events").select("event_id", F.inline(pairs)).join(F.broadcast(vocabulary), ["path", "value"], "left_semi")


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name), '(1|contact|racket)')")
def safe_path_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(X.safe_path(F.col("p_name"), ["1", "contact", "racket"])).select("p_partkey", "p_name")


@query("""SELECT c_custkey, lower(c_mktsegment) AS segment, 'c/' || CAST(c_custkey AS VARCHAR) AS link, CASE WHEN c_acctbal >= 0 THEN 'public' ELSE 'review' END AS shown FROM customer""")
def public_projection(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shown = c.withColumns({"segment": F.lower("c_mktsegment"), "link": F.format_string("c/%d", "c_custkey"), "shown": F.when(F.col("c_acctbal") >= 0, "public").otherwise("review")})
    return drop_private(shown, ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL""")
def gate_admit(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_totalprice") >= 100000) & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isNotNull()).select("o_orderkey")


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN NOT coalesce(l.quality = 1, false) THEN 'low_quality' END, CASE WHEN NOT coalesce(l.toxic = 0, false) THEN 'toxic' END, CASE WHEN NOT d.n_chars >= 500 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def gate_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    r = X.reasons([("unlabelled", F.col("there")), ("low_quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 0), ("short", F.col("n_chars") >= 500)])
    return d.select("doc_id", F.array_join(r, ",").alias("reasons"))


@query("""SELECT d.doc_id, CASE WHEN coalesce(l.quality = 1, false) THEN 'complete' ELSE 'partial' END AS status, CASE WHEN coalesce(l.quality = 1, false) THEN '' ELSE 'no_proof' END AS limitation FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def declared_downgrade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    proof = F.coalesce(F.col("quality") == 1, F.lit(False))
    return d.select("doc_id", F.when(proof, "complete").otherwise("partial").alias("status"), F.when(proof, "").otherwise("no_proof").alias("limitation"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])t=[^&]*(&|$)', '\\1'), '[?&]$', '') || CASE WHEN contains(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])t=[^&]*(&|$)', '\\1'), '[?&]$', ''), '?') THEN '&t=' ELSE '#t=' END || CAST(page_id % 90 AS VARCHAR) AS link FROM pages""")
def url_timestamp_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.link_at(F.col("url"), (F.col("page_id") % 90).cast("string")).alias("link"))


@query("""SELECT page_id, CAST(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM pages""")
def url_id_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_number(F.col("url")).alias("number"))


@query("""SELECT doc_id, contains(text, 'token = ') AS has_token, regexp_matches(text, '(licensed|copyright|apache)', 'i') AS has_license FROM documents WHERE contains(text, 'token = ') OR regexp_matches(text, '(licensed|copyright|apache)', 'i')""")
def marker_leak_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").contains("token = ").alias("has_token"), F.col("text").rlike("(?iu)(licensed|copyright|apache)").alias("has_license"))
    return d.where("has_token OR has_license")


@query(f"""WITH o AS (SELECT event_id, value, {_K} AS k FROM events) SELECT event_id, CASE WHEN value < 50 THEN 'no_object' WHEN value < 60 THEN 'wrong_keys' WHEN k >= 80 THEN 'out_of_range' ELSE 'ok' END AS status, CASE WHEN value >= 60 AND k < 80 THEN k END AS k FROM o""")
def bounded_json_object(spark, sf_dir):
    """The object between the first { and the last } of a text, with exactly the wanted keys and a value in range."""
    v = F.col("value")
    raw = F.when(v < 50, F.lit("none")).when(v < 60, F.concat(F.lit("note: "), F.regexp_replace("props", '"k"', '"other"'), F.lit(" end"))).otherwise(F.concat(F.lit("note: "), F.col("props"), F.lit(" end")))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    first, last = F.locate("{", F.col("raw")), F.length("raw") - F.locate("}", F.reverse("raw")) + 1
    e = e.select("event_id", F.when((first > 0) & (last > first), F.substring("raw", first, last - first + 1)).alias("body"))
    k = X.path_get("body", "k", "long")
    status = F.when(F.col("body").isNull(), "no_object").when(~F.coalesce(F.array_sort(F.json_object_keys("body")) == F.array(F.lit("k")), F.lit(False)), "wrong_keys").when(~F.coalesce(k < 80, F.lit(False)), "out_of_range").otherwise("ok")
    return e.select("event_id", status.alias("status"), F.when(status == "ok", k).alias("k"))


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') AND lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 5""")
def page_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")) & (F.col("lang") == "en"))
    return d.orderBy("doc_id").select("doc_id", "source").offset(5).limit(20)


@query("""SELECT event_id, greatest(0, CAST(value * 10 AS BIGINT) - 400) AS s, greatest(0, CAST(value * 10 AS BIGINT) - 400) + 800 AS e, lower('EV') || '-clip-' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS ref FROM events""".replace("CAST(value * 10 AS BIGINT)", "CAST(floor(value * 10) AS BIGINT)"))
def fixed_window(spark, sf_dir):
    ms = F.floor(F.col("value") * 10)
    s, e = X.window_around(ms)
    return table(spark, sf_dir, "events").select("event_id", s.alias("s"), e.alias("e"), X.reference_id(F.lit("EV"), "clip", ms).alias("ref"))


@query("""SELECT p_partkey, list_transform(regexp_extract_all(p_name || ' 12 reps 3', '([0-9]+)'), lambda x: CAST(x AS BIGINT))[1] AS first_number, CAST(len(regexp_extract_all(p_name || ' 12 reps 3', '([0-9]+)')) AS BIGINT) AS n_numbers FROM part""")
def retest_numbers(spark, sf_dir):
    n = X.integers(F.concat(F.col("p_name"), F.lit(" 12 reps 3")))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(n, F.lit(0)).alias("first_number"), F.size(n).cast("long").alias("n_numbers"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, count(value) AS m, sum(TRY_CAST(value AS DECIMAL(28, 6))) AS s, count(TRY_CAST(value AS DECIMAL(28, 6))) AS exact, avg(value) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type, n, CASE WHEN exact < m THEN CASE WHEN v >= 60 THEN 'high' WHEN v >= 45 THEN 'medium' ELSE 'low' END WHEN s >= 60 * m THEN 'high' WHEN s >= 45 * m THEN 'medium' ELSE 'low' END AS band FROM g""")
def confidence_band(spark, sf_dir):
    """The band of a group's mean value. The sum is exact, to a millionth of each value, as that of doubles depends on the
    order of the rows and may miss a cut that the mean reaches; a group with a value that is no such number has the mean of doubles."""
    e = table(spark, sf_dir, "events").withColumn("d", F.expr("try_cast(value AS DECIMAL(28, 6))"))
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count("value").alias("m"), F.sum("d").alias("s"), F.count("d").alias("exact"), F.avg("value").alias("v"))
    doubles, exact = (X.band(F.col(c), [(60 * times, "high"), (45 * times, "medium")], "low") for c, times in (("v", F.lit(1)), ("s", F.col("m"))))
    return g.select("user_id", "event_type", "n", F.when(F.col("exact") < F.col("m"), doubles).otherwise(exact).alias("band"))


@query("""SELECT page_id, CASE WHEN len(html) > 4000 AND contains(html, '</html>') THEN 'frame_and_clip' WHEN contains(html, '</html>') THEN 'frame_only' ELSE 'unavailable' END AS availability FROM pages""")
def availability(spark, sf_dir):
    whole = F.contains(F.col("html"), F.lit("</html>"))
    return table(spark, sf_dir, "pages").select("page_id", X.first_match([((F.char_length("html") > 4000) & whole, "frame_and_clip"), (whole, "frame_only")], "unavailable").alias("availability"))


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 4)
SELECT l_orderkey, array_to_string(list_filter(ids, lambda x: x NOT IN (1, 2)), ',') AS opponents FROM r""")
def role_assignment(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids")).where(F.size("ids") >= 4)
    return g.select("l_orderkey", F.array_join(F.array_except("ids", F.array(F.lit(1), F.lit(2))), ",").alias("opponents"))


@query("""SELECT event_id, m.label AS label FROM events LEFT JOIN (VALUES ('click', 'Clicked'), ('view', 'Viewed'), ('purchase', 'Bought'), ('error', 'Failed'), ('signup', 'Joined')) AS m(t, label) ON event_type = m.t""")
def learner_labels(spark, sf_dir):
    labels = {"click": "Clicked", "view": "Viewed", "purchase": "Bought", "error": "Failed", "signup": "Joined"}
    return table(spark, sf_dir, "events").select("event_id", X.label_of(labels, F.col("event_type")).alias("label"))


@query("""SELECT user_id, 'user ' || CAST(user_id AS VARCHAR) || chr(10) || 'events: ' || CAST(count(*) AS VARCHAR) || CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN chr(10) || 'errors: ' || CAST(count(*) FILTER (WHERE event_type = 'error') AS VARCHAR) ELSE '' END AS report FROM events GROUP BY user_id""")
def text_report(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    lines = F.array(F.concat(F.lit("user "), F.col("user_id")), F.concat(F.lit("events: "), F.col("n")), F.when(F.col("errors") > 0, F.concat(F.lit("errors: "), F.col("errors"))))
    rows = g.select("user_id", F.posexplode(lines).alias("at", "line")).where("line IS NOT NULL")
    return report_lines(rows, "user_id", "at", "line")


@query("""SELECT s_suppkey AS id, nullif(s_name, 'Supplier#000000001') AS label FROM supplier WHERE s_suppkey IS NOT NULL""")
def compact_assets(spark, sf_dir):
    """The compact form of an asset table for browsing."""
    s = table(spark, sf_dir, "supplier").withColumn("shown", F.nullif("s_name", F.lit("Supplier#000000001")))
    return compact(s, {"s_suppkey": "id", "shown": "label"})
