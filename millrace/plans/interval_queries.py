"""Queries on intervals. An event is an interval of a tenth of its key seconds from its time on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import iou, micros, overlap, path_get
from ..operators import greedy as G
from ..operators import intervals as I
from ..operators.ranking import best_per_group
from .registry import query, table

#: Intervals of events in seconds since the first of January 2024.
_IV = "iv AS (SELECT event_id, user_id, event_type, value, CAST(epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS s, CAST(epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) + 600 * (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS e FROM events)"
_START = 1_704_067_200


def intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.floor(micros(F.col("ts")) / 1_000_000) - _START
    return e.select("event_id", "user_id", "event_type", "value", s.alias("s"), (s + 600 * (path_get("props", "k", "long") + 1)).alias("e"))


@query(f"""WITH {_IV.replace('CAST(epoch(ts) - epoch(', 'CAST(floor(epoch(ts)) - epoch(')} SELECT a.event_id AS a, b.event_id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS shared,
round((least(a.e, b.e) - greatest(a.s, b.s)) / CAST(greatest(a.e, b.e) - least(a.s, b.s) AS DOUBLE), 6) AS iou FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.e > a.s AND b.s < a.e""")
def interval_overlap(spark, sf_dir):
    i = intervals(spark, sf_dir)
    a = i.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("as"), F.col("e").alias("ae"))
    b = i.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"))
    j = I.overlap_join(a, b, ["user_id"], "as", "ae", "bs", "be", 30_000).where("a < b")
    return j.select("a", "b", overlap(F.col("as"), F.col("ae"), F.col("bs"), F.col("be")).alias("shared"), F.round(iou(F.col("as"), F.col("ae"), F.col("bs"), F.col("be")), 6).alias("iou"))


_IV = _IV.replace("CAST(epoch(ts) - epoch(", "CAST(floor(epoch(ts)) - epoch(")


@query(f"""WITH {_IV}, w AS (SELECT event_id, user_id, s, e FROM iv WHERE event_type = 'purchase'), p AS (SELECT event_id, user_id, s AS t FROM iv WHERE event_type = 'view')
SELECT w.event_id, string_agg(CAST(p.event_id AS VARCHAR), ',' ORDER BY p.t, p.event_id) AS views FROM w JOIN p ON w.user_id = p.user_id AND p.t BETWEEN w.s AND w.e GROUP BY 1""")
def interval_overlap_text(spark, sf_dir):
    i = intervals(spark, sf_dir)
    w = i.where("event_type = 'purchase'").select("event_id", "user_id", "s", "e")
    p = i.where("event_type = 'view'").select(F.col("event_id").alias("view"), "user_id", F.col("s").alias("t"))
    g = I.points_in(p, w, ["user_id"], "t", "s", "e", 30_000).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("t", "view"))).alias("x"))
    return g.select("event_id", F.array_join(F.transform("x", lambda s: s["view"]), ",").alias("views"))


@query(f"""WITH {_IV}, w AS (SELECT event_id, user_id, s, e FROM iv WHERE event_type = 'signup'), p AS (SELECT event_id AS pid, user_id, s AS t FROM iv WHERE event_type = 'error'),
h AS (SELECT w.event_id, p.pid, p.t BETWEEN w.s AND w.e AS inside, CASE WHEN p.t < w.s THEN w.s - p.t WHEN p.t > w.e THEN p.t - w.e ELSE 0 END AS d FROM w JOIN p USING (user_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, pid) AS n FROM h) SELECT event_id, pid, inside, d FROM r WHERE n = 1""")
def point_in_interval_fallback(spark, sf_dir):
    i = intervals(spark, sf_dir)
    w = i.where("event_type = 'signup'").select("event_id", "user_id", "s", "e")
    p = i.where("event_type = 'error'").select(F.col("event_id").alias("pid"), "user_id", F.col("s").alias("t"))
    return I.nearest_or_inside(w, p, ["user_id"], "event_id", "s", "e", "t", "pid", 30_000).select("event_id", "pid", "inside", "d")


@query(f"""WITH {_IV}, l AS (SELECT * FROM iv WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id, s AS rt FROM iv WHERE event_type = 'click'),
x AS (SELECT l.event_id, rid, abs(l.s - rt) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.s - rt), rt, rid) AS n FROM l JOIN r ON l.user_id = r.user_id AND abs(l.s - rt) <= 20000) SELECT event_id, rid, d FROM x WHERE n = 1""")
def nearest_asof(spark, sf_dir):
    i = intervals(spark, sf_dir)
    l = i.where("event_type = 'purchase'").select("event_id", "user_id", F.col("s").alias("lt"))
    r = i.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", F.col("s").alias("rt"))
    return I.nearest(l, r, ["user_id"], ["event_id"], "lt", "rt", 20_000, "rid").select("event_id", "rid", F.abs(F.col("lt") - F.col("rt")).alias("d"))


@query(f"""WITH {_IV} SELECT a.event_id AS a, b.event_id AS b FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND abs(a.s - b.s) <= 7200 AND b.value BETWEEN a.value - 20 AND a.value + 20""")
def band_join(spark, sf_dir):
    i = intervals(spark, sf_dir)
    a = i.where("event_type = 'error'").select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("at"), F.col("value").alias("av"))
    b = i.where("event_type = 'view'").select(F.col("event_id").alias("b"), "user_id", F.col("s").alias("bt"), F.col("value").alias("bv"))
    return I.band_join(a, b, ["user_id"], "at", "bt", 7200).where(F.col("bv").between(F.col("av") - 20, F.col("av") + 20)).select("a", "b")


@query(f"""WITH {_IV} SELECT a.user_id, a.s, a.event_id AS a, b.event_id AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY event_id DESC) AS n FROM iv WHERE event_type = 'click') a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY event_id DESC) AS n FROM iv WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.s // 86400 = b.s // 86400 AND a.n = 1 AND b.n = 1""")
def same_time_join(spark, sf_dir):
    i = intervals(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400))
    last = lambda kind: best_per_group(i.where(F.col("event_type") == kind), ["user_id", "day"], [F.col("event_id")], largest=True)
    a = last("click").select("user_id", "day", "s", F.col("event_id").alias("a"))
    return a.join(last("view").select("user_id", "day", F.col("event_id").alias("b")), ["user_id", "day"]).select("user_id", "s", "a", "b")


def _of_kind(spark, sf_dir, kind):
    return intervals(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", "value", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def _in_order(kept):
    """user_id and the kept ids in the order in which they were kept."""
    g = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda s: s["event_id"]), ",").alias("kept"))


@query(f"""WITH RECURSIVE {_IV}, x AS (SELECT user_id, event_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM iv WHERE event_type = 'view'),
g AS (SELECT user_id, n, [struct_pack(id := event_id, s := s, e := e)] AS kept FROM x WHERE n = 1
UNION ALL SELECT x.user_id, x.n, CASE WHEN len(g.kept) < 8 AND len(list_filter(g.kept, lambda k: greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) > 0.45e0 * least(x.e - x.s, k.e - k.s))) = 0 THEN list_append(g.kept, struct_pack(id := x.event_id, s := x.s, e := x.e)) ELSE g.kept END FROM g JOIN x ON x.user_id = g.user_id AND x.n = g.n + 1),
l AS (SELECT user_id, max(n) AS n FROM g GROUP BY 1) SELECT user_id, array_to_string(list_transform(kept, lambda k: k.id), ',') AS kept FROM g JOIN l USING (user_id, n)""")
def nms_overlap(spark, sf_dir):
    """Greedy suppression in the order of value."""
    return _in_order(G.suppress(_of_kind(spark, sf_dir, "view"), ["user_id"], [F.desc("value"), F.asc("event_id")], "s", "e", 0.45, 8))


@query(f"""WITH RECURSIVE {_IV}, x AS (SELECT user_id, event_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY e, event_id) AS n FROM iv WHERE event_type = 'click'),
g AS (SELECT user_id, n, CASE WHEN true THEN e END AS last, true AS taken, event_id FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, CASE WHEN x.s >= g.last THEN x.e ELSE g.last END, x.s >= g.last, x.event_id FROM g JOIN x ON x.user_id = g.user_id AND x.n = g.n + 1)
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS kept FROM g WHERE taken GROUP BY 1""")
def nonoverlap_greedy(spark, sf_dir):
    return _in_order(G.non_overlapping(_of_kind(spark, sf_dir, "click"), ["user_id"], [F.asc("e"), F.asc("event_id")], "s", "e"))


@query(f"""WITH RECURSIVE {_IV}, x AS (SELECT user_id, event_id, s, e, event_id % 2 AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM iv WHERE event_type = 'purchase'),
g AS (SELECT user_id, n, event_id, CAST(NULL AS BIGINT) AS dup, [struct_pack(id := event_id, s := s, e := e, a := action)] AS kept FROM x WHERE n = 1
UNION ALL SELECT user_id, n, event_id, hits[1].id, CASE WHEN len(hits) = 0 THEN list_append(kept, me) ELSE kept END
FROM (SELECT x.user_id, x.n, x.event_id, g.kept, struct_pack(id := x.event_id, s := x.s, e := x.e, a := x.action) AS me,
list_filter(g.kept, lambda k: k.a = x.action AND greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) / CAST((x.e - x.s) + (k.e - k.s) - greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) AS DOUBLE) >= 0.5e0) AS hits FROM g JOIN x ON x.user_id = g.user_id AND x.n = g.n + 1))
SELECT event_id, dup AS duplicate_of FROM g""")
def dup_mark_iou(spark, sf_dir):
    """Greedy duplicate marking among intervals of one action."""
    rows = _of_kind(spark, sf_dir, "purchase").withColumn("actions", F.array(F.col("event_id") % 2))
    marked = G.mark_duplicates(rows, ["user_id"], [F.asc("event_id")], "event_id", "s", "e", 0.5, "actions")
    return marked.select("event_id", F.nullif("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query(f"""WITH {_IV}, n AS (SELECT a.event_id, min(b.s) AS nxt FROM iv a LEFT JOIN iv b ON a.user_id = b.user_id AND b.s > a.e GROUP BY 1)
SELECT event_id, least(e + 3600, coalesce(nxt - 15, e + 3600)) AS clip_end FROM iv JOIN n USING (event_id)""")
def next_start_bound(spark, sf_dir):
    return I.next_start_end(intervals(spark, sf_dir), ["user_id"], "s", "e", 3600, 15).select("event_id", "clip_end")


@query(f"""WITH {_IV} SELECT event_id, greatest(0, s - 900) AS a, least(2678400, e + 900) AS b, (s >= 86400 AND 2678400 - e >= 86400) AS has_context FROM iv""")
def window_expand(spark, sf_dir):
    i = intervals(spark, sf_dir)
    return i.select("event_id", F.greatest(F.lit(0), F.col("s") - 900).alias("a"), F.least(F.lit(2_678_400), F.col("e") + 900).alias("b"), ((F.col("s") >= 86400) & (2_678_400 - F.col("e") >= 86400)).alias("has_context"))


@query(f"""WITH RECURSIVE {_IV}, x AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM (SELECT DISTINCT user_id, s FROM iv WHERE event_type = 'error')),
g AS (SELECT user_id, n, s AS last, true AS taken, s FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, CASE WHEN x.s - g.last >= 86400 THEN x.s ELSE g.last END, x.s - g.last >= 86400, x.s FROM g JOIN x ON x.user_id = g.user_id AND x.n = g.n + 1)
SELECT user_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS kept FROM g WHERE taken GROUP BY 1""")
def centre_suppress(spark, sf_dir):
    rows = intervals(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("s").cast("long").alias("s"))
    g = G.spaced(rows, ["user_id"], [F.asc("s")], "s", 86400).groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("x"))
    return g.select("user_id", F.array_join("x", ",").alias("kept"))


@query(f"""WITH RECURSIVE {_IV}, x AS (SELECT user_id, event_id, s, CAST(event_id % 7 AS INTEGER) AS media, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, s, event_id) AS n FROM iv),
g AS (SELECT user_id, n, [struct_pack(id := event_id, s := s, m := media)] AS kept FROM x WHERE n = 1
UNION ALL SELECT x.user_id, x.n, CASE WHEN len(list_filter(g.kept, lambda k: abs(k.s - x.s) < 7200 OR k.m = x.media)) = 0 THEN list_append(g.kept, struct_pack(id := x.event_id, s := x.s, m := x.media)) ELSE g.kept END FROM g JOIN x ON x.user_id = g.user_id AND x.n = g.n + 1),
l AS (SELECT user_id, max(n) AS n FROM g GROUP BY 1) SELECT user_id, array_to_string(list_transform(kept, lambda k: k.id), ',') AS kept FROM g JOIN l USING (user_id, n)""")
def distinct_frames(spark, sf_dir):
    """Frames in the order of their phase, of each media one, and none within two hours of a chosen one."""
    phase = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    rows = intervals(spark, sf_dir).select("user_id", "event_id", F.col("s").cast("long").alias("s"), (F.col("event_id") % 7).alias("media"), phase.alias("phase"))
    return _in_order(G.spaced(rows, ["user_id"], [F.asc("phase"), F.asc("s"), F.asc("event_id")], "s", 7200, "media"))


@query(f"""WITH {_IV} SELECT event_id, round(greatest(0, least(2678400, s + 0.55e0 * (e - s))) , 4) AS anchor, s % 3600 AS offset_in_hour FROM iv""")
def frame_anchor(spark, sf_dir):
    i = intervals(spark, sf_dir)
    return i.select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(2678400.0), F.col("s") + 0.55 * (F.col("e") - F.col("s")))), 4).alias("anchor"), (F.col("s") % 3600).alias("offset_in_hour"))


@query(f"""WITH {_IV}, w AS (SELECT event_id, user_id, s, e FROM iv WHERE event_type = 'purchase'), p AS (SELECT event_id AS pid, user_id, s AS t FROM iv WHERE event_type = 'view')
SELECT w.event_id, p.pid, p.t - w.s AS offset_s FROM w JOIN p ON w.user_id = p.user_id AND p.t BETWEEN w.s AND w.e""")
def clip_rebase(spark, sf_dir):
    """Times of points as offsets from the start of the clip that holds them."""
    i = intervals(spark, sf_dir)
    w = i.where("event_type = 'purchase'").select("event_id", "user_id", "s", "e")
    p = i.where("event_type = 'view'").select(F.col("event_id").alias("pid"), "user_id", F.col("s").alias("t"))
    return I.points_in(p, w, ["user_id"], "t", "s", "e", 30_000).select("event_id", "pid", (F.col("t") - F.col("s")).alias("offset_s"))
