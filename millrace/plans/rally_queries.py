"""Queries on tracks, boxes and paths; events stand for samples of four kinds in courts of a few users each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rally as R
from ..operators.ranking import best_per_group
from .registry import query
from .series_queries import _EV, events

_SLOT = 43_200_000_000  # half a day: two samples of one slot have one time
#: Samples: one a track and slot, of a court of eight tracks; the last of a slot counts.
_SAMPLES = f"""smp AS (SELECT user_id // 8 AS court, user_id AS track, t // {_SLOT} * 100 AS t, max_by(struct_pack(x := (k * 7 % 100) / 100e0, y := (event_id * 37 % 100) / 100e0), event_id) AS p FROM ev WHERE k IS NOT NULL GROUP BY ALL),
prs AS (SELECT DISTINCT a.court, a.track AS a, b.track AS b FROM smp a JOIN smp b ON a.court = b.court AND b.track = a.track + 1),
hit AS (SELECT court, a, b, x.t, ((x.p.x < 0.5e0) = (y.p.x < 0.5e0)) AND abs(x.p.x - y.p.x) <= 0.18e0 AND abs(x.p.y - y.p.y) <= 0.38e0 AS hit FROM prs JOIN smp x USING (court) JOIN smp y USING (court) WHERE x.track = a AND y.track = b AND x.t = y.t),
lnk AS (SELECT *, lag(hit) OVER w AS ph, lag(t) OVER w AS pt FROM hit WINDOW w AS (PARTITION BY court, a, b ORDER BY t)),
run AS (SELECT *, count(*) FILTER (WHERE NOT coalesce(ph, false) OR t - pt > 250) OVER (PARTITION BY court, a, b ORDER BY t) AS g FROM lnk),
spn AS (SELECT court, a, b, max(t) - min(t) AS span FROM run WHERE hit GROUP BY court, a, b, g),
cnf AS (SELECT court, a, b, count(h.t) AS shared, count(h.t) FILTER (WHERE hit) AS conflicts, coalesce((SELECT max(span) FROM spn s WHERE s.court = p.court AND s.a = p.a AND s.b = p.b), 0) AS longest FROM prs p LEFT JOIN hit h USING (court, a, b) GROUP BY ALL)"""


def _samples(spark, sf_dir):
    e = events(spark, sf_dir).where("k IS NOT NULL").select(F.expr("user_id div 8").alias("court"), F.col("user_id").alias("track"), (F.floor(F.col("t") / _SLOT) * 100).alias("t"), "event_id", F.expr("(k * 7 % 100) / 100D").alias("x"), F.expr("(event_id * 37 % 100) / 100D").alias("y"))
    return best_per_group(e, ["court", "track", "t"], [F.col("event_id")], largest=True)


def _pairs(samples):
    tracks = samples.select("court", "track").distinct()
    return tracks.select("court", F.col("track").alias("a")).join(tracks.select("court", F.col("track").alias("b"), (F.col("track") - 1).alias("a")), ["court", "a"])


@query(f"""WITH {_EV}, {_SAMPLES} SELECT a, b, shared, conflicts, CASE WHEN shared > 0 THEN round(conflicts / shared, 6) END AS ratio, CAST(longest AS BIGINT) AS longest FROM cnf""")
def pair_conflicts(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return R.pair_conflicts(s, _pairs(s), ["court"], "a", "b").select("a", "b", "shared", "conflicts", F.round("ratio", 6).alias("ratio"), "longest")


#: Paths and boxes of the same events: clicks and views are points of a court's path, others boxes around a player.
_MET = f"""pth AS (SELECT user_id // 8 AS court, event_id AS point, t // 1000 AS t, (k * 13 % 100) / 100e0 AS x, (event_id * 29 % 100) / 100e0 AS y, value / 100 AS confidence, event_type = 'view' AS interpolated FROM ev WHERE k IS NOT NULL AND event_type IN ('view', 'click')),
box AS (SELECT user_id // 8 AS court, user_id AS track, t // 1000 AS bt, (k % 70) / 100e0 AS bx, (event_id % 60) / 100e0 AS bby, 0.25e0 AS width, 0.375e0 AS height, value / 500 AS bconf FROM ev WHERE k IS NOT NULL AND event_type NOT IN ('view', 'click')),
tri AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(point) OVER w AS pp, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(point) OVER w AS np FROM pth WINDOW w AS (PARTITION BY court ORDER BY t, point)),
shp AS (SELECT * FROM tri WHERE pt IS NOT NULL AND nt IS NOT NULL AND acos(greatest(-1e0, least(1e0, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (greatest(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 1e-9) * greatest(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 1e-9))))) >= 1.15e0),
met AS (SELECT shp.*, track, bconf, (bx + width / 2 - x) * (bx + width / 2 - x) + (bby + height / 2 - y) * (bby + height / 2 - y) AS d FROM shp JOIN box USING (court) WHERE abs(t - bt) <= 7200000 AND x BETWEEN bx - 0.035e0 AND bx + width + 0.035e0 AND y BETWEEN bby - 0.035e0 AND bby + height + 0.035e0),
bst AS (SELECT court, point, track, min(struct_pack(d := d, c := -bconf)) AS b FROM met GROUP BY ALL),
rnk AS (SELECT court, point, list(track ORDER BY b.d, b.c, track) AS tracks FROM bst GROUP BY ALL),
con AS (SELECT court, 'contact-' || t || '-' || row_number() OVER (PARTITION BY court ORDER BY t, point) AS contact, (pt + t) // 2 AS a, (t + nt) // 2 AS b, t, [pp, point, np] AS points, tracks, CASE WHEN len(tracks) = 1 AND confidence >= 0.85e0 AND NOT interpolated THEN 'high' WHEN confidence >= 0.65e0 THEN 'medium' ELSE 'low' END AS level FROM rnk JOIN shp USING (court, point))"""


def _contacts(spark, sf_dir):
    e = events(spark, sf_dir).where("k IS NOT NULL").withColumn("court", F.expr("user_id div 8")).withColumn("ms", F.floor(F.col("t") / 1000))
    points = e.where("event_type IN ('view', 'click')").select("court", F.col("event_id").alias("point"), F.col("ms").alias("t"), F.expr("(k * 13 % 100) / 100D").alias("x"), F.expr("(event_id * 29 % 100) / 100D").alias("y"), (F.col("value") / 100).alias("confidence"), (F.col("event_type") == "view").alias("interpolated"))
    boxes = e.where("event_type NOT IN ('view', 'click')").select("court", F.col("user_id").alias("track"), F.col("ms").alias("bt"), F.expr("(k % 70) / 100D").alias("bx"), F.expr("(event_id % 60) / 100D").alias("by"), F.lit(0.25).alias("width"), F.lit(0.375).alias("height"), (F.col("value") / 500).alias("bconf"))
    return R.contact_candidates(points, boxes, ["court"], within=7_200_000)


@query(f"""WITH {_EV}, {_MET} SELECT court, contact, a AS start_ms, b AS end_ms, t AS anchor_ms, array_to_string(points, ',') AS points, array_to_string(tracks, ',') AS tracks, level FROM con""")
def contact_candidates(spark, sf_dir):
    """Sharp turns of a court's path inside a player's box within two hours, with the players ranked."""
    c = _contacts(spark, sf_dir)
    return c.select("court", "contact", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.col("anchor").alias("anchor_ms"), F.array_join("points", ",").alias("points"), F.array_join("tracks", ",").alias("tracks"), "level")


@query(f"""WITH {_EV}, {_SAMPLES}, {_MET},
rot AS (SELECT *, CASE WHEN shared = 0 THEN 'unknown' WHEN conflicts / shared >= 0.4e0 OR longest >= 500 THEN 'same_lane_conflict' ELSE 'two_lanes_available' END AS pair_rotation FROM cnf),
tch AS (SELECT r.court, r.a, r.b, count(*) AS contacts, bool_or(list_contains(tracks, r.a) AND list_contains(tracks, r.b)) AS both_ FROM rot r JOIN con c ON c.court = r.court AND (list_contains(tracks, r.a) OR list_contains(tracks, r.b)) GROUP BY ALL)
SELECT r.a, r.b, pair_rotation, coalesce(contacts, 0) AS contacts, CASE WHEN pair_rotation = 'same_lane_conflict' THEN 'unclear' WHEN contacts IS NULL THEN 'unknown' WHEN both_ THEN 'unclear' ELSE 'assigned' END AS next_shot_role FROM rot r LEFT JOIN tch USING (court, a, b)""")
def pair_roles(spark, sf_dir):
    """Roles of neighbouring tracks, from their conflicts and contacts."""
    s = _samples(spark, sf_dir)
    conflicts = R.pair_conflicts(s, _pairs(s), ["court"], "a", "b")
    return R.pair_roles(conflicts, _contacts(spark, sf_dir), ["court"], "a", "b").select("a", "b", "pair_rotation", "contacts", "next_shot_role")
