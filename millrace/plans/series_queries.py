"""Queries on time series: the events of each user in order of time and event_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expressions import micros, path_get
from ..operators import geometry as G
from ..operators import intervals as I
from ..operators import series as S
from .registry import query, table

_EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_HOUR = 3_600_000_000


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("t"), path_get("props", "k", "long").alias("k"))


@query(f"""WITH {_EV}, p AS (SELECT *, lag(value) OVER w AS pv, lag(k) OVER w AS pk, lag(event_type) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN event_type <> 'error' AND pt <> 'error' THEN greatest(abs(value - pv), abs(k - pk)) ELSE 0 END, 4) AS motion FROM p""")
def motion_lag(spark, sf_dir):
    m = S.with_motion(events(spark, sf_dir).withColumn("k", F.col("k").cast("double")), ["user_id"], ["t", "event_id"], ["value", "k"], F.col("event_type") != "error")
    return m.select("event_id", F.round("motion", 4).alias("motion"))


@query(f"""WITH {_EV}, p AS (SELECT event_id, value - lag(value) OVER w AS ax, CAST(k - lag(k) OVER w AS DOUBLE) AS ay, lead(value) OVER w - value AS bx, CAST(lead(k) OVER w - k AS DOUBLE) AS bbb FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(acos(greatest(-1.0, least(1.0, (ax * bx + ay * bbb) / (greatest(1e-9, sqrt(ax * ax + ay * ay)) * greatest(1e-9, sqrt(bx * bx + bbb * bbb)))))), 4) AS angle FROM p WHERE ax IS NOT NULL AND bx IS NOT NULL""")
def turn_angle(spark, sf_dir):
    a = S.turn_angle(events(spark, sf_dir).withColumn("k", F.col("k").cast("double")), ["user_id"], ["t", "event_id"], "value", "k")
    return a.where("angle IS NOT NULL").select("event_id", F.round("angle", 4).alias("angle"))


@query(f"""WITH {_EV}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w > {6 * _HOUR} OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, sid) AS size FROM s)
SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY sid) AS BIGINT) AS session FROM c WHERE size >= 3""")
def sessions_gap(spark, sf_dir):
    return S.sessions(events(spark, sf_dir), ["user_id"], "t", "event_id", 6 * _HOUR, 3).select("event_id", "session")


@query(f"""WITH {_EV}, f AS (SELECT *, value >= 20 AS on_, lag(value >= 20) OVER w AS pon, t - lag(t) OVER w AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
n AS (SELECT *, CASE WHEN on_ AND (pon IS NULL OR NOT pon OR step > {24 * _HOUR}) THEN 1 ELSE 0 END AS new FROM f), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM n)
SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS rows FROM s WHERE on_ GROUP BY user_id, sid""")
def streak_islands(spark, sf_dir):
    return S.streaks(events(spark, sf_dir), ["user_id"], "t", "event_id", F.col("value") >= 20, 24 * _HOUR)


@query(f"""WITH {_EV}, d AS (SELECT user_id, t // {24 * _HOUR} AS frame, max(value) AS value, min(k) / 100.0 AS conf FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
n AS (SELECT *, lead(frame) OVER w AS nf, lead(value) OVER w AS nv, lead(conf) OVER w AS nc FROM d WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
g AS (SELECT *, unnest(range(1, CAST(nf - frame AS BIGINT))) AS i FROM n WHERE nf - frame - 1 BETWEEN 1 AND 2)
SELECT user_id, frame, round(value, 6) AS value, round(conf, 6) AS conf, false AS interpolated FROM d UNION ALL SELECT user_id, frame + i, round(value + (nv - value) * (i / CAST(nf - frame AS DOUBLE)), 6), round(least(conf, nc) * 0.5, 6), true FROM g""")
def gap_fill_linear(spark, sf_dir):
    d = events(spark, sf_dir).where("event_type = 'click'").groupBy("user_id", F.floor(F.col("t") / (24 * _HOUR)).alias("frame")).agg(F.max("value").alias("value"), (F.min("k") / 100.0).alias("conf"))
    g = S.fill_gaps(d, ["user_id"], "frame", "value", "conf")
    return g.select("user_id", "frame", F.round("value", 6).alias("value"), F.round("conf", 6).alias("conf"), "interpolated")


@query(f"""WITH {_EV}, a AS (SELECT event_id, avg(value) OVER s AS short, count(*) OVER s AS ns, avg(value) OVER l AS long, count(*) OVER l AS nl FROM ev WINDOW s AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), l AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT event_id, round(CASE WHEN ns = 3 THEN short END, 4) AS short, round(CASE WHEN nl = 7 THEN long END, 4) AS long FROM a""")
def moving_avg(spark, sf_dir):
    e = events(spark, sf_dir)
    for width, name in ((3, "short"), (7, "long")):
        e = S.moving_average(e, ["user_id"], ["t", "event_id"], "value", width, name)
    return e.select("event_id", F.round("short", 4).alias("short"), F.round("long", 4).alias("long"))


@query(f"""WITH {_EV}, p AS (SELECT *, first_value(t) OVER (PARTITION BY user_id ORDER BY value DESC, t) AS peak FROM ev)
SELECT event_id, CASE WHEN t - peak BETWEEN -{48 * _HOUR} AND -{12 * _HOUR} THEN 'before' WHEN abs(t - peak) < {12 * _HOUR} THEN 'peak' ELSE 'after' END AS phase FROM p WHERE t - peak BETWEEN -{48 * _HOUR} AND {48 * _HOUR}""")
def peak_phases(spark, sf_dir):
    p = S.around_peak(events(spark, sf_dir), ["user_id"], "t", "value").withColumn("d", F.col("t") - F.col("peak"))
    phase = F.when(F.col("d").between(-48 * _HOUR, -12 * _HOUR), "before").when(F.abs("d") < 12 * _HOUR, "peak").otherwise("after")
    return p.where(F.col("d").between(-48 * _HOUR, 48 * _HOUR)).select("event_id", phase.alias("phase"))


@query(f"""WITH {_EV}, p AS (SELECT DISTINCT user_id, first_value(t) OVER (PARTITION BY user_id ORDER BY value DESC, t) AS peak FROM ev), o AS (SELECT * FROM (VALUES ('ready', -48), ('load', -24), ('hit', 0), ('recover', 24)) AS o(stage, h)),
x AS (SELECT p.user_id, stage, event_id, row_number() OVER (PARTITION BY p.user_id, stage ORDER BY abs(t - (peak + h * {_HOUR})), t, event_id) AS n FROM p CROSS JOIN o JOIN ev ON ev.user_id = p.user_id AND abs(t - (peak + h * {_HOUR})) <= {6 * _HOUR}) SELECT user_id, stage, event_id FROM x WHERE n = 1""")
def peak_offsets(spark, sf_dir):
    e = events(spark, sf_dir)
    peaks = S.around_peak(e, ["user_id"], "t", "value").groupBy("user_id").agg(F.first("peak").alias("peak"))
    stages = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(h * _HOUR).cast("long").alias("h")) for n, h in (("ready", -48), ("load", -24), ("hit", 0), ("recover", 24))])
    wanted = peaks.select("user_id", "peak", F.inline(stages)).withColumn("at", F.col("peak") + F.col("h"))
    return I.nearest(wanted, e.select("user_id", "event_id", F.col("t").alias("rt")), ["user_id"], ["user_id", "stage"], "at", "rt", 6 * _HOUR, "event_id").select("user_id", "stage", "event_id")


@query(f"""WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c, max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id) AS span FROM ev),
q AS (SELECT user_id, event_id, i, CAST(p AS BIGINT) AS p, CAST(round_even(p * (c - 1) / 6.0, 0) AS BIGINT) AS place FROM n, range(7) AS r(p) WHERE c >= 7 AND span >= {72 * _HOUR}) SELECT user_id, event_id, min(p) + 1 AS pick FROM q WHERE i = place GROUP BY 1, 2""")
def quantile_picks(spark, sf_dir):
    return S.quantile_picks(events(spark, sf_dir), ["user_id"], "t", "event_id", 7, 72 * _HOUR).select("user_id", "event_id", "pick")


@query(f"""WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM ev) SELECT event_id FROM n WHERE i % greatest(1, CAST(ceil(c / 240.0) AS BIGINT)) = 0""")
def stride_sample(spark, sf_dir):
    return S.every_nth(events(spark, sf_dir), ["event_type"], ["t", "event_id"], 240).select("event_id")


@query(f"""WITH {_EV}, s AS (SELECT event_id, list(k) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS st FROM ev) SELECT event_id, array_to_string(st, ',') AS stack FROM s WHERE len(st) = 4""")
def temporal_stack(spark, sf_dir):
    return S.sliding_stack(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "k", 4).select("event_id", F.array_join("stack", ",").alias("stack"))


@query(f"""WITH {_EV}, d AS (SELECT user_id, bit_count(xor(k, lead(k) OVER (PARTITION BY user_id ORDER BY t, event_id))) AS h FROM ev) SELECT user_id, CAST(min(h) AS BIGINT) AS least FROM d WHERE h IS NOT NULL GROUP BY 1""")
def hash_distance(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = events(spark, sf_dir).withColumn("h", F.bit_count(F.col("k").bitwiseXOR(F.lead("k").over(w))))
    return d.where("h IS NOT NULL").groupBy("user_id").agg(F.min("h").cast("long").alias("least"))


@query(f"""WITH {_EV}, d AS (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev) SELECT user_id, count(*) FILTER (WHERE k < p) AS regressions, bool_and(p IS NULL OR k > p) AS increasing FROM d GROUP BY 1""")
def order_checks(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = events(spark, sf_dir).withColumn("p", F.lag("k").over(w))
    return d.groupBy("user_id").agg(F.count_if(F.col("k") < F.col("p")).alias("regressions"), F.every(F.col("p").isNull() | (F.col("k") > F.col("p"))).alias("increasing"))


@query(f"""WITH {_EV}, s AS (SELECT user_id, min(t) // 1000000 AS a, max(t) // 1000000 AS b FROM ev GROUP BY 1) SELECT user_id, i AS part, a + ((b - a) * (2 * i + 1)) // 10 AS anchor FROM s, range(5) AS r(i)""")
def even_anchors(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id").agg(F.floor(F.min("t") / 1_000_000).alias("a"), F.floor(F.max("t") / 1_000_000).alias("b"))
    i = s.select("user_id", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("part"))
    return i.select("user_id", "part", F.expr("a + ((b - a) * (2 * part + 1)) div 10").alias("anchor"))


@query(f"""WITH RECURSIVE {_EV}, c AS (SELECT user_id, t // {24 * _HOUR} AS frame, event_id AS k, value / 100 AS x, k / 100e0 AS y, value AS size FROM ev),
f AS (SELECT user_id, frame, list(struct_pack(k := k, x := x, y := y, size := size)) AS all_, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS n FROM c GROUP BY 1, 2),
b AS (SELECT *, list_sort(list_transform(all_, lambda z: struct_pack(d := -z.size, k := z.k, x := z.x, y := z.y)))[1] AS big FROM f),
g AS (SELECT user_id, frame, n, big.k AS k, big.x AS x, big.y AS y FROM b WHERE n = 1
UNION ALL SELECT user_id, frame, n, CASE WHEN near.d <= 0.5e0 * 0.5e0 THEN near.k ELSE big.k END, CASE WHEN near.d <= 0.5e0 * 0.5e0 THEN near.x ELSE big.x END, CASE WHEN near.d <= 0.5e0 * 0.5e0 THEN near.y ELSE big.y END
FROM (SELECT b.user_id, b.frame, b.n, b.big, list_sort(list_transform(b.all_, lambda z: struct_pack(d := (z.x - g.x) * (z.x - g.x) + (z.y - g.y) * (z.y - g.y), k := z.k, x := z.x, y := z.y)))[1] AS near FROM g JOIN b ON b.user_id = g.user_id AND b.n = g.n + 1))
SELECT user_id, frame, k AS event_id FROM g""")
def stable_player(spark, sf_dir):
    """Choice that depends on the one before."""
    from ..operators.tracking import stable_choice

    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / (24 * _HOUR)).alias("frame"), "event_id", (F.col("value") / 100).alias("x"), (F.col("k") / 100).alias("y"), F.col("value").alias("size"))
    return stable_choice(e, "user_id", "frame", "event_id", "x", "y", "size", 0.5)


_COURT = [(0.1, 0.1), (0.9, 0.1), (0.95, 0.9), (0.05, 0.9)]
_PTS = "pt AS (SELECT event_id, user_id, value / 100 AS x, k / 100e0 AS y, t FROM ev)"


def _side(i):
    (x1, y1), (x2, y2) = _COURT[i], _COURT[(i + 1) % 4]
    return f"(({x2} - {x1}) * (y - {y1}) - ({y2} - {y1}) * (x - {x1}))"


@query(f"""WITH {_EV}, {_PTS} SELECT event_id, ({' AND '.join(f'{_side(i)} >= -1e-8' for i in range(4))}) OR ({' AND '.join(f'{_side(i)} <= 1e-8' for i in range(4))}) AS inside FROM pt""")
def point_in_quad(spark, sf_dir):
    corners = [(F.lit(x), F.lit(y)) for x, y in _COURT]
    e = events(spark, sf_dir)
    return e.select("event_id", G.inside(corners, (F.col("value") / 100, F.col("k") / 100.0)).alias("inside"))


@query(f"""WITH {_EV}, {_PTS}, d AS (SELECT user_id, t // {_HOUR} AS h, max_by(struct_pack(x := x, y := y), event_id) AS p FROM pt GROUP BY 1, 2) SELECT a.user_id AS a, b.user_id AS b, a.h AS hour, ((a.p.x < 0.5) = (b.p.x < 0.5)) AND abs(a.p.x - b.p.x) <= 0.18 AND abs(a.p.y - b.p.y) <= 0.38 AS conflict FROM d a JOIN d b ON a.h = b.h AND a.user_id < b.user_id WHERE conflict""")
def lane_conflict(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / _HOUR).alias("hour"), "event_id", (F.col("value") / 100).alias("x"), (F.col("k") / 100.0).alias("y"))
    d = e.groupBy("user_id", "hour").agg(F.max_by(F.struct("x", "y"), "event_id").alias("p"))
    near = I.near_pairs(d.select("user_id", "hour", (F.col("p.x") < 0.5).alias("half"), "p.x", "p.y"), ["hour", "half"], "user_id", "x", "y", 0.18, 0.38)
    conflict = G.lane_conflict((F.col("a.x"), F.col("a.y")), (F.col("b.x"), F.col("b.y")))
    return near.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), "hour", conflict.alias("conflict")).where("conflict")


_H = G.homography(_COURT, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
_N = [f"{v:.17e}" for v in _H]
_W = f"({_N[6]} * x + {_N[7]} * y + {_N[8]})"
_U, _V = f"(({_N[0]} * x + {_N[1]} * y + {_N[2]}) / {_W})", f"(({_N[3]} * x + {_N[4]} * y + {_N[5]}) / {_W})"


@query(f"""WITH {_EV}, {_PTS}, q AS (SELECT event_id, {_U} AS u, {_V} AS v FROM pt) SELECT event_id, CASE WHEN u BETWEEN -0.15e0 AND 1.15e0 AND v BETWEEN -0.15e0 AND 1.15e0 THEN greatest(0e0, least(1e0, u)) END AS u, CASE WHEN u BETWEEN -0.15e0 AND 1.15e0 AND v BETWEEN -0.15e0 AND 1.15e0 THEN greatest(0e0, least(1e0, v)) END AS v FROM q""")
def court_projection(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("x"), (F.col("k") / 100.0).alias("y"))
    u, v = G.project(_H, F.col("x"), F.col("y"))
    return e.select("event_id", u.alias("u"), v.alias("v"))


@query("""SELECT l_orderkey, l_linenumber, round(abs((l_quantity * l_tax * 10) - (l_discount * 10) * l_linenumber) / 2, 6) AS area FROM lineitem""")
def triangle_area(spark, sf_dir):
    zero = (F.lit(0.0), F.lit(0.0))
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.round(G.area([zero, (F.col("l_quantity"), F.col("l_discount") * 10), (F.col("l_linenumber").cast("double"), F.col("l_tax") * 10)]), 6).alias("area"))


@query(f"""WITH {_EV}, s AS (SELECT user_id, min(t) // 1000000 AS a, max(t) // 1000000 AS b FROM ev GROUP BY 1), r AS (SELECT user_id, a + (b - a) // 10 AS a, b - (b - a) // 10 AS b FROM s)
SELECT user_id, i AS part, a + ((b - a) * i) // 6 AS anchor FROM r, range(7) AS q(i)""")
def inset_anchors(spark, sf_dir):
    """Seven evenly spaced samples of each user's span, a tenth of it left out at either end."""
    s = events(spark, sf_dir).groupBy("user_id").agg(F.floor(F.min("t") / 1_000_000).alias("a"), F.floor(F.max("t") / 1_000_000).alias("b"))
    return S.inset_samples(s, "a", "b", 7, 10).select("user_id", F.col("sample").alias("part"), "anchor")


@query(f"""WITH {_EV}, r AS (SELECT user_id, t // {24 * _HOUR} AS frame, value, row_number() OVER (PARTITION BY user_id, t // {24 * _HOUR} ORDER BY value DESC, event_id) AS n FROM ev),
f AS (SELECT user_id, frame, count(*) AS members, round(sum(value), 4) AS total FROM r WHERE n <= 4 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, frame) AS n FROM f)
SELECT user_id, frame, members, total FROM b WHERE n = 1""")
def best_frame(spark, sf_dir):
    """Of each frame the four surest members, and of each user the frame whose members are surest together."""
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / (24 * _HOUR)).alias("frame"), "event_id", "value")
    return S.best_frame(e, ["user_id"], "frame", "event_id", "value", 4).select("user_id", "frame", "members", "total")
