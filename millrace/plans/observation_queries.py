"""Queries on observation documents: users are videos, events chosen frames with reviews and samples of a pose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as O
from ..operators import rules as R
from .registry import query
from .series_queries import _EV, events

#: One frame for each user and second, with what is known of it.
_FRAMES = f"""{_EV}, fr AS (SELECT user_id, t // 1000000 AS t, max_by(struct_pack(k := k, value := value, id := event_id, typ := event_type), event_id) AS e FROM ev WHERE k IS NOT NULL GROUP BY ALL),
cd AS (SELECT user_id, t, e.id AS id, e.k AS k, e.value AS value, CASE e.typ WHEN 'click' THEN 'preparation' WHEN 'view' THEN 'top_elbow' ELSE 'contact' END AS phase, e.id % 6 = 0 AS active FROM fr WHERE e.id % 4 > 0 AND e.id % 9 < 3),
rv AS (SELECT *, CASE WHEN k % 7 = 6 THEN NULL WHEN k % 7 = 0 OR user_id % 10 = 3 THEN 'not_action' ELSE 'action' END AS assessment, CASE WHEN k % 7 = 6 THEN [] WHEN k % 5 = 0 THEN ['racket_side_frame_collapsed'] WHEN k % 5 = 1 THEN ['seen', 'racket_side_frame_stable'] WHEN k % 5 = 2 THEN ['racket_side_frame_collapsed', 'racket_side_frame_stable'] ELSE [] END AS told FROM cd),
kp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, phase) AS n, row_number() OVER (PARTITION BY user_id, phase ORDER BY t) AS f FROM rv WHERE assessment IS NULL OR assessment <> 'not_action'),
te AS (SELECT user_id, NOT active AS height, CASE WHEN active THEN NULL WHEN k % 11 = 0 THEN 'unknown' WHEN value / 100 > (CASE WHEN k % 3 = 0 THEN k / 100e0 ELSE (k / 100e0 + (k + 10) / 100e0) / 2 END) + 0.04e0 THEN 'below_shoulder' ELSE 'near_shoulder' END AS elbow, CASE WHEN list_contains(told, 'racket_side_frame_collapsed') = list_contains(told, 'racket_side_frame_stable') THEN 'unknown' WHEN list_contains(told, 'racket_side_frame_collapsed') THEN 'collapsed' ELSE 'stable' END AS side FROM kp WHERE phase = 'top_elbow' AND f = 1)"""


def _inputs(spark, sf_dir):
    k, i = F.col("k"), F.col("event_id")
    e = events(spark, sf_dir).where("k IS NOT NULL").withColumn("t", F.floor(F.col("t") / 1_000_000))
    from ..operators.ranking import best_per_group

    c = best_per_group(e, ["user_id", "t"], [i], largest=True).where("event_id % 4 > 0 AND event_id % 9 < 3")
    phase = F.when(F.col("event_type") == "click", "preparation").when(F.col("event_type") == "view", "top_elbow").otherwise("contact")
    candidates = c.select("user_id", "t", phase.alias("phase"), (F.col("value") / 100).alias("confidence"), F.when(i % 6 == 0, "active_pre_contact").otherwise("height").alias("reason"))
    media = c.select("user_id", "t", F.concat(F.lit("m"), i).alias("media_key"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    told = F.when(k % 5 == 0, lit(O.COLLAPSED)).when(k % 5 == 1, lit("seen", O.STABLE)).when(k % 5 == 2, lit(O.COLLAPSED, O.STABLE)).otherwise(lit())
    reviews = c.where("k % 7 <> 6").select("user_id", "t", F.when((k % 7 == 0) | (F.col("user_id") % 10 == 3), "not_action").otherwise("action").alias("assessment"), told.alias("facts"), lit().alias("limitations"), F.when(k % 2 == 0, "side").otherwise("unknown").alias("camera_view"))
    samples = c.where("k % 11 > 0").select("user_id", "t", (F.col("value") / 100).alias("elbow"), (k / 100.0).alias("left"), F.when(k % 3 > 0, (k + 10) / 100.0).alias("right"))
    return e.select("user_id", F.lit("clear").alias("action")).distinct(), O.observation_frames(candidates, media, reviews, samples, ["user_id"]), reviews


@query(f"""WITH {_FRAMES} SELECT user_id, 'student-' || phase || '-' || t || '-' || n AS frame_id, (CASE WHEN phase = 'top_elbow' AND height AND elbow = 'below_shoulder' THEN 'elbow_below_shoulder,' WHEN phase = 'top_elbow' AND height AND elbow = 'near_shoulder' THEN 'elbow_near_shoulder_height,' ELSE '' END) || array_to_string(told, ',') AS facts, CASE WHEN k % 7 <> 6 AND k % 2 = 0 THEN 'side' END AS camera_view FROM kp LEFT JOIN te USING (user_id)""")
def observation_frames(spark, sf_dir):
    """Frames that no review has called something else, with facts of the pose before those of the review."""
    _, frames, _ = _inputs(spark, sf_dir)
    fact = F.array_join(F.filter("facts", lambda x: x.startswith("elbow_")), ",")
    rest = F.array_join(F.filter("facts", lambda x: ~x.startswith("elbow_")), ",")
    return frames.select("user_id", "frame_id", F.concat(F.when(F.length(fact) > 0, F.concat(fact, F.lit(","))).otherwise(""), rest).alias("facts"), "camera_view")


_DOCS = f"""{_FRAMES}, us AS (SELECT DISTINCT user_id FROM ev WHERE k IS NOT NULL), nf AS (SELECT user_id, count(*) AS n FROM kp GROUP BY 1),
dc AS (SELECT us.user_id, coalesce(n, 0) AS n_frames, coalesce(te.elbow, 'unknown') AS elbow, coalesce(te.side, 'unknown') AS side, te.elbow IS NULL AS no_elbow, n IS NULL AND us.user_id IN (SELECT user_id FROM rv WHERE assessment = 'not_action') AS no_action FROM us LEFT JOIN nf USING (user_id) LEFT JOIN te USING (user_id))"""


@query(f"""WITH {_DOCS} SELECT user_id, n_frames, elbow, side, (CASE WHEN no_action THEN 'action_phase_evidence,' ELSE '' END) || 'contact_point,' || (CASE WHEN no_elbow THEN 'elbow_height_before_hit,' ELSE '' END) || 'follow_through,hip_shoulder_sequence,' || (CASE WHEN side = 'unknown' THEN 'racket_side_structure,' ELSE '' END) || 'wrist_elbow_sequence' AS declared FROM dc""")
def observation_documents(spark, sf_dir):
    """What each video shows and what is declared missing."""
    videos, frames, reviews = _inputs(spark, sf_dir)
    d = O.observation_documents(videos, frames, reviews, ["user_id"])
    return d.select("user_id", F.size("frames").cast("long").alias("n_frames"), F.col("facts")["elbow_height_before_hit"].alias("elbow"), F.col("facts")["racket_side_structure"].alias("side"), F.array_join("declared", ",").alias("declared"))


_RULES = [
    ("r-elbow", "low-elbow", 1, ["clear"], ["elbow_height_before_hit"], [("elbow_height_before_hit", "equals", ["below_shoulder"], "the elbow is low")], 1),
    ("r-side", "open-frame", 2, ["clear"], [], [("racket_side_structure", "in", ["collapsed"], "the frame collapses"), ("elbow_height_before_hit", "equals", ["near_shoulder"], "the elbow is high")], 1),
]


@query(f"""WITH {_DOCS}, j AS (SELECT *, NOT no_elbow AND elbow = 'below_shoulder' AS a, (side = 'collapsed') OR (NOT no_elbow AND elbow = 'near_shoulder') AS b FROM dc)
SELECT user_id, CASE WHEN a AND b THEN 'r-elbow,r-side' WHEN a THEN 'r-elbow' WHEN b THEN 'r-side' ELSE '' END AS issues, CASE WHEN a OR b THEN 'medium' ELSE 'low' END AS confidence FROM j""")
def observation_diagnosis(spark, sf_dir):
    """From frames, reviews and samples to issues: the documents go straight into the rules."""
    videos, frames, reviews = _inputs(spark, sf_dir)
    d = R.diagnose(O.observation_documents(videos, frames, reviews, ["user_id"]), spark.createDataFrame(_RULES, R.RULE_SCHEMA), key="user_id")
    return d.select("user_id", F.array_join("issues", ",").alias("issues"), "confidence")
