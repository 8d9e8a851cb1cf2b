"""Observation documents of videos, from chosen frames, their reviews and pose samples, as the rules take them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What one camera does not show unless a review has proved it, and limits of every frame.
UNPROVEN = ("contact_point", "wrist_elbow_sequence", "hip_shoulder_sequence", "racket_side_structure", "follow_through")
LIMITS = ("exact_shuttle_contact_not_visible", "calibrated_3d_biomechanics_not_available")
COLLAPSED, STABLE = "racket_side_frame_collapsed", "racket_side_frame_stable"


def _none() -> Column:
    return F.array().cast("array<string>")


def elbow_height(elbow: Column, left: Column, right: Column, margin: float = 0.04) -> Column:
    """below_shoulder or near_shoulder by the mean of the shoulders that are seen; unknown without elbow or shoulder."""
    seen = F.array_compact(F.array(left, right))
    line = F.aggregate(seen, F.lit(0.0), lambda s, y: s + y) / F.nullif(F.size(seen), F.lit(0))
    return F.when(elbow.isNull() | line.isNull(), "unknown").when(elbow > line + margin, "below_shoulder").otherwise("near_shoulder")


def observation_frames(candidates: DataFrame, media: DataFrame, reviews: DataFrame, samples: DataFrame, by: Sequence[str], *, elbow_phase: str = "top_elbow", without_height: str = "active_pre_contact") -> DataFrame:
    """The frames of each video that stay, in order of time: frame_id, facts, limitations, camera_view, elbow, structure.

    ``candidates``: phase, t, confidence and reason of frames that are chosen already, one for each video and t. A frame
    without media (t, media_key) is left out, and so is one that a review (t, assessment, facts, limitations,
    camera_view) calls not_action; no review, or an unclear one, leaves it in. dropped, on every row, tells whether the
    video lost one that way. elbow is judged on the first frame of ``elbow_phase``, from its sample (t, elbow, left,
    right), unless its reason is ``without_height``; its fact comes before those of the review. structure is what the
    review of that frame tells of the racket side.
    """
    rows = candidates.join(media.select(*by, "t", "media_key"), [*by, "t"]).join(reviews, [*by, "t"], "left").join(samples, [*by, "t"], "left")
    gone = F.coalesce(F.col("assessment") == "not_action", F.lit(False))
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("dropped", F.max(gone).over(whole)).where(~gone)
    order = Window.partitionBy(*by).orderBy("t", "phase")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("__first", F.row_number().over(Window.partitionBy(*by, "phase").orderBy("t")) == 1)
    first = (F.col("phase") == elbow_phase) & F.col("__first")
    height = (F.col("phase") == elbow_phase) & F.coalesce(F.col("reason") != without_height, F.lit(True))
    elbow = F.when(first, F.when(height, elbow_height(F.col("elbow"), F.col("left"), F.col("right"))))
    rows = rows.withColumn("elbow", elbow)
    # the fact of the first such frame stands at every frame of its phase
    known = F.max("elbow").over(whole)
    proxy = F.max(F.when(first, height)).over(whole)
    fact = F.when((F.col("phase") == elbow_phase) & proxy, F.when(known == "below_shoulder", "elbow_below_shoulder").when(known == "near_shoulder", "elbow_near_shoulder_height"))
    told = F.coalesce("facts", _none())
    has = lambda x: F.array_contains(told, x)
    structure = F.when(first, F.when(has(COLLAPSED) == has(STABLE), "unknown").when(has(COLLAPSED), "collapsed").otherwise("stable"))
    return rows.select(
        *by,
        "n",
        F.concat_ws("-", F.lit("student"), "phase", "t", "n").alias("frame_id"),
        "phase",
        "t",
        "media_key",
        "confidence",
        F.array_distinct(F.concat(F.array_compact(F.array(fact)), told)).alias("facts"),
        F.array_distinct(F.concat(F.coalesce("limitations", _none()), F.array(*[F.lit(x) for x in LIMITS]))).alias("limitations"),
        F.nullif(F.col("camera_view"), F.lit("unknown")).alias("camera_view"),
        "elbow",
        structure.alias("structure"),
        "dropped",
    )


def observation_documents(videos: DataFrame, frames: DataFrame, reviews: DataFrame, by: Sequence[str], *, action: str = "action") -> DataFrame:
    """One document for each video: action, frames (in order), facts (a map) and declared (what is missing), as rules take them.

    ``frames`` is what ``observation_frames`` gives. What nothing proves is unknown and declared missing: the fixed list
    less a racket side that a review has told, the elbow's height without a frame that may tell it, and action evidence
    where reviews have left no frame at all.
    """
    listed = F.array_sort(F.collect_list(F.struct("n", "frame_id", "phase", "t", "media_key", "confidence", "facts", "limitations")))
    found = frames.groupBy(*by).agg(listed.alias("frames"), F.max("elbow").alias("__elbow"), F.max("structure").alias("__side"))
    lost = reviews.where("assessment = 'not_action'").select(*by).distinct().withColumn("__lost", F.lit(True))
    docs = videos.select(*by, action).join(found, list(by), "left").join(lost, list(by), "left")
    side = F.coalesce("__side", F.lit("unknown"))
    missing = F.array_compact(
        F.array(
            *[F.lit(x) for x in UNPROVEN if x != "racket_side_structure"],
            F.when(side == "unknown", "racket_side_structure"),
            F.when(F.col("__elbow").isNull(), "elbow_height_before_hit"),
            F.when(F.col("frames").isNull() & F.col("__lost"), "action_phase_evidence"),
        )
    )
    facts = F.create_map(F.lit("elbow_height_before_hit"), F.coalesce("__elbow", F.lit("unknown")), F.lit("racket_side_structure"), side, *[F.lit(v) for x in UNPROVEN if x != "racket_side_structure" for v in (x, "unknown")])
    return docs.select(*by, action, F.coalesce("frames", F.array().cast(docs.schema["frames"].dataType)).alias("frames"), facts.alias("facts"), F.array_sort(missing).alias("declared"))
