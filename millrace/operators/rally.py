"""Two tracks side by side, and points that meet boxes: lane conflicts, roles of a pair, contact candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import lane_conflict


def pair_conflicts(samples: DataFrame, pairs: DataFrame, on: Sequence[str], a: str, b: str, *, track: str = "track", t: str = "t", x: str = "x", y: str = "y", gap: int = 250) -> DataFrame:
    """For each pair of tracks: shared times, conflicts among them, ratio (null without a shared time) and longest.

    ``samples`` has one row for each track and time. A streak of conflicts ends at a shared time without one and where
    two times lie more than ``gap`` apart; longest is the time from the first to the last of the longest streak.
    """
    points = samples.select(*on, F.col(track).alias("__track"), F.col(t).alias("__t"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("__p"))
    # samples are many, however few bytes their source has: they are never broadcast
    side = lambda c, name: points.withColumnsRenamed({"__track": c, "__p": name}).hint("merge")
    shared = pairs.select(*on, a, b).join(side(a, "__pa"), [*on, a]).join(side(b, "__pb"), [*on, b, "__t"])
    rows = shared.select(*on, a, b, "__t", lane_conflict((F.col("__pa.x"), F.col("__pa.y")), (F.col("__pb.x"), F.col("__pb.y"))).alias("__hit"))
    by = Window.partitionBy(*on, a, b).orderBy("__t")
    begins = ~F.coalesce(F.lag("__hit").over(by), F.lit(False)) | (F.col("__t") - F.lag("__t").over(by) > gap)
    rows = rows.withColumn("__begins", begins.cast("int")).withColumn("__streak", F.sum("__begins").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streaks = rows.groupBy(*on, a, b, "__streak").agg(F.count("*").alias("n"), F.count_if("__hit").alias("hits"), (F.max(F.when(F.col("__hit"), F.col("__t"))) - F.min(F.when(F.col("__hit"), F.col("__t")))).alias("span"))
    found = streaks.groupBy(*on, a, b).agg(F.sum("n").alias("shared"), F.sum("hits").alias("conflicts"), F.coalesce(F.max("span"), F.lit(0)).alias("longest"))
    out = pairs.select(*on, a, b).join(found, [*on, a, b], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*on, a, b, zero("shared"), zero("conflicts"), (F.col("conflicts") / F.col("shared")).alias("ratio"), zero("longest"))


def pair_rotation(ratio: Column, longest: Column, share: float = 0.4, span: int = 500) -> Column:
    """Whether two share a lane too often or too long; unknown without a shared time."""
    return F.when(ratio.isNull(), "unknown").when((ratio >= share) | (longest >= span), "same_lane_conflict").otherwise("two_lanes_available")


def pair_roles(conflicts: DataFrame, contacts: DataFrame, on: Sequence[str], a: str, b: str, *, contact: str = "contact", tracks: str = "tracks") -> DataFrame:
    """Adds pair_rotation and next_shot_role to what ``pair_conflicts`` gives.

    ``contacts`` has the possible tracks (array) of each contact. The role is unclear in a lane conflict or where a contact
    may be of both, unknown without a contact of either, else assigned.
    """
    touched = contacts.select(*on, contact, F.explode(F.array_distinct(tracks)).alias("__track"))
    one = lambda c: conflicts.select(*on, a, b).join(touched.withColumnRenamed("__track", c), [*on, c]).select(*on, a, b, contact, F.lit(c).alias("__who"))
    each = one(a).unionByName(one(b)).groupBy(*on, a, b, contact).agg(F.count_distinct("__who").alias("__of"))
    seen = each.groupBy(*on, a, b).agg(F.count("*").alias("contacts"), F.max("__of").alias("__of"))
    out = conflicts.join(seen, [*on, a, b], "left").withColumn("contacts", F.coalesce("contacts", F.lit(0)))
    out = out.withColumn("pair_rotation", pair_rotation(F.col("ratio"), F.col("longest")))
    role = F.when(F.col("pair_rotation") == "same_lane_conflict", "unclear").when(F.col("contacts") == 0, "unknown").when(F.col("__of") == 2, "unclear").otherwise("assigned")
    return out.withColumn("next_shot_role", role).drop("__of")


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str], *, within: int, margin: float, cell: float = 0.25, t: str = "t") -> DataFrame:
    """Points (x, y) with the boxes (bx, by, width, height, bt) that hold them, widened by ``margin``, ``within`` a time.

    A grid over time and place makes it an equi join: a point lies in one cell of the place and goes to each cell of time
    that it reaches, a box lies in one cell of time and goes to each cell that its widened area touches, so that a pair
    meets once and only where it is near. Spark takes the copies for as small as their source: the hint keeps them from
    being gathered in the driver for a broadcast. Values of a box's row are kept.
    """
    long = max(1, 2 * within)
    at = lambda c, d: F.floor(c / d).cast("long")
    through = lambda a, b, d: F.explode(F.sequence(at(a, d), at(b, d)))
    p = points.withColumns({"__cx": at(F.col("x"), cell), "__cy": at(F.col("y"), cell), "__ct": through(F.col(t) - within, F.col(t) + within, long)})
    ends = {"__cx": (F.col("bx") - margin, F.col("bx") + F.col("width") + margin), "__cy": (F.col("by") - margin, F.col("by") + F.col("height") + margin)}
    b = reduce(lambda df, c: df.withColumn(c, through(*ends[c], cell)), ends, boxes.withColumn("__ct", at(F.col("bt"), long)))
    held = F.col("x").between(*ends["__cx"]) & F.col("y").between(*ends["__cy"])
    return p.join(b.hint("merge"), [*on, *ends, "__ct"]).where(held & (F.abs(F.col(t) - F.col("bt")) <= within)).drop(*ends, "__ct")


def contact_candidates(points: DataFrame, boxes: DataFrame, on: Sequence[str], *, turn: float = 1.15, within: int = 120, margin: float = 0.035) -> DataFrame:
    """Windows around sharp turns of a path near a box: id, start, end, anchor, the three points, tracks and confidence.

    ``points``: point, t, x, y, confidence, interpolated; ``boxes``: track, bt, bx, by, width, height, bconf. A track is
    judged by its nearest box, then the surest; tracks are ranked by that distance, then confidence, then name. One track
    and a sure point that was seen give high; numbers run in order of time within a group.
    """
    w = Window.partitionBy(*on).orderBy("t", "point")
    step = lambda f, c: f(c).over(w)
    rows = points.select("*", *[step(f, c).alias(f"__{n}{c}") for n, f in (("p", F.lag), ("n", F.lead)) for c in ("t", "x", "y", "point")])
    ax, ay, bx, by = F.col("x") - F.col("__px"), F.col("y") - F.col("__py"), F.col("__nx") - F.col("x"), F.col("__ny") - F.col("y")
    norm = lambda u, v: F.greatest(F.sqrt(u * u + v * v), F.lit(1e-9))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (norm(ax, ay) * norm(bx, by))))
    sharp = rows.where(F.col("__pt").isNotNull() & F.col("__nt").isNotNull() & (F.acos(cosine) >= turn))
    met = points_in_boxes(sharp, boxes, on, within=within, margin=margin)
    dx, dy = F.col("bx") + F.col("width") / 2 - F.col("x"), F.col("by") + F.col("height") / 2 - F.col("y")
    keys = [*on, "point", "t", "confidence", "interpolated", "__pt", "__nt", "__ppoint", "__npoint"]
    near = met.groupBy(*keys, "track").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), (-F.col("bconf")).alias("c"))).alias("best"))
    found = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("best.d", "best.c", "track"))).alias("__ranked"))
    tracks = F.transform("__ranked", lambda r: r["track"])
    sure = F.when((F.size(tracks) == 1) & (F.col("confidence") >= 0.85) & ~F.col("interpolated"), "high").when(F.col("confidence") >= 0.65, "medium").otherwise("low")
    number = F.row_number().over(w)
    return found.select(*on, F.concat_ws("-", F.lit("contact"), "t", number).alias("contact"), F.floor((F.col("__pt") + F.col("t")) / 2).alias("start"), F.floor((F.col("t") + F.col("__nt")) / 2).alias("end"), F.col("t").alias("anchor"), F.array("__ppoint", "point", "__npoint").alias("points"), tracks.alias("tracks"), sure.alias("level"))
