"""An inventory of assets that several passes have made: passes merged by source, canonicals, states and one roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import mark_duplicates

#: States of a source in the order in which they win, each with the asset states that give it.
SOURCE_STATES = (
    ("ready_existing", ("ready_existing",)),
    ("ready_to_materialize", ("ready_to_materialize",)),
    ("candidate_existing", ("candidate_existing",)),
    ("candidate_to_materialize", ("candidate_to_materialize",)),
    ("reviewed_rejected", ("reviewed_rejected_existing", "reviewed_rejected_missing")),
    ("action_gate_rejected", ("action_gate_rejected_existing", "action_gate_rejected_missing")),
)


def merge_passes(videos: DataFrame, key: Sequence[str], order: Sequence[str], name: str, metadata: Sequence[str]) -> DataFrame:
    """One row for each source: the metadata of its first row, and its passes in order (distinct), with their number of rows.

    ``order`` is the pass's priority and then the row's place in it. Rows are first reduced to one for each source and
    pass, in the tasks that read them, so that a source with many rows is few rows when it is merged.
    """
    first = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)])
    by_pass = videos.groupBy(*key, name).agg(F.min(F.struct(first.alias("at"), F.struct(*metadata).alias("meta"))).alias("first"), F.count("*").alias("rows"))
    found = by_pass.groupBy(*key).agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), F.col(name).alias("name")))).alias("passes"), F.sum("rows").alias("rows"))
    return found.select(*key, *[F.col(f"first.meta.{c}").alias(c) for c in metadata], F.transform("passes", lambda p: p["name"]).alias("passes"), "rows")


def asset_state(duplicate: Column, complete: Column, approved: Column, terminal: Column) -> Column:
    """The state of an asset: a duplicate, ready, rejected by review or gate, or a candidate; and whether it is there."""
    there = lambda name, yes, no: F.when(complete, f"{name}_{yes}").otherwise(f"{name}_{no}")
    return (
        F.when(duplicate, there("duplicate", "existing", "missing"))
        .when(approved, there("ready", "existing", "to_materialize"))
        .when(terminal == "reviewed_rejected", there("reviewed_rejected", "existing", "missing"))
        .when(terminal == "action_gate_rejected", there("action_gate_rejected", "existing", "missing"))
        .otherwise(there("candidate", "existing", "to_materialize"))
    )


def inventory_assets(assets: DataFrame, source: Sequence[str], quality: Sequence[Column], *, key: str, start: str, end: str, actions: str, least: float = 0.8) -> DataFrame:
    """``assets`` with duplicate_of (null for a canonical) and state.

    Of a source's assets, best first, one is a duplicate of the first canonical that shares an action and overlaps it by
    ``least`` (IoU). ``assets`` has complete and approved (booleans) and terminal (text).
    """
    marked = mark_duplicates(assets, source, quality, key, start, end, least, actions)
    marked = marked.withColumn("duplicate_of", F.nullif("duplicate_of", F.lit(-1)))
    return marked.withColumn("state", asset_state(F.col("duplicate_of").isNotNull(), F.col("complete"), F.col("approved"), F.col("terminal")))


def inventory_sources(sources: DataFrame, assets: DataFrame, source: Sequence[str]) -> DataFrame:
    """``sources`` with canonicals and approved (numbers), and the best state of their canonicals."""
    place = F.coalesce(*[F.when(F.col("state").isin(*states), n) for n, (_, states) in enumerate(SOURCE_STATES)], F.lit(len(SOURCE_STATES)))
    found = assets.where("duplicate_of IS NULL").groupBy(*source).agg(F.min(place).alias("__place"), F.count("*").alias("canonicals"), F.count_if("approved").alias("approved"))
    names = F.array(*[F.lit(n) for n, _ in SOURCE_STATES], F.lit("no_reliable_episode"))
    out = sources.join(found, list(source), "left").withColumn("state", F.get(names, F.coalesce("__place", F.lit(len(SOURCE_STATES)))))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("canonicals", "approved")}).drop("__place")


def inventory_rollup(sources: DataFrame, assets: DataFrame, coach: str, source: str, sums: Sequence[str]) -> DataFrame:
    """Counts over canonicals by source, by coach and in total, in one roll-up: level is 0, 1 or 2.

    Sources without canonicals count as sources. Duplicates count only in duplicates.
    """
    own = F.col("duplicate_of").isNull()
    at = {"assets": F.count("duplicate_of") + F.count_if(own), "canonicals": F.count_if(own), "complete": F.count_if(own & F.col("complete")), "approved": F.count_if(own & F.col("approved")), **{c: F.sum(F.when(own, F.col(c))) for c in sums}}
    each = assets.groupBy(coach, source).agg(*[v.alias(n) for n, v in at.items()])
    rows = sources.select(coach, source).join(each, [coach, source], "left").select(coach, source, *[F.coalesce(n, F.lit(0)).alias(n) for n in at])
    total = rows.rollup(coach, source).agg(F.count("*").alias("sources"), *[F.sum(n).cast("long").alias(n) for n in at], F.expr(f"CAST(grouping({coach}) + grouping({source}) AS INT)").alias("level"))
    return total.withColumn("duplicates", F.col("assets") - F.col("canonicals")).withColumn("missing", F.col("canonicals") - F.col("complete")).drop("assets")
