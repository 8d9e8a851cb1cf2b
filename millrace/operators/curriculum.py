"""Topics that inherit from techniques, and rules on the graph of techniques and the courses bound to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import union_all


def _none() -> Column:
    return F.array().cast("array<string>")


def parents_of(topics: DataFrame, by_topic: DataFrame, by_system: DataFrame, techniques: DataFrame) -> DataFrame:
    """``topics`` (topic, system) with parent: the technique named for the topic, else for its system; null if there is none.

    by_topic: topic, technique; by_system: system, technique. wanted keeps the name of a technique that is not known.
    """
    a, b = by_topic.select("topic", F.col("technique").alias("__a")), by_system.select("system", F.col("technique").alias("__b"))
    named = topics.join(a, "topic", "left").join(b, "system", "left").withColumn("wanted", F.coalesce("__a", "__b")).drop("__a", "__b")
    return named.join(techniques.select(F.col("technique").alias("wanted"), F.col("technique").alias("parent")), "wanted", "left")


def topic_units(sources: DataFrame, by_topic: DataFrame, by_system: DataFrame, techniques: DataFrame, courses: DataFrame, lessons: DataFrame, inherited: Sequence[str]) -> DataFrame:
    """A unit for each topic: sources, parent, knowledge and media status, courses, lessons, inherited arrays, neighbours.

    ``sources``: source, topic, system, one system for a topic (``routing.one_system`` checks that). ``techniques``:
    technique, prerequisites, next and the ``inherited`` arrays, which a unit takes from its parent as they are; without a
    parent they are empty. ``courses`` (source, technique, course) of the parent from one of the topic's sources are
    listed; a lesson (lesson, source, topic) binds media only for its own topic and source. Neighbours are the topics of
    the techniques that the parent names.
    """
    rows = sources.select("source", "topic", "system").distinct()
    topics = rows.select("topic", "system").distinct()
    known = parents_of(topics, by_topic, by_system, techniques).join(techniques.withColumnRenamed("technique", "parent"), "parent", "left")
    ids = rows.groupBy("topic").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    from_parent = rows.join(known.select("topic", "parent"), "topic").join(courses.select("source", F.col("technique").alias("parent"), "course"), ["source", "parent"])
    bound = from_parent.groupBy("topic").agg(F.array_sort(F.collect_set("course")).alias("courses"))
    media = rows.join(lessons.select("lesson", "source", "topic"), ["source", "topic"]).groupBy("topic").agg(F.array_sort(F.collect_set("lesson")).alias("lessons"))
    of = known.where("parent IS NOT NULL").select(F.col("parent").alias("__to"), F.col("topic").alias("__near"))

    def near(field: str) -> DataFrame:
        links = known.select("topic", F.explode(F.array_distinct(field)).alias("__to"))
        return links.join(of, "__to").groupBy("topic").agg(F.array_sort(F.collect_set("__near")).alias(f"{field}_topics"))

    out = known.drop("prerequisites", "next")
    for part in (ids, bound, media, near("prerequisites"), near("next")):
        out = out.join(part, "topic", "left")
    arrays = [*inherited, "courses", "lessons", "prerequisites_topics", "next_topics"]
    out = out.withColumns({c: F.coalesce(c, _none()) for c in arrays})
    out = out.withColumn("knowledge", F.when(F.col("parent").isNull(), "source_context_only").otherwise("parent_curriculum_bound"))
    out = out.withColumn("media", F.when(F.size("lessons") > 0, "teaching_ready").otherwise("no_reliable_topic_bound_media"))
    return out.select("topic", "system", "sources", "parent", "knowledge", "media", *arrays)


def unresolved(sources: DataFrame, by_topic: DataFrame, by_system: DataFrame, techniques: DataFrame, lessons: DataFrame) -> DataFrame:
    """key and violation for what names something that is not there: parents, and the topics and sources of lessons."""
    rows = sources.select("source", "topic", "system").distinct()
    named = parents_of(rows.select("topic", "system").distinct(), by_topic, by_system, techniques)
    lost = named.where("wanted IS NOT NULL AND parent IS NULL").select(F.col("topic").alias("key"), F.concat(F.lit("unknown_parent:"), "wanted").alias("violation"))
    gone = lambda c: lessons.join(rows.select(c).distinct(), c, "left_anti").select(F.col("lesson").alias("key"), F.concat(F.lit(f"unknown_{c}:"), c).alias("violation"))
    apart = lessons.join(rows.select("topic").distinct(), "topic", "left_semi").join(rows.select("source").distinct(), "source", "left_semi").join(rows, ["topic", "source"], "left_anti")
    return union_all([lost, gone("topic"), gone("source"), apart.select(F.col("lesson").alias("key"), F.lit("lesson_of_another_topic").alias("violation"))])


def graph_violations(techniques: DataFrame, courses: DataFrame, systems: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """key, violation and what it names, for every rule that the graph of techniques and its courses breaks.

    ``techniques``: technique, system, prerequisites, next, courses (arrays), availability and an array column for each of
    ``references``, whose tables list the known ids (id). A technique names known systems, ids, techniques other than
    itself and courses; what it names as next names it as a prerequisite; its courses name it and no other technique has
    them; it is teaching_ready only with a course and knowledge_only only without. A course is bound by its technique.
    """
    t = techniques
    row = lambda df, key, name, what: df.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("violation"), what.cast("string").alias("what"))
    ids = t.select(F.col("technique").alias("__id")).distinct()
    twice = t.groupBy("technique").agg(F.count("*").alias("__n")).where("__n > 1")
    found = [row(twice, "technique", "duplicate_technique", F.lit(None)), row(t.join(systems.select(F.col("system")).distinct(), "system", "left_anti"), "technique", "unknown_system", F.col("system"))]
    for field, known in references.items():
        each = t.select("technique", F.explode(F.array_distinct(field)).alias("__ref"))
        found.append(row(each.join(known.select(F.col("id").alias("__ref")).distinct(), "__ref", "left_anti"), "technique", f"unknown_{field}", F.col("__ref")))
    edges = union_all([t.select("technique", F.lit(f).alias("field"), F.explode(F.array_distinct(f)).alias("__to")) for f in ("prerequisites", "next")])
    found.append(row(edges.where("technique = __to"), "technique", "leads_to_itself", F.col("field")))
    found.append(row(edges.where("technique <> __to").join(ids, F.col("__to") == F.col("__id"), "left_anti"), "technique", "unknown_technique", F.col("__to")))
    ahead = edges.where("field = 'next' AND technique <> __to").join(ids, F.col("__to") == F.col("__id"), "left_semi").select("technique", "__to")
    back = edges.where("field = 'prerequisites'").select(F.col("technique").alias("__to"), F.col("__to").alias("technique"))
    found.append(row(ahead.join(back, ["technique", "__to"], "left_anti"), "technique", "no_way_back", F.col("__to")))
    bound = t.select("technique", F.explode(F.array_distinct("courses")).alias("course"))
    of = courses.select("course", F.col("technique").alias("__own"))
    both = bound.join(of, "course", "left")
    found.append(row(both.where("__own IS NULL"), "technique", "unknown_course", F.col("course")))
    found.append(row(both.where("__own <> technique"), "technique", "course_of_another", F.col("course")))
    shared = bound.groupBy("course").agg(F.count("*").alias("__n")).where("__n > 1")
    found.append(row(shared, "course", "bound_more_than_once", F.col("__n")))
    found.append(row(t.where("availability = 'teaching_ready' AND size(courses) = 0"), "technique", "ready_without_course", F.lit(None)))
    found.append(row(t.where("availability = 'knowledge_only' AND size(courses) > 0"), "technique", "media_without_review", F.lit(None)))
    found.append(row(of.join(ids, F.col("__own") == F.col("__id"), "left_anti"), "course", "course_without_technique", F.col("__own")))
    known = of.join(ids, F.col("__own") == F.col("__id"), "left_semi")
    found.append(row(known.join(bound.withColumnRenamed("technique", "__own"), ["course", "__own"], "left_anti"), "course", "course_not_bound", F.col("__own")))
    return union_all(found)
