"""Rule evaluation over observations with explicit missing values, scoring, and the diagnosis made of them.

An observation row has facts (map of path to text) and declared (array of paths said to be missing). Rules are a small
table: rule_id, issue, priority, actions, required, conditions (array of path, op, values, label), min_evidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import holds, is_missing

RULE_SCHEMA = "rule_id string, issue string, priority int, actions array<string>, required array<string>, conditions array<struct<path:string,op:string,values:array<string>,label:string>>, min_evidence int"
#: Rules, and frameworks, up to which a table of them is broadcast or held in one row.
BROADCAST_RULES = 10_000


def _with_rules(observations: DataFrame, rules: DataFrame, action: str) -> DataFrame:
    """Each observation with __rules, the array of the rules for its action; rules are told apart by rule_id."""
    each = rules.withColumn("__action", F.explode("actions")).dropDuplicates(["rule_id", "__action"])
    grouped = each.groupBy("__action").agg(F.array_sort(F.collect_list(F.struct("rule_id", *[c for c in rules.columns if c not in ("rule_id", "actions")]))).alias("__rules"))
    if rules.count() <= BROADCAST_RULES:
        grouped = F.broadcast(grouped)
    return observations.join(grouped, observations[action] == F.col("__action"), "left").drop("__action")


def _judged(rule: Column, more: Sequence[str] = ()) -> Column:
    """A rule against the row's facts: evidence, blocked and matched. Decided within the row; nothing is shuffled."""
    fact = lambda path: F.try_element_at("facts", path)
    kept = F.filter(rule["conditions"], lambda c: ~is_missing(fact(c["path"]), F.col("declared"), c["path"]) & holds(fact(c["path"]), c["op"], c["values"]))
    evidence = F.transform(kept, lambda c: c["label"])
    gone = F.filter(rule["required"], lambda p: is_missing(fact(p), F.col("declared"), p))
    return F.struct(
        *[rule[c].alias(c) for c in ("rule_id", "issue", "priority", "required", "min_evidence", *more)],
        evidence.alias("evidence"),
        F.when(F.size(evidence) > 0, gone).otherwise(F.array().cast("array<string>")).alias("blocked"),
        ((F.size(gone) == 0) & (F.size(evidence) >= F.coalesce(rule["min_evidence"], F.lit(1)))).alias("matched"),
    )


def evaluate_rules(observations: DataFrame, rules: DataFrame, *, action: str = "action") -> DataFrame:
    """Every observation with each rule for its action: evidence (labels), blocked (required paths that are missing)
    and matched.

    A rule without actions never applies. Missing facts satisfy nothing. A missing required path blocks the rule; it is
    reported only if some evidence stands. min_evidence conditions are needed, one where it is null.
    """
    more = [c for c in rules.columns if c not in ("rule_id", "issue", "priority", "required", "min_evidence", "conditions", "actions")]
    with_rules = _with_rules(observations, rules, action)
    judged = with_rules.withColumn("__judged", F.explode(F.transform("__rules", lambda r: _judged(r, more))))
    return judged.select(*observations.columns, "__judged.*")


def top_issue(matches: DataFrame, *, key: str) -> DataFrame:
    """For each key the matched rule with the least priority, then rule_id; combined before the shuffle."""
    found = matches.where("matched").groupBy(key).agg(F.min(F.struct("priority", "rule_id")).alias("__first"))
    return found.select(key, "__first.priority", "__first.rule_id")


def phase_gate(issues: DataFrame, *, needs: Column, have: Column) -> DataFrame:
    """Issues with the phases they need and lack (``action_package.<phase>``); allowed only if none lacks."""
    lacking = F.transform(F.array_except(needs, have), lambda p: F.concat(F.lit("action_package."), p))
    return issues.withColumn("missing_phases", lacking).withColumn("allowed", F.size("missing_phases") == 0)


def issue_phase(issue: Column, keywords: Sequence[tuple[str, str]], otherwise: str = "preparation") -> Column:
    """The phase of the first keyword in the id; underscores of the id are hyphens before the search."""
    name = F.translate(F.lower(issue), "_", "-")
    out = None
    for word, phase in keywords:
        test = F.contains(name, F.lit(word))
        out = F.when(test, phase) if out is None else out.when(test, phase)
    return out.otherwise(otherwise)


def diagnosis_confidence(issues: Column, missing: Column) -> Column:
    """high with issues and nothing missing, medium with issues, low without."""
    return F.when((issues > 0) & (missing == 0), "high").when(issues > 0, "medium").otherwise("low")


def evidence_status(missing_phases: Column, student: Column, coach: Column) -> Column:
    return F.when((missing_phases > 0) | (student == 0), "insufficient").when(coach == 0, "unavailable").otherwise("matched")


FRAMEWORK_SCHEMA = "framework_id string, actions array<string>, goals array<string>, suitable_for map<string,array<string>>, avoid_for map<string,array<string>>, triggers array<struct<path:string,op:string,values:array<string>,weight:int>>, priority array<string>"


def framework_scores(profiles: DataFrame, frameworks: DataFrame, *, fields: Sequence[str], action: str, goal: str, lists: Sequence[str] = (), facts: str | None = None) -> DataFrame:
    """scores: for each profile, an array of framework_id, score and position, in the order of position.

    One for each field whose value is in suitable_for, less three for each in avoid_for; of a field in ``lists`` (arrays)
    one for each value in suitable_for, and less three once if any is in avoid_for. For the action: with hit 4 and max(0,
    4 - number of actions), less 2 where actions are listed without it. For the goal: with hit 8 and max(0, 4 - number of
    goals). With ``facts`` (a map) each trigger that holds adds its weight, 4 without one.

    ``frameworks``: framework_id, actions, goals, suitable_for and avoid_for (map of field to values), triggers if any, and
    position if their order is not that of framework_id. They are held in the plan in blocks of BROADCAST_RULES, however
    many there are; each profile is scored within its own row and nothing is shuffled.
    """
    place = F.col("position") if "position" in frameworks.columns else F.lit(None).cast("int")
    triggers = F.col("triggers") if "triggers" in frameworks.columns else F.lit(None)
    kind = "array<struct<path:string,op:string,values:array<string>,weight:int>>"
    order = [F.asc_nulls_last("position"), F.asc("framework_id")]
    rows = frameworks.select(place.alias("position"), "framework_id", "actions", "goals", "suitable_for", "avoid_for", triggers.cast(kind).alias("triggers")).orderBy(*order).toJSON().toLocalIterator()
    schema = f"array<struct<position:int,framework_id:string,actions:array<string>,goals:array<string>,suitable_for:map<string,array<string>>,avoid_for:map<string,array<string>>,triggers:{kind}>>"

    def score(f: Column) -> Column:
        of = lambda m, field: F.coalesce(F.try_element_at(m, F.lit(field)), F.array().cast("array<string>"))
        total = F.lit(0)
        for field in fields:
            hit = lambda m, field=field: F.coalesce(F.array_contains(of(m, field), F.col(field)), F.lit(False))
            total = total + F.when(hit(f["suitable_for"]), 1).otherwise(0) - F.when(hit(f["avoid_for"]), 3).otherwise(0)
        for field in lists:
            own = F.coalesce(F.col(field), F.array().cast("array<string>"))
            total = total + F.size(F.array_intersect(own, of(f["suitable_for"], field))) - F.when(F.size(F.array_intersect(own, of(f["avoid_for"], field))) > 0, 3).otherwise(0)
        here = F.coalesce(F.array_contains(f["actions"], F.col(action)), F.lit(False))
        total = total + F.when(here, 4 + F.greatest(F.lit(0), 4 - F.size(f["actions"]))).when(F.size(f["actions"]) > 0, -2).otherwise(0)
        aim = F.coalesce(F.array_contains(f["goals"], F.col(goal)), F.lit(False))
        total = total + F.when(aim, 8 + F.greatest(F.lit(0), 4 - F.size(f["goals"]))).otherwise(0)
        if facts:
            weight = lambda t: F.when(holds(F.try_element_at(F.col(facts), t["path"]), t["op"], t["values"]), F.coalesce(t["weight"], F.lit(4))).otherwise(0)
            total = total + F.aggregate(F.transform(F.coalesce(f["triggers"], F.array().cast(kind)), weight), F.lit(0), lambda n, w: n + w)
        return total.cast("long")

    def scored(block: list[str], at: int) -> Column:
        known = F.from_json(F.lit("[" + ",".join(block) + "]"), schema)
        return F.transform(known, lambda f, i: F.struct(f["framework_id"].alias("framework_id"), score(f).alias("score"), (i + at).alias("position")))

    blocks, at = [], 0
    while block := list(islice(rows, BROADCAST_RULES)):
        blocks.append(scored(block, at))
        at += len(block)
    return profiles.withColumn("scores", F.concat(*blocks) if blocks else F.array().cast("array<struct<framework_id:string,score:long,position:int>>"))


def best_framework(scores: Column) -> Column:
    """score and framework_id of the best one; of equal scores the first in their order."""
    return F.array_max(F.transform(scores, lambda s: F.struct(s["score"].alias("score"), (-s["position"]).alias("before"), s["framework_id"].alias("framework_id"))))


def diagnose(observations: DataFrame, rules: DataFrame, *, key: str, action: str = "action", positions: dict[str, int] | None = None) -> DataFrame:
    """key, issues (ids in order), main issue, missing paths, confidence and found of each observation.

    Issues are ordered by priority, the framework's position of the rule (``positions``, 999 without one) and rule_id.
    found holds for each of them its evidence and all columns of the rule. Everything is decided within the row.
    """
    more = [c for c in rules.columns if c not in ("rule_id", "issue", "priority", "required", "min_evidence", "conditions", "actions")]
    seen = _with_rules(observations, rules, action).withColumn("__judged", F.transform(F.coalesce("__rules", F.array()), lambda r: _judged(r, more)))
    places = F.create_map(*[F.lit(x) for pair in (positions or {"": 999}).items() for x in pair])
    hits = F.transform(F.filter("__judged", lambda j: j["matched"]), lambda j: F.struct(j["priority"].alias("priority"), F.coalesce(F.try_element_at(places, j["rule_id"]), F.lit(999)).alias("position"), j["rule_id"].alias("rule_id"), *[j[c].alias(c) for c in ("issue", "evidence", *more)]))
    seen = seen.withColumn("found", F.array_sort(hits))
    seen = seen.withColumn("missing", F.array_sort(F.array_distinct(F.flatten(F.transform("__judged", lambda j: j["blocked"])))))
    ids = F.transform("found", lambda h: h["rule_id"])
    lost = F.when(F.size("__judged") > 0, F.size(F.array_union("missing", F.coalesce("declared", F.array().cast("array<string>"))))).otherwise(0)
    return seen.select(key, ids.alias("issues"), F.get(ids, F.lit(0)).alias("main_issue"), "missing", diagnosis_confidence(F.size("found"), lost).alias("confidence"), "found")


def action_topics(action: Column, aliases: dict[str, str]) -> Column:
    """The action and its alias as topics."""
    known = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    return F.array_distinct(F.array_compact(F.array(action, F.try_element_at(known, action))))


def select_evidence(sources: DataFrame, *, framework: Column, topics: Column, limit: int = 3, by: Sequence[str], sequences: str | None = None) -> DataFrame:
    """For each group of ``by`` the ``limit`` best sources of a framework, with what of them bears on some topics.

    ``sources`` has source_id, framework_ids and topic_tags (arrays), windows (array of struct: start, end, topics) and
    timestamps (array), and may have ``sequences`` (array of struct with topics). A source scores 100, 20 for each of the
    topics that it has, 5 if it has a sequence, and 1 for each timestamp up to 3; ties go to the smaller source_id. Of its
    windows the first with one of the topics counts, else the first; of its timestamps those in this window, else all;
    three at most. Of its sequences the first with one of the topics, else the first, is sequence.
    """
    from .ranking import top_per_group

    fit = sources.where(F.array_contains("framework_ids", framework)).withColumn("__topics", topics)
    score = 100 + 20 * F.size(F.array_intersect(F.col("__topics"), F.col("topic_tags"))) + F.least(F.size("timestamps"), F.lit(3))
    score = score + F.when(F.size(sequences) > 0, 5).otherwise(0) if sequences else score
    best = top_per_group(fit.withColumn("score", score.cast("long")), by, [F.desc("score"), F.asc("source_id")], limit)
    first = lambda c: F.coalesce(F.get(F.filter(c, lambda w: F.arrays_overlap(w["topics"], F.col("__topics"))), F.lit(0)), F.get(c, F.lit(0)))
    best = best.withColumn("window", first("windows"))
    best = best.withColumn("sequence", first(sequences)) if sequences else best
    within = F.filter("timestamps", lambda t: F.col("window").isNotNull() & t.between(F.col("window.start"), F.col("window.end")))
    return best.withColumn("timestamps", F.slice(F.when(F.size(within) > 0, within).otherwise(F.col("timestamps")), 1, 3)).drop("__topics", "windows")


def match_diagnosis(observations: DataFrame, rules: DataFrame, frameworks: DataFrame, *, key: str, fields: Sequence[str], lists: Sequence[str], goal: str, phases: Column, keywords: Sequence[tuple[str, str]], action: str = "action") -> DataFrame:
    """The whole diagnosis of each observation: key, action, framework_id, issues, evidence, missing, confidence.

    The best framework is chosen by ``framework_scores``; the rules for the action are judged; where ``phases`` (an array
    of the phases there are) is not null, an issue whose phase is lacking is dropped and reported as
    ``action_package.<phase>``. Issues are ordered by priority, their place in the framework's list and id. missing holds
    what is declared and what the rules report, each once, in order of rule_id; with any of it confidence is not high.
    All of it is decided within the row, after two joins with small tables.
    """
    scored = framework_scores(observations, frameworks, fields=fields, lists=lists, action=action, goal=goal, facts="facts")
    scored = scored.withColumn("framework_id", best_framework(F.col("scores"))["framework_id"]).drop("scores")
    listed = frameworks.select("framework_id", F.col("priority").alias("__priority"))
    listed = F.broadcast(listed) if frameworks.count() <= BROADCAST_RULES else listed
    seen = _with_rules(scored.join(listed, "framework_id", "left"), rules, action).withColumn("__phases", phases)
    judged = F.transform(F.coalesce("__rules", F.array()), lambda r: _judged(r))
    none = F.array().cast("array<string>")

    def gated(j: Column) -> Column:
        phase = issue_phase(j["issue"], keywords)
        lacks = j["matched"] & F.col("__phases").isNotNull() & ~F.coalesce(F.array_contains("__phases", phase), F.lit(False))
        place = F.array_position(F.coalesce("__priority", none), j["issue"])
        return F.struct(j["priority"].alias("priority"), F.when(place > 0, place - 1).otherwise(999).alias("place"), j["issue"].alias("issue"), j["evidence"].alias("evidence"), F.concat(j["blocked"], F.when(lacks, F.array(F.concat(F.lit("action_package."), phase))).otherwise(none)).alias("missing"), (j["matched"] & ~lacks).alias("kept"))

    seen = seen.withColumn("__judged", judged).withColumn("__judged", F.transform("__judged", gated))
    found = F.array_sort(F.filter("__judged", lambda j: j["kept"]))
    missing = F.array_distinct(F.concat(F.coalesce("declared", none), F.flatten(F.transform("__judged", lambda j: j["missing"]))))
    seen = seen.withColumn("__found", found).withColumn("missing", missing)
    return seen.select(
        key,
        action,
        "framework_id",
        F.transform("__found", lambda j: j["issue"]).alias("issues"),
        F.flatten(F.transform("__found", lambda j: j["evidence"])).alias("evidence"),
        "missing",
        diagnosis_confidence(F.size("__found"), F.size("missing")).alias("confidence"),
    )


def with_corpus_evidence(diagnoses: DataFrame, sources: DataFrame, *, aliases: dict[str, str], action: str = "action", sequences: str | None = None, limit: int = 3) -> DataFrame:
    """Adds corpus: for the framework and action of each diagnosis the best sources, in order (source_id, score, window).

    Sources are chosen once for each framework and action that occurs, not for each diagnosis.
    """
    kinds = diagnoses.select("framework_id", action).distinct()
    listed = sources.withColumn("framework_id", F.explode(F.array_distinct("framework_ids"))).join(F.broadcast(kinds) if kinds.count() <= BROADCAST_RULES else kinds, "framework_id")
    best = select_evidence(listed, framework=F.col("framework_id"), topics=action_topics(F.col(action), aliases), by=["framework_id", action], sequences=sequences, limit=limit)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "source_id", "window")))
    chosen = best.groupBy("framework_id", action).agg(F.transform(ordered, lambda e: F.struct(e["source_id"].alias("source_id"), (-e["less"]).alias("score"), e["window"].alias("window"))).alias("corpus"))
    return diagnoses.join(chosen, ["framework_id", action], "left")
