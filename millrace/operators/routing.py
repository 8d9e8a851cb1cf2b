"""Routing of texts by patterns: a table of routes (id, pattern, priority, seq) is tried in order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Route:
    """Case does not count in patterns."""

    id: str
    pattern: str
    priority: int = 0


def in_order(routes: Sequence[Route]) -> list[Route]:
    """By falling priority; equal ones keep their places."""
    return sorted(routes, key=lambda r: -r.priority)


def first_route(text: Column, routes: Sequence[Route], fallback: str, outside: str | None = None) -> Column:
    """The id of the first route that matches; null where the text is outside of all (pattern ``outside``)."""
    out = None
    for r in in_order(routes):
        test = text.rlike(f"(?iu){r.pattern}")
        out = F.when(test, r.id) if out is None else out.when(test, r.id)
    found = out.otherwise(fallback)
    return F.when(~text.rlike(f"(?iu){outside}"), found) if outside else found


def top_routes(text: Column, routes: Sequence[Route], k: int, fallback: str) -> Column:
    """The ids of the first ``k`` routes that match, in order; the fallback alone where none does."""
    hits = F.filter(F.array(*[F.when(text.rlike(f"(?iu){r.pattern}"), F.lit(r.id)) for r in in_order(routes)]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.slice(hits, 1, k)).otherwise(F.array(F.lit(fallback)))


def more_specific(found: Column, general: dict[str, Sequence[str]]) -> Column:
    """Without a general id where one of its special ids is there as well."""
    out = found
    for name, special in general.items():
        some = F.arrays_overlap(out, F.array(*[F.lit(s) for s in special]))
        out = F.when(some, F.array_remove(out, name)).otherwise(out)
    return out


def keyword_class(text: Column, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The name of the first group one of whose words the text contains."""
    low, out = F.lower(text), None
    for name, words in groups:
        test = None
        for w in words:
            test = low.contains(w) if test is None else test | low.contains(w)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def category(action: Column, family: Column, by_action: dict[str, str], by_family: dict[str, str], otherwise: str) -> Column:
    """By the action's table, else by the family's."""
    maps = [F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (by_action, by_family)]
    return F.coalesce(F.try_element_at(maps[0], action), F.try_element_at(maps[1], family), F.lit(otherwise))


def capped_score(parts: Sequence[tuple[Column, float]], cap: float) -> Column:
    """A weighted sum that does not exceed ``cap``."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + F.coalesce(value, F.lit(0.0)) * weight
    return F.least(total, F.lit(cap))


def scoped_routes(text: Column, allowed: Column, tags: Column, routes: Sequence[Route], k: int) -> Column:
    """Of a transcript, up to ``k`` actions and the basis of each: struct of route and basis, by falling priority.

    A route counts if its pattern is in the text and it is among the ``allowed`` actions of the title (``title_scope``),
    or, where the title names none, by the text alone (``transcript``). Where no route counts, the tags that are routes do
    (``tag``). Each route once.
    """
    hit = lambda r: text.rlike(f"(?iu){r.pattern}")
    one = lambda r, basis: F.struct(F.lit(r.id).alias("route"), F.lit(basis).alias("basis"))
    said = lambda basis, scope: F.filter(F.array(*[F.when(hit(r) & scope(r), one(r, basis)) for r in in_order(routes)]), lambda x: x.isNotNull())
    scoped = said("title_scope", lambda r: F.coalesce(F.array_contains(allowed, r.id), F.lit(False)))
    free = said("transcript", lambda r: F.lit(True))
    tagged = F.filter(F.array(*[F.when(F.coalesce(F.array_contains(tags, r.id), F.lit(False)), one(r, "tag")) for r in in_order(routes)]), lambda x: x.isNotNull())
    found = F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, scoped).otherwise(free)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(tagged), 1, k)


def topic_conflicts(sources: DataFrame, topic: str, system: str) -> DataFrame:
    """Topics that more than one system claims, with the systems in order."""
    found = sources.groupBy(topic).agg(F.array_sort(F.collect_set(system)).alias("systems"))
    return found.where(F.size("systems") > 1)


def one_system(sources: DataFrame, topic: str, system: str) -> DataFrame:
    """``sources``, no topic of which may belong to two systems; otherwise an error names some."""
    wrong = topic_conflicts(sources, topic, system).limit(5).collect()
    if wrong:
        raise ValueError(f"topics of several systems: {[r[0] for r in wrong]}")
    return sources
