"""Column expressions: paths in JSON, missing values, conditions, bands, links and arithmetic on intervals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a value that was not observed.
MISSING_WORDS = ("", "missing", "unknown", "not_visible")


def path_get(json: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a dotted path; null for a missing key, a step that is no object, or another type."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{path}", kind)


def path_set(fields: dict[str, Column]) -> Column:
    """A JSON object from dotted paths to values; parents are made as needed."""
    tree: dict = {}
    for path, value in fields.items():
        *parents, leaf = path.split(".")
        at = tree
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = value

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return F.to_json(build(tree))


def is_missing(value: Column, declared: Column, path: Column | str) -> Column:
    """Two-valued: the path or its root is declared missing, or the value is null or a word for it."""
    path = F.lit(path) if isinstance(path, str) else path
    root = F.element_at(F.split(path, "\\."), 1)
    said = F.coalesce(F.array_contains(declared, path) | F.array_contains(declared, root), F.lit(False))
    return said | F.coalesce(value.isin(*MISSING_WORDS), F.lit(True))


def holds(value: Column, op: Column, values: Column) -> Column:
    """``equals`` the first value, or ``in`` the values; false for null. Any other operator is an error."""
    known = F.when(op == "equals", value == F.try_element_at(values, F.lit(1))).when(op == "in", F.array_contains(values, value))
    return F.when(op.isin("equals", "in"), F.coalesce(known, F.lit(False))).otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(op, F.lit("null")))).cast("boolean"))


def label_of(labels: dict[str, str], key: Column) -> Column:
    """The label of an id; an id without one is an error."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.raise_error(F.concat(F.lit("no label for "), F.coalesce(key, F.lit("null")))).cast("string"))


def safe_path(path: Column, forbidden: Sequence[str]) -> Column:
    """No forbidden part in the lower-cased path."""
    return ~F.lower(path).rlike("(" + "|".join(map(re.escape, forbidden)) + ")")


def band(value: Column, cuts: Sequence[tuple[float | Column, str]], otherwise: str) -> Column:
    """The name of the first cut that the value reaches; cuts in falling order."""
    out = None
    for least, name in cuts:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(otherwise)


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for test, name in cases:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that do not hold (null counts as not), in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]), lambda x: x.isNotNull()))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length by joined length; 0 where nothing is joined."""
    both = overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def window_around(anchor: Column, before: int = 400, length: int = 800) -> tuple[Column, Column]:
    """Start and end of a window that begins ``before`` the anchor, not below 0, and has a fixed length."""
    start = F.greatest(F.lit(0), anchor - before)
    return start, start + length


def link_at(url: Column, seconds: Column) -> Column:
    """The url with its time parameter set: in the query if it has one, in a fragment otherwise."""
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "([?&])t=[^&]*(&|$)", "$1")
    base = F.regexp_replace(base, "[?&]$", "")
    return F.when(base.contains("?"), F.concat(base, F.lit("&t="), seconds)).otherwise(F.concat(base, F.lit("#t="), seconds))


def url_number(url: Column) -> Column:
    """The last run of digits of the path; null without one."""
    path = F.regexp_replace(url, "[?#].*$", "")
    return F.nullif(F.regexp_extract(path, "([0-9]+)[^0-9]*$", 1), F.lit("")).cast("long")


def integers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))


def reference_id(source: Column, suffix: str, ms: Column) -> Column:
    return F.concat_ws("-", F.lower(source), F.lit(suffix), ms.cast("string"))


def tri_join(a: Column, b: Column) -> Column:
    """Both arrays one after the other, each value once, in first-seen order."""
    return F.array_distinct(F.concat(a, b))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))
