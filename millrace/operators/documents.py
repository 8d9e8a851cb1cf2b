"""Nested documents of unknown keys and depth: a walk over their strings, and a merge in which the second wins."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expressions import path_set
from ..session import stored


def walk_strings(df: DataFrame, key: Sequence[str], document: str) -> DataFrame:
    """key, path and text of every string in a JSON text or variant, however deep: ``$.a.b[0].c``.

    Documents are opened one level at a time with ``variant_explode``; what is still nested is written and opened next, so
    that the number of rounds is the depth of the deepest document and no document is walked in one row. Texts that are
    no JSON have no strings.
    """
    spark = df.sparkSession
    value = F.col(document) if dict(df.dtypes)[document] == "variant" else F.try_parse_json(document)
    level, found = df.select(*key, F.lit("$").alias("__path"), value.alias("__v")), []
    while True:
        kind = F.schema_of_variant("__v")
        level = stored(level.where(F.col("__v").isNotNull()).withColumn("__kind", kind).where(F.col("__kind").rlike("^(STRING$|OBJECT|ARRAY)")))
        found.append(level.where("__kind = 'STRING'").select(*key, F.col("__path").alias("path"), F.col("__v").cast("string").alias("text")))
        nested = level.where("__kind <> 'STRING'")
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, found)
        inner = nested.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inner.select(*[nested[c] for c in key], F.concat("__path", step).alias("__path"), F.col("value").alias("__v"))


def marker_hits(df: DataFrame, key: Sequence[str], document: str, markers: Sequence[str]) -> DataFrame:
    """key, path and marker for every string that holds a forbidden marker, in any case; markers in lower case."""
    found = walk_strings(df.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(key)], document), [f"__k{n}" for n in range(len(key))], document)
    held = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower("text"), m))
    return found.select(*[F.col(f"__k{n}").alias(c) for n, c in enumerate(key)], "path", F.explode(held).alias("marker"))


def _joined(base: Any, patch: Any) -> Any:
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    return base | {k: _joined(base[k], v) if k in base else v for k, v in patch.items()}


def _parsed(text: str | None) -> tuple[bool, Any]:
    try:
        return (True, json.loads(text)) if text is not None else (False, None)
    except ValueError:
        return False, None


@F.pandas_udf(StringType())
def _merged(base: pd.Series, patch: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(base, patch, strict=True):
        (has_a, x), (has_b, y) = _parsed(a), _parsed(b)
        value = _joined(x, y) if has_a and has_b else y if has_b else x
        out.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")) if has_a or has_b else None)
    return pd.Series(out, dtype=object)


def merge_json(base: Column, patch: Column) -> Column:
    """Two JSON texts as one: objects are merged key by key at every depth, anything else is taken from the second.

    What the second lacks stays. Null, or a text that is no JSON, counts as lacking; null if both are. A JSON null in the
    second wins as any value does. Spark has no expression that joins objects of unknown keys, so Arrow batches go to
    Python here.
    """
    return _merged(base, patch)


def path_update(document: Column, path: str, value: Column) -> Column:
    """The document with a value at a dotted path: parents are made, or replace what is no object; the rest stays."""
    return merge_json(document, path_set({path: value}))
