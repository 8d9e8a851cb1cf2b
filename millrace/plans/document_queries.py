"""Queries on nested documents that are built from the tables, and on vectors read as heat maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import path_get
from ..operators import documents as D
from ..operators.ranking import grid_peaks
from .registry import query, table

_MARKERS = ("license", "http", "@", "password")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), m AS (SELECT unnest({list(_MARKERS)}) AS marker)
SELECT doc_id, '$.body.lines[' || i || '].text' AS path, marker FROM l, m WHERE contains(lower(line), marker)
UNION ALL SELECT doc_id, '$.about.source[0]', marker FROM documents, m WHERE contains(lower(source), marker)""")
def marker_paths(spark, sf_dir):
    """Paths of all strings that hold a forbidden marker, in documents of their lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda t: F.struct(t.alias("text"), F.length(t).alias("size")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct(lines.alias("lines")).alias("body"), F.struct("lang", F.array("source").alias("source"), "n_chars").alias("about"))).alias("doc"))
    return D.marker_hits(d, ["doc_id"], "doc", _MARKERS)


_BASE = """CAST('{"k":' || k || ',"seen":{"type":"' || event_type || '","deep":{"a":' || event_id || ',"b":[1,2]}},"keep":{"x":true}}' AS JSON)"""
_PATCH = """CAST(CASE WHEN k % 4 = 0 THEN '{"seen":{"deep":{"b":[' || k || ']},"by":"ü"}}' WHEN k % 4 = 1 THEN '{"k":{"was":' || k || '},"seen":7}' WHEN k % 4 = 2 THEN '{"new":{"deep":{"er":"' || event_type || '"}}}' ELSE '{}' END AS JSON)"""


_LEAVES = {"k": "k", "type_": "seen.type", "a": "seen.deep.a", "b": "seen.deep.b", "by_": "seen.by", "er": "new.deep.er", "keep": "keep.x"}


@query(f"""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), m AS (SELECT event_id, json_merge_patch({_BASE}, {_PATCH}) AS j FROM e WHERE k IS NOT NULL)
SELECT event_id, {', '.join(f"json_extract_string(j, '$.{p}') AS {c}" for c, p in _LEAVES.items())}, json_extract_string(json_merge_patch(j, CAST('{{"seen":{{"deep":{{"a":"new"}}}}}}' AS JSON)), '$.seen.deep.a') AS set_a, json_extract_string(json_merge_patch(j, CAST('{{"seen":{{"deep":{{"a":"new"}}}}}}' AS JSON)), '$.seen.deep.b') AS set_b FROM m""")
def json_merge(spark, sf_dir):
    """Documents of different shape merged at every depth, then a value set at a path of the result."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", path_get("props", "k", "long").alias("k")).where("k IS NOT NULL")
    base = F.format_string('{"k":%d,"seen":{"type":"%s","deep":{"a":%d,"b":[1,2]}},"keep":{"x":true}}', "k", "event_type", "event_id")
    four = F.col("k") % 4
    patch = F.when(four == 0, F.format_string('{"seen":{"deep":{"b":[%d]},"by":"ü"}}', "k")).when(four == 1, F.format_string('{"k":{"was":%d},"seen":7}', "k")).when(four == 2, F.format_string('{"new":{"deep":{"er":"%s"}}}', "event_type")).otherwise("{}")
    merged = e.select("event_id", D.merge_json(base, patch).alias("merged"))
    updated = D.path_update(F.col("merged"), "seen.deep.a", F.lit("new"))
    return merged.select("event_id", *[path_get("merged", p).alias(c) for c, p in _LEAVES.items()], path_get(updated, "seen.deep.a").alias("set_a"), path_get(updated, "seen.deep.b").alias("set_b"))


@query("""WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT vec_id, v, i // 8 AS y, i % 8 AS x, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i // 8, i % 8) AS n FROM v WHERE v >= 0.08),
a AS (SELECT * FROM c WHERE n = 1), p AS (SELECT c.*, row_number() OVER (PARTITION BY c.vec_id ORDER BY c.n) AS o FROM c JOIN a USING (vec_id) WHERE greatest(abs(c.x - a.x), abs(c.y - a.y)) > 1),
b AS (SELECT * FROM p WHERE o = 1), q AS (SELECT p.*, row_number() OVER (PARTITION BY p.vec_id ORDER BY p.n) AS z FROM p JOIN b USING (vec_id) WHERE greatest(abs(p.x - b.x), abs(p.y - b.y)) > 1),
u AS (SELECT vec_id, 1 AS place, v, x, y FROM a UNION ALL SELECT vec_id, 2, v, x, y FROM b UNION ALL SELECT vec_id, 3, v, x, y FROM q WHERE z = 1)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(v, 6) AS confidence, round(x / 7, 6) AS x, round(y / 7, 6) AS y FROM u""")
def heat_map_peaks(spark, sf_dir):
    """Vectors of 64 components as maps of 8 by 8 cells: up to three peaks, apart from each other."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.posexplode(grid_peaks("embedding", 8, threshold=0.08)).alias("n", "p"))
    return p.select("vec_id", (F.col("n") + 1).alias("place"), *[F.round(f"p.{c}", 6).alias(c) for c in ("confidence", "x", "y")])
