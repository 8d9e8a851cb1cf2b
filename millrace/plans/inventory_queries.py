"""Queries on an inventory: users are sources of three coaches, kinds of events passes, purchases and views assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import path_get
from ..operators import inventory as V
from .interval_queries import _IV, intervals
from .registry import query, table

_PASSES = {"purchase": 0, "view": 1, "click": 2}


@query("""WITH v AS (SELECT *, user_id % 3 AS coach, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS pri FROM events WHERE event_type IN ('purchase', 'view', 'click')),
f AS (SELECT *, row_number() OVER (PARTITION BY coach, user_id ORDER BY pri, event_id) AS n FROM v), p AS (SELECT coach, user_id, event_type, pri, count(*) AS c FROM v GROUP BY ALL),
g AS (SELECT coach, user_id, string_agg(event_type, ',' ORDER BY pri) AS passes, CAST(sum(c) AS BIGINT) AS rows FROM p GROUP BY ALL)
SELECT coach, user_id, 'title ' || event_id AS title, value, passes, g.rows AS rows FROM f JOIN g USING (coach, user_id) WHERE n = 1""")
def pass_merge(spark, sf_dir):
    """Passes of a source in their order; title and value are those of the first row of the first pass."""
    order = F.coalesce(*[F.when(F.col("event_type") == k, n) for k, n in _PASSES.items()])
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*_PASSES)).withColumn("coach", F.col("user_id") % 3).withColumn("pri", order).withColumn("title", F.concat(F.lit("title "), F.col("event_id")))
    m = V.merge_passes(e, ["coach", "user_id"], ["pri", "event_id"], "event_type", ["title", "value"])
    return m.select("coach", "user_id", "title", "value", F.array_join("passes", ",").alias("passes"), "rows")


#: Assets: intervals of purchases and views; a sixth of the sources has none.
_ASSETS = f"""{_IV}, kk AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
x AS (SELECT user_id % 3 AS coach, user_id, event_id, s, e, event_id % 2 AS action, k % 3 > 0 AS complete, value > 60 AS approved, CASE WHEN value < 10 THEN 'reviewed_rejected' WHEN value < 15 THEN 'action_gate_rejected' ELSE 'pending' END AS terminal, k * 100 AS bytes, k % 8 AS frames,
row_number() OVER (PARTITION BY user_id ORDER BY value > 60 DESC, event_type = 'view' DESC, event_id) AS n FROM iv JOIN kk USING (event_id) WHERE event_type IN ('purchase', 'view') AND user_id % 6 > 0 AND k IS NOT NULL),
gr AS (SELECT user_id, n, event_id, CAST(NULL AS BIGINT) AS dup, [struct_pack(id := event_id, s := s, e := e, a := action)] AS kept FROM x WHERE n = 1
UNION ALL SELECT user_id, n, event_id, hits[1].id, CASE WHEN len(hits) = 0 THEN list_append(kept, me) ELSE kept END
FROM (SELECT x.user_id, x.n, x.event_id, gr.kept, struct_pack(id := x.event_id, s := x.s, e := x.e, a := x.action) AS me,
list_filter(gr.kept, lambda k: k.a = x.action AND greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) / CAST((x.e - x.s) + (k.e - k.s) - greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) AS DOUBLE) >= 0.3e0) AS hits FROM gr JOIN x ON x.user_id = gr.user_id AND x.n = gr.n + 1)),
ast AS (SELECT x.*, dup, CASE WHEN dup IS NOT NULL THEN 'duplicate_' || CASE WHEN complete THEN 'existing' ELSE 'missing' END WHEN approved THEN CASE WHEN complete THEN 'ready_existing' ELSE 'ready_to_materialize' END WHEN terminal <> 'pending' THEN terminal || CASE WHEN complete THEN '_existing' ELSE '_missing' END ELSE CASE WHEN complete THEN 'candidate_existing' ELSE 'candidate_to_materialize' END END AS state FROM x JOIN gr USING (user_id, n))"""


def _assets(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("event_id", path_get("props", "k", "long").alias("k"))
    v = F.col("value")
    rows = intervals(spark, sf_dir).where("event_type IN ('purchase', 'view') AND user_id % 6 > 0").join(k, "event_id").where("k IS NOT NULL")
    rows = rows.select((F.col("user_id") % 3).alias("coach"), "user_id", "event_id", "event_type", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.array(F.col("event_id") % 2).alias("actions"), (F.col("k") % 3 > 0).alias("complete"), (v > 60).alias("approved"), F.when(v < 10, "reviewed_rejected").when(v < 15, "action_gate_rejected").otherwise("pending").alias("terminal"), (F.col("k") * 100).alias("bytes"), (F.col("k") % 8).alias("frames"))
    best = [F.desc("approved"), (F.col("event_type") == "view").desc(), F.asc("event_id")]
    return V.inventory_assets(rows, ["coach", "user_id"], best, key="event_id", start="s", end="e", actions="actions", least=0.3)


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("coach"), "user_id").distinct()


@query(f"""WITH RECURSIVE {_ASSETS} SELECT event_id, dup AS duplicate_of, state FROM ast""")
def inventory_assets(spark, sf_dir):
    """Every asset with the canonical that it repeats, and its state."""
    return _assets(spark, sf_dir).select("event_id", "duplicate_of", "state")


_BEST = "min(CASE state WHEN 'ready_existing' THEN 0 WHEN 'ready_to_materialize' THEN 1 WHEN 'candidate_existing' THEN 2 WHEN 'candidate_to_materialize' THEN 3 WHEN 'reviewed_rejected_existing' THEN 4 WHEN 'reviewed_rejected_missing' THEN 4 ELSE 5 END)"


@query(f"""WITH RECURSIVE {_ASSETS}, c AS (SELECT user_id, {_BEST} AS place, count(*) AS canonicals, count(*) FILTER (WHERE approved) AS approved FROM ast WHERE dup IS NULL GROUP BY 1)
SELECT u.user_id, coalesce(['ready_existing', 'ready_to_materialize', 'candidate_existing', 'candidate_to_materialize', 'reviewed_rejected', 'action_gate_rejected'][place + 1], 'no_reliable_episode') AS state, coalesce(canonicals, 0) AS canonicals, coalesce(approved, 0) AS approved FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id)""")
def inventory_sources(spark, sf_dir):
    """Every source with the best state of its canonicals."""
    return V.inventory_sources(_sources(spark, sf_dir), _assets(spark, sf_dir), ["coach", "user_id"]).select("user_id", "state", "canonicals", "approved")


@query(f"""WITH RECURSIVE {_ASSETS}, b AS (SELECT u.coach, u.user_id, count(event_id) AS al, count(event_id) FILTER (WHERE dup IS NULL) AS canonicals, count(*) FILTER (WHERE dup IS NULL AND complete) AS complete, count(*) FILTER (WHERE dup IS NULL AND approved) AS approved, coalesce(sum(bytes) FILTER (WHERE dup IS NULL), 0) AS bytes, coalesce(sum(frames) FILTER (WHERE dup IS NULL), 0) AS frames FROM (SELECT DISTINCT user_id % 3 AS coach, user_id FROM events) u LEFT JOIN ast USING (coach, user_id) GROUP BY ALL)
SELECT coach, user_id, count(*) AS sources, CAST(sum(canonicals) AS BIGINT) AS canonicals, CAST(sum(complete) AS BIGINT) AS complete, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(frames) AS BIGINT) AS frames, CAST(grouping(coach) + grouping(user_id) AS INTEGER) AS level, CAST(sum(al) - sum(canonicals) AS BIGINT) AS duplicates, CAST(sum(canonicals) - sum(complete) AS BIGINT) AS missing FROM b GROUP BY ROLLUP (coach, user_id)""")
def inventory_rollup(spark, sf_dir):
    """Canonicals by source, coach and in total."""
    return V.inventory_rollup(_sources(spark, sf_dir), _assets(spark, sf_dir), "coach", "user_id", ["bytes", "frames"])
