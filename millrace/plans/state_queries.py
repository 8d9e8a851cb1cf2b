"""Queries on logs: events are a log in order of event_id; batch twins of the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expressions import micros
from ..operators import state as S
from ..session import shared_folder
from .registry import query, table


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def latest_wins(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT conv_id, turn, role FROM conversations WHERE turn > 2""")
def event_tail(spark, sf_dir):
    return S.tail(table(spark, sf_dir, "conversations"), "turn", 2).select("conv_id", "turn", "role")


@query("""SELECT event_id, user_id FROM events WHERE epoch_us(ts) + 86400000000 <= epoch_us(TIMESTAMP '2024-01-15') AND event_type NOT IN ('purchase', 'error')""")
def ttl_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("until", micros(F.col("ts")) + 86_400_000_000)
    return S.expired(e, "until", F.lit(1_705_276_800_000_000), "event_type", ["purchase", "error"]).select("event_id", "user_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'click') AND value > 10) SELECT user_id, event_id FROM r WHERE n = 1""")
def claim_first(spark, sf_dir):
    return S.claims(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["view", "click"], "event_type", F.col("value") > 10).select("user_id", "event_id")


@query("""WITH c AS (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS k, coalesce(m, -1) AS v FROM customer LEFT JOIN c ON c_custkey = k UNION SELECT k, m FROM c""")
def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    changes = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return S.upsert(base, changes, ["k"], "v")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def delete_by_parent(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return S.delete_children(table(spark, sf_dir, "lineitem"), "l_orderkey", gone, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_pending(spark, sf_dir):
    return S.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT event_id, CAST(greatest(0, least(100, max(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id))) AS BIGINT) AS progress FROM events""")
def progress_clamp(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("progress", F.floor("value"))
    return S.monotone_progress(e, ["user_id"], "event_id", "progress").select("event_id", "progress")


@query("""WITH d AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM d WHERE dead = 0) SELECT user_id, event_type AS state, event_id FROM r WHERE n = 1""")
def state_machine_final(spark, sf_dir):
    s = S.final_states(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", ["error"])
    return s.select("user_id", F.col("event_type").alias("state"), "event_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') SELECT user_id, greatest(CAST(floor(value) AS BIGINT), 32) AS progress FROM r WHERE n = 1 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""")
def resume_on_setup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = S.latest(e.where("event_type <> 'error'"), ["user_id"], "event_id")
    return last.join(e.where("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.greatest(F.floor("value"), F.lit(32)).alias("progress"))


@query("""WITH b AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(epoch_us(day) AS BIGINT) AS day_us, event_type, n FROM b""")
def tumbling_counts(spark, sf_dir):
    """The batch result of ``streaming.windows.tumbling``."""
    from ..streaming.windows import tumbling

    w = tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day")
    return w.select(F.unix_micros("start").alias("day_us"), "event_type", "n")


def _stream(spark, sf_dir, name):
    """The files of a table as a stream, whether it is one file or a folder of parts."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""WITH d AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM d WHERE dead = 0) SELECT user_id, event_type AS state, event_id, event_type = 'error' AS done FROM r WHERE n = 1""")
def state_machine_stream(spark, sf_dir):
    """The state machine as a stream over the table's files."""
    from ..streaming.jobs import job_states

    states = job_states(_stream(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state")), "user_id", "event_id", "state", ["error"])
    out = _ended(spark, states, "update")
    return S.latest(out, ["user_id"], "batch").select("user_id", "state", "event_id", "done")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id > 500""")
def event_tail_stream(spark, sf_dir):
    """The tail of a log as a stream over the table's files."""
    from ..streaming.jobs import tail_stream

    out = _ended(spark, tail_stream(_stream(spark, sf_dir, "events"), "event_id", 500))
    return out.select("event_id", "user_id", "event_type")


def _ended(spark, stream, mode="append"):
    from ..streaming.jobs import run_to_end

    return run_to_end(stream, f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}", mode, scratch=True)


def _timed(spark, sf_dir):
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SESSIONS = "m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM {rows} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM m), z AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) + 21600000000 AS b, count(*) AS n FROM s GROUP BY user_id, sid)"


@query(f"""WITH {_SESSIONS.format(rows='events')} SELECT user_id, a AS start_us, n FROM z""")
def session_counts(spark, sf_dir):
    """The batch result of ``streaming.windows.session_counts``."""
    from ..streaming.windows import session_counts as count

    s = count(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE event_type IN ('view', 'click') AND value > 10) SELECT user_id, event_id FROM r WHERE n = 1""")
def claim_stream(spark, sf_dir):
    """First claims as a stream over the table's files: each is given out once and stays."""
    from ..streaming.lifecycle import final_claims

    claims = final_claims(_timed(spark, sf_dir), "user_id", "event_id", "ts", ["view", "click"], "event_type", F.col("value") > 10, keep_ms=60 * _DAY_MS, late="1 hour")
    return _kept(spark, claims).select("user_id", "event_id")


_DAY_MS = 86_400_000
#: Events as requests to the job of their user.
_REQUESTS = """CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'advance' WHEN 'purchase' THEN CASE WHEN value < 40 THEN 'setup' ELSE 'report' END ELSE CASE WHEN value > 80 THEN 'delete' ELSE 'advance' END END"""
_TARGET = """CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 40 THEN 'needs_player_selection' ELSE 'analyzing' END"""


def _kept(spark, stream):
    """What a stream with timers puts out, to its end."""
    from ..streaming.lifecycle import rocksdb

    with rocksdb(spark):
        return _ended(spark, stream)


def _lifecycle(spark, sf_dir):
    from ..streaming.lifecycle import job_lifecycle

    e = _timed(spark, sf_dir).withColumn("request", F.expr(_REQUESTS)).withColumn("target", F.expr(_TARGET)).withColumn("asked", F.floor("value").cast("int"))
    return _kept(spark, job_lifecycle(e, "user_id", "event_id", "ts", "request", "target", "asked", ttl_ms=3 * _DAY_MS, late="1 hour"))


#: The jobs' lives in SQL: rows of a user one after the other, then the ends that lie before the watermark.
_LIVES = f"""e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, {_REQUESTS} AS request, {_TARGET} AS target, greatest(0, least(100, CAST(floor(value) AS INTEGER))) AS asked, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
z AS (SELECT user_id, 0 AS n, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS request, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS INTEGER) AS progress, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS INTEGER) AS had FROM (SELECT DISTINCT user_id FROM events)),
l AS (SELECT * FROM z UNION ALL SELECT user_id, n, t, event_id, request, outcome,
 CASE WHEN outcome <> 'accepted' THEN st WHEN request = 'create' THEN 'uploaded' WHEN request = 'claim' THEN 'normalizing' WHEN request = 'advance' THEN target WHEN request = 'setup' THEN 'queued' WHEN request = 'report' THEN st END,
 CASE WHEN outcome <> 'accepted' THEN pr WHEN request = 'create' THEN 0 WHEN request = 'claim' THEN 8 WHEN request = 'advance' THEN asked WHEN request = 'setup' THEN greatest(pr, 32) WHEN request = 'report' THEN pr END,
 CASE WHEN outcome <> 'accepted' THEN un WHEN request = 'create' THEN t + {3 * _DAY_MS} WHEN request <> 'delete' THEN un END,
 CASE WHEN gone THEN until END, CASE WHEN gone OR (outcome = 'accepted' AND request = 'delete') THEN progress END
 FROM (SELECT *, CASE WHEN st IS NULL THEN CASE WHEN request = 'create' THEN 'accepted' ELSE 'unknown' END WHEN request IN ('advance', 'report', 'delete') OR (request = 'claim' AND st IN ('uploaded', 'queued')) OR (request = 'setup' AND st = 'needs_player_selection') THEN 'accepted' ELSE 'refused' END AS outcome
  FROM (SELECT e.*, l.until, l.progress, coalesce(l.until <= e.t, false) AS gone, CASE WHEN l.until <= e.t THEN NULL ELSE l.state END AS st, CASE WHEN l.until <= e.t THEN NULL ELSE l.progress END AS pr, CASE WHEN l.until <= e.t THEN NULL ELSE l.until END AS un FROM l JOIN e ON e.user_id = l.user_id AND e.n = l.n + 1))),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM l),
ends AS (SELECT user_id, ended AS at_ms, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS request, 'timer' AS outcome, had AS progress FROM l WHERE ended IS NOT NULL
 UNION ALL SELECT user_id, until, NULL, NULL, 'timer', progress FROM f WHERE back = 1 AND until <= (SELECT max(t) FROM e) - 3600000
 UNION ALL SELECT user_id, t, event_id, request, outcome, had FROM l WHERE request = 'delete' AND outcome = 'accepted'),
steps AS (SELECT user_id, t AS at_ms, event_id AS seq, 0 AS step, request, outcome, state, progress FROM l WHERE n > 0 AND NOT (request = 'delete' AND outcome = 'accepted')
 UNION ALL SELECT user_id, at_ms, seq, s.step, request, outcome, s.state, CASE WHEN s.step = 2 THEN 100 ELSE progress END FROM ends, (VALUES (0, 'deleting'), (1, 'purge'), (2, 'expired')) AS s(step, state))"""


@query(f"""WITH RECURSIVE {_LIVES} SELECT user_id, at_ms, seq, CAST(step AS INTEGER) AS step, request, outcome, state, CAST(progress AS INTEGER) AS progress FROM steps""")
def job_lifecycle_stream(spark, sf_dir):
    """Every request and every end of all jobs: guards, claims, pauses and timers in one stateful stream."""
    return _lifecycle(spark, sf_dir).select("user_id", "at_ms", "seq", "step", "request", "outcome", "state", "progress")


@query(f"""WITH RECURSIVE {_LIVES} SELECT user_id, seq AS event_id, at_ms, state FROM steps WHERE request = 'report' AND outcome = 'accepted'""")
def reports_saved_stream(spark, sf_dir):
    """Reports that are saved: only those of a job that lives and has not expired."""
    return _lifecycle(spark, sf_dir).where("request = 'report' AND outcome = 'accepted'").select("user_id", F.col("seq").alias("event_id"), "at_ms", "state")


@query(f"""WITH RECURSIVE {_LIVES} SELECT user_id, at_ms, state, CAST(step AS INTEGER) AS step FROM steps WHERE outcome = 'timer'""")
def expiry_steps_stream(spark, sf_dir):
    """Deleting, purge and expired of each job whose time ran out, as its event-time timer gives them."""
    return _lifecycle(spark, sf_dir).where("outcome = 'timer'").select("user_id", "at_ms", "state", "step")


@query(f"""WITH o AS (SELECT * FROM events WHERE event_type NOT IN ('error')), {_SESSIONS.format(rows='o')}, l AS (SELECT max(epoch_us(ts)) AS last FROM o)
SELECT user_id, b AS expired_us, n AS rows FROM z, l WHERE b <= last - 3600000000""")
def expiry_stream(spark, sf_dir):
    """Jobs that expire six hours after their last row, as a stream: state and timer are a session window."""
    from ..streaming.jobs import expiring_jobs

    out = _ended(spark, expiring_jobs(_timed(spark, sf_dir), "user_id", "ts", "event_type", "6 hours", "1 hour", ["error"]))
    return out.select("user_id", F.unix_micros("expired_at").alias("expired_us"), "rows")


@query("""SELECT a.event_id AS paused, b.event_id AS setup FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOURS""")
def resume_stream(spark, sf_dir):
    """Pauses joined to the setups that follow within a day, stream to stream."""
    from ..streaming.jobs import resumed

    a = _timed(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("paused"))
    b = _timed(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("ts").alias("setup_at"), F.col("event_id").alias("setup"))
    return _ended(spark, resumed(a, b, "user_id", "at", "setup_at", "24 hours", "40 days")).select("paused", "setup")


def _measured(batches):
    """A model that answers with the length of a text, in some chatter, and sometimes with nothing of use."""
    import pyarrow as pa

    for batch in batches:
        raw = ["no idea" if i % 10 == 3 else f'Answer: {{"chars": {len(t or "")}}} (sure)' for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.string())], names=["doc_id", "raw"])


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN -1 ELSE coalesce(length(text), 0) END AS chars, doc_id % 10 <> 3 AS parsed, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS run_a, CAST(3 AS INTEGER) AS run_b FROM documents""")
def resumable_stage(spark, sf_dir):
    """A stage that is run over a part, then over all, then with another model: each item is asked once by each model."""
    from ..operators.stage import run_stage
    from ..session import delete_at_end

    folder = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parse = lambda raw: F.from_json(F.regexp_extract(raw, "[{].*[}]", 0), "chars long")["chars"]
    step = lambda rows, model, run: run_stage(rows, folder, key="doc_id", model=model, call=_measured, parse=parse, reject=F.lit(-1).cast("long"), run=run)
    step(docs.where("doc_id % 2 = 0"), "a", 1)
    delete_at_end(spark, folder)
    a = step(docs, "a", 2)
    b = step(docs, "b", 3).select("doc_id", F.col("run").alias("run_b"))
    return a.join(b, "doc_id").select("doc_id", F.col("payload").alias("chars"), "parsed", F.col("run").alias("run_a"), "run_b")
