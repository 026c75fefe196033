"""Chat history, task progress, intent buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tomeworks.operators import history as H
from tomeworks.operators import progress as P
from tomeworks.operators import understanding as U
from tomeworks.operators.settle import shared_folder
from tomeworks.plans import base as b
from tomeworks.plans.base import query
from tomeworks.sources.versioned import KeyedTable
from tomeworks.streaming.progress import current_progress, overdue_nodes, progress_updates, run_available, write_progress


def chat(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.col("conv_id").cast("string").alias("session_id"), "role", "text", F.lit("").alias("rewritten_query"),
        F.array().cast("array<string>").alias("item_names"), F.col("turn").cast("double").alias("ts"))


CHAT = """chat AS (SELECT conv_id || '-' || turn AS message_id, CAST(conv_id AS VARCHAR) AS session_id, role, text,
                          CAST(turn AS DOUBLE) AS ts FROM conversations)"""


@query("recent_messages", f"""WITH {CHAT}
SELECT message_id, session_id, role, text, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, message_id) AS n FROM chat) WHERE n <= 3""")
def recent_messages(spark, sf_dir):
    return H.recent_messages(chat(spark, sf_dir), 3).select("message_id", "session_id", "role", "text", "ts")


@query("latest_messages", f"""WITH {CHAT}
SELECT message_id, session_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS n FROM chat) WHERE n <= 2""", headline=False)
def latest_messages(spark, sf_dir):
    return H.recent_messages(chat(spark, sf_dir), 2, "newest").select("message_id", "session_id", "ts")


@query("history_upsert", f"""WITH {CHAT}
SELECT message_id, session_id, role, CASE WHEN role = 'assistant' THEN 'edited ' || text ELSE text END AS text FROM chat
UNION ALL SELECT 'new-' || message_id, session_id, role, text FROM chat WHERE role = 'system'""")
def history_upsert(spark, sf_dir):
    base = chat(spark, sf_dir)
    edited = base.where("role = 'assistant'").withColumn("text", F.concat(F.lit("edited "), "text"))
    added = base.where("role = 'system'").withColumn("message_id", F.concat(F.lit("new-"), "message_id"))
    return H.upsert_messages(base, edited.unionByName(added)).select("message_id", "session_id", "role", "text")


@query("history_delete", f"""WITH {CHAT}, gone AS (SELECT DISTINCT session_id FROM chat WHERE role = 'system')
SELECT session_id, count(*) AS messages, session_id IN (SELECT session_id FROM gone) AS deleted FROM chat GROUP BY session_id""")
def history_delete(spark, sf_dir):
    base = chat(spark, sf_dir)
    kept, deleted = H.delete_session(base, base.where("role = 'system'"))
    return kept.groupBy("session_id").agg(F.count("*").alias("messages"), F.lit(False).alias("deleted")).unionByName(
        deleted.select("session_id", F.col("deleted").alias("messages"), F.lit(True).alias("deleted")))


@query("history_merge", f"""WITH {CHAT}
SELECT message_id, session_id, role, CASE WHEN role = 'assistant' AND ts = 1 THEN 'edited ' || text ELSE text END AS text, 3 AS versions
FROM chat WHERE NOT (role = 'user' AND ts = 2)
UNION ALL SELECT 'new-' || message_id, session_id, role, text, 3 FROM chat WHERE role = 'system'""", headline=False)
def history_merge(spark, sf_dir):
    """The chat history as a keyed table: edits and additions in one merge, a delete in another."""
    base = chat(spark, sf_dir).select("message_id", "session_id", "role", "text", "ts")
    kept = KeyedTable(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", "message_id", base.schema)
    kept.create(base, buckets=16)
    edited = base.where("role = 'assistant' AND ts = 1").withColumn("text", F.concat(F.lit("edited "), "text"))
    added = base.where("role = 'system'").withColumn("message_id", F.concat(F.lit("new-"), "message_id"))
    kept.merge(edited.unionByName(added))
    kept.delete(base.where("role = 'user' AND ts = 2"))
    return kept.read().select("message_id", "session_id", "role", "text", F.lit(len(kept.versions())).alias("versions"))


def task_events(spark, sf_dir):
    """User events as the progress of one task per user and day."""
    e = b.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("task_id"),
        F.concat(F.lit("node"), (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 4).cast("string")).alias("node"),
        F.when(kind == "purchase", "status").when(kind.isin("view", "click"), "start").otherwise("end").alias("phase"),
        F.when(F.col("value") > 5, "processing").otherwise("completed").alias("status"),
        F.col("value").alias("seconds"), "ts")


TASK_PROGRESS = """WITH ev AS (
  SELECT user_id || '/' || strftime(ts, '%d') AS task_id, 'node' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 4) AS node,
         CASE WHEN event_type = 'purchase' THEN 'status' WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'end' END AS phase,
         CASE WHEN value > 5 THEN 'processing' ELSE 'completed' END AS status, value AS seconds, ts FROM events),
le AS (SELECT task_id, node, max(ts) AS le FROM ev WHERE phase = 'end' GROUP BY task_id, node),
n AS (SELECT task_id, node, min(ts) FILTER (WHERE phase = 'start' AND (le IS NULL OR ts > le)) AS since,
             min(ts) FILTER (WHERE phase = 'end') AS fe, round(arg_max(seconds, (ts, seconds)) FILTER (WHERE phase = 'end'), 2) AS s
      FROM ev LEFT JOIN le USING (task_id, node) WHERE phase <> 'status' GROUP BY task_id, node),
t AS (SELECT task_id, string_agg(node, ',' ORDER BY since, node) FILTER (WHERE since IS NOT NULL) AS running,
             string_agg(node || '=' || CAST(round(s * 100) AS BIGINT), ',' ORDER BY node) FILTER (WHERE s IS NOT NULL) AS node_cents,
             string_agg(node, ',' ORDER BY fe, node) FILTER (WHERE fe IS NOT NULL) AS done, count(fe) AS d, round(sum(s), 2) AS seconds
      FROM n GROUP BY task_id),
st AS (SELECT task_id, arg_max(status, (ts, status)) AS status FROM ev WHERE phase = 'status' GROUP BY task_id),
j AS (SELECT coalesce(t.task_id, st.task_id) AS task_id, coalesce(status, '') AS status, coalesce(running, '') AS running,
             coalesce(done, '') AS done, seconds, coalesce(node_cents, '') AS node_cents,
             100.0::DOUBLE * (coalesce(d, 0) + CASE WHEN running IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / 7 AS percent
      FROM t FULL JOIN st ON t.task_id = st.task_id)
SELECT task_id, status, running, done, seconds, node_cents,
       round(CASE WHEN status = 'completed' THEN 100 WHEN percent >= 100 THEN 95 ELSE percent END, 6) AS percent FROM j"""


def _readable(done):
    cents = F.transform(F.map_entries("node_seconds"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string")))
    return done.withColumn("node_cents", F.coalesce(F.array_join(cents, ","), F.lit(""))).drop("node_seconds").withColumns({
        "running": F.array_join("running", ","), "done": F.array_join("done", ","), "percent": F.round("percent", 6)})


@query("task_progress", TASK_PROGRESS)
def task_progress(spark, sf_dir):
    return _readable(P.task_progress(task_events(spark, sf_dir)))


#: Event time after which a running node is reported, and the watermark's delay.
NODE_LIMIT, DELAY = 3600, 600


def streamed_progress(spark, sf_dir):
    """The folder with the updates of all events, which arrive in two loads: a run for the first half of
    the time and, from its checkpoint, another for the rest."""
    folder = f"{shared_folder(spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    events = task_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    half = events.agg(((F.min(micros) + F.max(micros)) / 2).cast("bigint").alias("half")).first().half or 0
    for load in (micros < half, micros >= half):
        events.where(load).write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        run_available(write_progress(progress_updates(arrived, NODE_LIMIT, f"{DELAY} seconds"), f"{folder}/updates", f"{folder}/state"))
    return f"{folder}/updates"


@query("task_progress_stream", TASK_PROGRESS, headline=False)
def task_progress_stream(spark, sf_dir):
    return _readable(current_progress(spark, streamed_progress(spark, sf_dir)))


@query("overdue_nodes", f"""WITH ev AS (
  SELECT user_id || '/' || strftime(ts, '%d') AS task_id, 'node' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 4) AS node,
         CASE WHEN event_type = 'purchase' THEN 'status' WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'end' END AS phase, ts FROM events),
le AS (SELECT task_id, node, max(ts) AS le FROM ev WHERE phase = 'end' GROUP BY task_id, node),
n AS (SELECT task_id, node, min(ts) AS since FROM ev LEFT JOIN le USING (task_id, node) WHERE phase = 'start' AND (le IS NULL OR ts > le) GROUP BY task_id, node)
SELECT task_id, node, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since FROM n
WHERE epoch_us(since) + {NODE_LIMIT * 1_000_000} <= (SELECT epoch_ms(max(ts)) - {DELAY * 1000} FROM events) * 1000""", headline=False)
def overdue_running(spark, sf_dir):
    late = overdue_nodes(spark, streamed_progress(spark, sf_dir))
    return late.withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("intent_buckets", f"""WITH {b.TRACES}, r AS (
  SELECT substr(ts, 1, 10) AS day, unnest(['no_citation', 'long_prompt']) AS bucket,
         unnest([used_citations = '', prompt_chars >= 8000]) AS hit FROM traces)
SELECT day AS "window", bucket, count(*) AS traces, count(*) FILTER (WHERE hit) AS flagged,
       round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 9) AS rate
FROM r GROUP BY day, bucket HAVING count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) > 0.2""", headline=False)
def intent_buckets(spark, sf_dir):
    rules = [("no_citation", F.size("used_citations") == 0, 0.2), ("long_prompt", F.col("prompt_chars") >= 8000, 0.2)]
    found = U.intent_buckets(b.traces(spark, sf_dir), F.substring("ts", 1, 10), rules)
    return found.withColumn("rate", F.round("rate", 9))


_SIGNS = """signs AS (
  SELECT substr(ts, 1, 10) AS day, CASE k % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'image_request' WHEN 2 THEN 'parameter' ELSE 'operation' END AS intent,
         (k % 10) / 10.0 AS score, (k % 7) / 50.0 AS gap, k % 3 = 0 AS asked, k % 5 = 0 AS image, k % 6 = 0 AS spec
  FROM (SELECT ts, answer_chars AS k FROM traces))"""


@query("intent_plan_buckets", f"""WITH {b.TRACES}, {_SIGNS}, r AS (
  SELECT day, unnest(['intent_unknown_high_freq', 'clarification_missing', 'item_alignment_low_confidence',
                      'image_intent_no_image_context', 'parameter_intent_no_spec_context']) AS bucket,
         unnest([intent = 'general', gap < 0.08 AND NOT asked, score < 0.45, intent = 'image_request' AND NOT image, intent = 'parameter' AND NOT spec]) AS hit,
         unnest([0.3, 0.05, 0.2, 0.05, 0.05]) AS share FROM signs)
SELECT day AS "window", bucket, count(*) AS traces, count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 9) AS rate
FROM r GROUP BY day, bucket, share HAVING count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) > CAST(share AS DOUBLE)""", headline=False)
def intent_plan_buckets(spark, sf_dir):
    k = F.col("answer_chars")
    signs = b.traces(spark, sf_dir).select(
        "ts", F.when(k % 4 == 0, "general").when(k % 4 == 1, "image_request").when(k % 4 == 2, "parameter").otherwise("operation").alias("intent_type"),
        ((k % 10) / 10.0).alias("item_score"), ((k % 7) / 50.0).alias("score_gap"), (k % 3 == 0).alias("clarified"),
        (k % 5 == 0).alias("has_image_context"), (k % 6 == 0).alias("has_spec_context"))
    found = U.intent_buckets(signs, F.substring("ts", 1, 10), U.intent_rules())
    return found.withColumn("rate", F.round("rate", 9))
