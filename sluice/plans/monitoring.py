"""Queries on counters, gauges and failure records."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from sluice.operators import failures, stats
from sluice.plans.catalog import query
from sluice.plans.messaging import chunked_entries, stored_messages, stored_triage
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, NOW, attempts, batch_log, events, responses

HOUR = timedelta(hours=1)
COUNTER_SQL = {
    "events_selected": "selected", "events_sent": "sent", "events_poison": "poison", "events_dlq": "dlq",
    "events_kept_for_retry": "kept", "batches_processed": "1 - failed", "batch_errors": "failed",
    "sender_errors": "sender_errors", "fatal_after_commit_errors": "fatal"}


def _counters(form: str) -> str:
    return ", ".join(f"CAST({form.format(e)} AS BIGINT) AS {n}" for n, e in COUNTER_SQL.items())


def failure_records(spark, d) -> DataFrame:
    """Failure records where one signature holds a third of all rows."""
    e = events(spark, d)
    signature = F.when(F.col("event_id") % 3 == 0, "pubsub|hot").otherwise(F.concat(F.lit("sqs|q"), (F.col("user_id") % 7).cast("string")))
    return e.select(signature.alias("signature"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))


RECORDS_SQL = """rec AS (SELECT signature, moment, id, row_number() OVER (PARTITION BY signature ORDER BY moment, id) AS rn
  FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'pubsub|hot' ELSE 'sqs|q' || CAST(user_id % 7 AS VARCHAR) END AS signature, ts AS moment, event_id AS id FROM events) r),
walk(signature, moment) AS (
  SELECT signature, min(moment) FROM rec GROUP BY signature
  UNION ALL
  SELECT r.signature, min(r.moment) FROM walk w JOIN rec r ON r.signature = w.signature AND r.moment >= w.moment + INTERVAL 1 HOUR GROUP BY r.signature),
emitted AS (SELECT w.signature, w.moment, min(r.id) AS id, min(r.rn) AS rn FROM walk w JOIN rec r ON r.signature = w.signature AND r.moment = w.moment
            GROUP BY w.signature, w.moment)"""
EMITTED_SQL = over("", """
SELECT signature, epoch_us(moment) AS at_us, id,
       rn - coalesce(lag(rn) OVER (PARTITION BY signature ORDER BY rn), rn - 1) - 1 AS suppressed_count FROM emitted""", RECORDS_SQL)


@query("counters_running", over("batch_log", f"""
SELECT batch_no, {_counters('sum({}) OVER (ORDER BY batch_no)')} FROM batch_log"""))
def _(spark, d):
    return stats.counters_running(batch_log(spark, d))


@query("interval_stats", over("batch_log", f"""
SELECT t.tick, {_counters('coalesce(sum({}), 0)')}
FROM (SELECT unnest(generate_series(lo, hi)) AS tick FROM (
        SELECT min(epoch_us(committed_at)) // 3600000000 AS lo, max(epoch_us(committed_at)) // 3600000000 AS hi FROM batch_log) b) t
LEFT JOIN batch_log l ON epoch_us(committed_at) // 3600000000 = t.tick GROUP BY t.tick"""))
def _(spark, d):
    return stats.interval_stats(batch_log(spark, d), HOUR)


LAST = """last AS (SELECT * FROM batch_log WHERE failed = 0 ORDER BY batch_no DESC LIMIT 1)"""


@query("last_batch_gauges", over("batch_log", """
SELECT batch_no, selected, kept, oldest_age_s, publish_s, db_s, epoch_us(committed_at) AS committed_us, selected >= 100 AS saturated FROM last""", LAST))
def _(spark, d):
    gauges = stats.last_batch_gauges(batch_log(spark, d), CONFIG)
    return gauges.withColumn("committed_us", F.unix_micros("committed_at")).drop("committed_at")


def gauge(spark, d) -> DataFrame:
    """Backlog gauge (backlog, floor) as the last batch left it."""
    last = stats.last_batch_gauges(batch_log(spark, d), CONFIG)
    return last.select(F.col("kept").alias("backlog"), F.col("saturated").alias("floor"))


def _metrics_sql() -> str:
    totals = [f"SELECT '{n}_total' AS name, 'counter' AS type, CAST(coalesce(sum({e}), 0) AS DOUBLE) AS value FROM batch_log" for n, e in COUNTER_SQL.items()]
    gauges = {
        "collect_batch_target": "100", "last_batch_selected_events": "selected", "events_pending_retry": "kept",
        "oldest_event_age_seconds": "floor(oldest_age_s * 1000) / 1000", "last_batch_db_seconds": "floor(db_s * 1000) / 1000",
        "last_batch_publish_seconds": "floor(publish_s * 1000) / 1000", "backlog_events": "kept",
        "backlog_floor": "CASE WHEN selected >= 100 THEN 1 ELSE 0 END",
        "last_successful_batch_timestamp_seconds": "CAST(epoch_us(committed_at) // 1000 AS DOUBLE) / 1000"}
    return "\nUNION ALL ".join(totals + [f"SELECT '{n}', 'gauge', CAST({e} AS DOUBLE) FROM last" for n, e in gauges.items()])


@query("metrics_table", over("batch_log", _metrics_sql(), LAST))
def _(spark, d):
    return stats.metrics_table(batch_log(spark, d), gauge(spark, d), CONFIG)


@query("health_staleness", over("batch_log", """
SELECT CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(committed_at)) AS DOUBLE) / 1000000 AS age_s,
       epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(committed_at)) <= 3600000000 AS healthy FROM batch_log WHERE failed = 0"""))
def _(spark, d):
    return stats.health_staleness(batch_log(spark, d), NOW, NOW - timedelta(days=60), HOUR)


@query("suppress_failures", EMITTED_SQL)
def _(spark, d):
    return failures.suppress_failures(failure_records(spark, d), HOUR).withColumn("at_us", F.unix_micros("at")).drop("at")


@query("failure_signatures", over("messages attempts sqs_requests", """
SELECT signature, count(*) AS failures FROM (
  SELECT concat_ws('|', 'pubsub', topic, rejected_field, 'malformed-options') AS signature FROM messages WHERE rejected_field IS NOT NULL
  UNION ALL
  SELECT CASE WHEN rejected_field IS NOT NULL THEN concat_ws('|', 'sqs', queue, rejected_field, 'malformed-options')
              ELSE concat_ws('|', 'sqs', queue, given_group, 'local-poison') END FROM entries WHERE reason IS NOT NULL
  UNION ALL
  SELECT concat_ws('|', 'pubsub', topic, ordering_key, CASE first WHEN 'deadline' THEN 'deadline exceeded' ELSE 'unavailable' END)
  FROM attempts a JOIN messages m ON m.id = a.id WHERE first IN ('deadline', 'retryable')
  UNION ALL
  SELECT concat_ws('|', 'pubsub', topic, ordering_key, CASE retry WHEN 'permanent' THEN 'rejected ' || CAST(m.id AS VARCHAR) ELSE 'unavailable' END)
  FROM attempts a JOIN messages m ON m.id = a.id WHERE retry IN ('permanent', 'retryable')
  UNION ALL
  SELECT concat_ws('|', 'sqs', queue, CASE WHEN id % 19 = 0 THEN 'InvalidParameterValue|bad entry' ELSE 'InternalError|try later' END)
  FROM sqs_requests WHERE (id % 19 = 0 OR id % 23 = 0) AND id % 29 <> 0 AND NOT failed AND (NOT refused OR (members > 1 AND id % 47 <> 0 AND id % 37 <> 0))
  UNION ALL
  SELECT concat_ws('|', 'sqs', queue, CASE WHEN failed OR (members > 1 AND id % 47 <> 0) THEN 'try later' ELSE 'invalid characters' END)
  FROM sqs_requests WHERE CASE WHEN failed THEN id = first_id ELSE refused AND (members = 1 OR id % 47 = 0 OR id % 37 = 0) END) f
GROUP BY signature"""))
def _(spark, d):
    rows = stored_triage(spark, d)
    m, e = stored_messages(spark, d, rows), chunked_entries(spark, d, rows)
    return failures.failure_signatures(failures.rejection_signatures(m, e), failures.attempt_signatures(m, attempts(m)),
                                       failures.response_signatures(e, responses(e)))
