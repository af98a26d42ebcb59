"""Queries on outcomes, settlement and dead letters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.operators import chunks as C, outcomes as X, settle
from sluice.plans.catalog import query
from sluice.plans.messaging import chunked_entries, stored_entries, stored_messages, stored_triage, triaged
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, NOW, attempts, new_tables, outbox, request_errors, responses
from sluice.session import stored
from sluice.sources.pending import PendingLog
from sluice.sources.publish import RequestError, in_requests, publish_requests, refused_entries
from sluice.sources.tables import RelayTables, read_dead_letters


def poisoned(rows: DataFrame) -> DataFrame:
    """Rows that triage refuses, with their route and reason."""
    return rows.filter("triage <> 'dispatch'")


def verdicts(spark, d) -> DataFrame:
    """Outcome, reason, errors and fatal flag of every row of a batch that holds all routable rows, stored.

    All settlement views read this one narrow table. Options are parsed once,
    on the way to it. ``reports`` are the outcomes that senders reported.
    """
    rows = stored_triage(spark, d)
    m, e = stored_messages(spark, d, rows), chunked_entries(spark, d, rows)
    columns = ["id", "outcome", "reason", "errors", "fatal"]
    sent = X.pubsub_outcomes(m, attempts(m)).select(columns).unionByName(X.sqs_outcomes(e, responses(e)).select(columns))
    return stored(rows.selectExpr("id", "resolved_target", "resolved_destination", "triage", "reason AS refused").join(sent, "id", "left"))


def reports(rows: DataFrame) -> DataFrame:
    """Reported outcomes of both providers, with repeats and foreign ids."""
    copies = """filter(array(struct(id AS as_id, id * 3 AS seq, outcome AS said, reason AS why),
        CASE WHEN id % 7 = 0 THEN struct(id AS as_id, id * 3 + 1 AS seq, 'poison' AS said, 'late' AS why) END,
        CASE WHEN id % 11 = 0 THEN struct(id + 1000000000 AS as_id, id * 3 + 2 AS seq, outcome AS said, reason AS why) END), c -> c IS NOT NULL)"""
    conclusive = rows.filter("outcome IS NOT NULL").select("id", "outcome", "reason")
    return conclusive.selectExpr(f"inline({copies})").withColumnsRenamed({"as_id": "id", "said": "outcome", "why": "reason"})


def settled_rows(rows: DataFrame) -> DataFrame:
    refused = poisoned(rows).selectExpr("id", "refused AS reason")
    return settle.settled(refused, settle.settle_outcomes(rows.select("id"), reports(rows)))


SETTLED = """
conclusive AS (SELECT id, outcome, reason FROM outcomes WHERE outcome IS NOT NULL
               UNION ALL SELECT id, outcome, reason FROM sqs_outcomes WHERE outcome IS NOT NULL),
settled AS (SELECT id, 'poison' AS outcome, reason FROM triaged WHERE triage <> 'dispatch' UNION ALL SELECT * FROM conclusive)"""

DOCUMENT = """
SELECT t.id, '{"dead_lettered_at":"2024-01-31T00:00:00Z","destination":' || to_json(resolved_destination) || ',"error":' || to_json(reason)
  || ',"original_event":{"destination":' || coalesce(CAST(to_json(destination) AS VARCHAR), 'null') || ',"event_ts":"'
  || strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN rtrim(strftime(event_ts, '%f'), '0') = '' THEN '' ELSE '.' || rtrim(strftime(event_ts, '%f'), '0') END
  || 'Z","id":' || CAST(t.id AS VARCHAR) || ',"options":'
  || CASE WHEN options IS NULL THEN 'null' WHEN options = '{bad' THEN '"{bad"'
          WHEN t.id % 103 = 0 OR t.id % 107 = 0 OR t.id % 109 = 0 THEN options
          ELSE '{"pubsub":{"attributes":{"n":' || CAST(t.id % 7 AS VARCHAR) || ',"type":"' || event_type || '"},"orderingKey":"user-'
               || CAST(user_id AS VARCHAR) || '"},"sqs":{"delaySeconds":' || CAST(t.id % 950 AS VARCHAR) || ',"messageGroupId":"user-'
               || CAST(user_id AS VARCHAR) || '"}}' END
  || ',"payload":' || to_json(payload) || ',"target":' || to_json(target) || '},"source_schema":"public","source_table":"outbox","target":'
  || to_json(resolved_target) || '}' AS event
FROM triaged t JOIN events e ON e.event_id = t.id WHERE triage <> 'dispatch'"""


def committed(tables: RelayTables, batch_id: int) -> None:
    """Log a batch whose tables are written."""
    row = tables.spark.range(1).selectExpr(f"{batch_id}L AS batch_no", "0L AS failed")
    tables.write(row.coalesce(1), "batch_log", batch_id)


def dead_letter_table(spark, d) -> DataFrame:
    """Dead letters of a batch read back from their table, after the batch was replayed and while another is not committed."""
    tables = new_tables(spark)
    letters = settle.dead_letters(poisoned(triaged(spark, d)), outbox(spark, d).columns, CONFIG, NOW)
    for batch_id in (0, 0, 1):
        tables.write(letters, "dead_letters", batch_id)
    committed(tables, 0)
    return tables.dead_letters()


@query("dead_letters", over("triaged", DOCUMENT))
def _(spark, d):
    return dead_letter_table(spark, d).select("id", "event")


@query("dlq_readback", over("triaged", """
SELECT id, 'public' AS source_schema, 'outbox' AS source_table, '2024-01-31T00:00:00Z' AS dead_lettered_at, resolved_target AS target,
       resolved_destination AS destination, reason AS error, id AS original_id, payload AS original_payload
FROM triaged WHERE triage <> 'dispatch'"""))
def _(spark, d):
    opened = read_dead_letters(dead_letter_table(spark, d))
    return opened.select("id", "source_schema", "source_table", "dead_lettered_at", "target", "destination", "error",
                         F.try_variant_get("original_event", "$.id", "bigint").alias("original_id"),
                         F.try_variant_get("original_event", "$.payload", "string").alias("original_payload"))


@query("classify_pubsub", over("outcomes", """
SELECT id, outcome, reason, CAST(errors AS BIGINT) AS errors FROM outcomes WHERE ordering_key = ''"""))
def _(spark, d):
    m = stored_messages(spark, d)
    return X.pubsub_outcomes(m, attempts(m)).filter("ordering_key = ''").select("id", "outcome", "reason", "errors")


STOPS = "stops AS (SELECT topic, ordering_key, min(id) AS stop FROM outcomes WHERE blocking GROUP BY topic, ordering_key)"


@query("classify_pubsub_ordered", over("outcomes", """
SELECT id, o.topic, o.ordering_key, went AS attempted, CASE WHEN went THEN outcome END AS outcome, CASE WHEN went THEN reason END AS reason,
       CAST(CASE WHEN went THEN errors ELSE 0 END AS BIGINT) AS errors, went AND fatal AS fatal
FROM (SELECT o.*, stop IS NULL OR id <= stop AS went FROM outcomes o LEFT JOIN stops s ON s.topic = o.topic AND s.ordering_key = o.ordering_key
      WHERE o.ordering_key <> '') o""", STOPS))
def _(spark, d):
    m = stored_messages(spark, d)
    return X.pubsub_ordered_outcomes(m, attempts(m))


@query("classify_sqs", over("sqs_outcomes", "SELECT id, queue, outcome, reason, CAST(error AS BIGINT) AS errors FROM sqs_outcomes"))
def _(spark, d):
    e = chunked_entries(spark, d)
    return X.sqs_outcomes(e, responses(e)).select("id", "queue", "outcome", "reason", "errors")


@query("head_of_line", over("sqs_outcomes", """
SELECT id, queue, message_group_id,
       coalesce(max(CASE WHEN blocking THEN 1 ELSE 0 END) OVER (PARTITION BY queue, message_group_id ORDER BY id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted
FROM sqs_outcomes WHERE fifo"""))
def _(spark, d):
    e = stored_entries(spark, d).filter("fifo").withColumn("chunk_no", F.lit(None).cast("bigint"))
    fifo = X.sqs_outcomes(e, responses(e))
    return X.head_of_line(fifo, ["queue", "message_group_id"]).select("id", "queue", "message_group_id", "attempted")


def send_request(queue: str, entries: pd.DataFrame) -> pd.DataFrame:
    """Test sender of requests: some fail for now, some are refused for good, some entries fail."""
    ids = entries["id"].to_numpy()
    if (ids % 59 == 0).any():
        raise RequestError("ServiceUnavailable", "try later")
    if (ids % 47 == 0).any():
        raise RequestError("InvalidMessageContents", "invalid characters")
    fault, later = ids % 19 == 0, ids % 23 == 0
    pick = lambda a, b: np.where(fault, a, np.where(later, b, None))
    return pd.DataFrame({"id": ids, "status": np.where(fault | later, "error", "ok"), "code": pick("InvalidParameterValue", "InternalError"),
                         "message": pick("bad entry", "try later"), "sender_fault": fault})


@query("sqs_request_outcomes", over("chunked", """
SELECT id, queue, chunk_no, attempted,
       CASE WHEN NOT attempted OR failed THEN NULL WHEN refused AND (members = 1 OR id % 47 = 0) THEN 'poison' WHEN id % 19 = 0 THEN 'poison'
            WHEN id % 23 = 0 THEN NULL ELSE 'confirmed' END AS outcome,
       CASE WHEN NOT attempted OR failed THEN NULL WHEN refused AND (members = 1 OR id % 47 = 0) THEN 'invalid characters'
            WHEN id % 19 = 0 THEN 'InvalidParameterValue: bad entry' END AS reason,
       CAST(CASE WHEN attempted AND failed AND id = first_id THEN 1 ELSE 0 END AS BIGINT) AS errors,
       CAST(CASE WHEN NOT attempted THEN 0 WHEN refused AND NOT failed AND members > 1 THEN 2 ELSE 1 END AS BIGINT) AS sends
FROM (SELECT r.*, stop IS NULL OR id <= stop AS attempted FROM requests r
      LEFT JOIN (SELECT queue, message_group_id, min(id) AS stop FROM requests WHERE fifo AND (failed OR (id % 23 = 0 AND id % 19 <> 0 AND id % 47 <> 0))
                 GROUP BY queue, message_group_id) s ON fifo AND s.queue = r.queue AND s.message_group_id = r.message_group_id) x""", """
requests AS (SELECT chunked.*, count(*) OVER c AS members, min(id) OVER c AS first_id, bool_or(id % 59 = 0) OVER c AS failed,
                    bool_or(id % 47 = 0) OVER c AS refused
             FROM chunked WINDOW c AS (PARTITION BY queue, chunk_no, CASE WHEN fifo THEN id END))"""))
def _(spark, d):
    """Entries sent in requests, then those of refused requests once more alone; both waves are stored before they are judged."""
    sendable = chunked_entries(spark, d).filter("reason IS NULL").withColumn(
        "order_group", F.expr("CASE WHEN fifo THEN message_group_id ELSE '' END"))
    first = stored(publish_requests(sendable, in_requests(send_request), "bigint"))
    second = stored(publish_requests(refused_entries(sendable, first), in_requests(send_request, attempt=2), "bigint"))
    sent = first.unionByName(second)
    judged = X.sqs_outcomes(sendable, sent).select("id", "queue", "outcome", "reason", "errors")
    sends = sent.groupBy("id").agg(F.count(F.lit(1)).alias("_sends"))
    return judged.join(sendable.select("id", "chunk_no"), "id").join(sends, "id", "left").selectExpr(
        "id", "queue", "chunk_no", "_sends IS NOT NULL AS attempted", "outcome", "reason", "errors", "coalesce(_sends, 0L) AS sends")


@query("sqs_isolation_plan", over("entries", """
SELECT id, queue, chunk_no, entries, CASE WHEN chunk_no % 3 <> 0 THEN 'keep' WHEN entries = 1 THEN 'poison' ELSE 'isolate' END AS action,
       CASE WHEN chunk_no % 3 = 0 AND entries = 1 THEN 'invalid characters' END AS reason
FROM (SELECT id, queue, chunk_no, count(*) OVER (PARTITION BY queue, chunk_no) AS entries
      FROM (SELECT id, queue, (row_number() OVER (PARTITION BY queue ORDER BY id) - 1) // 10 + 1 AS chunk_no
            FROM entries WHERE reason IS NULL AND NOT fifo) c) s
WHERE chunk_no % 3 = 0 OR chunk_no % 5 = 0"""))
def _(spark, d):
    chunks = C.chunks_by_count(stored_entries(spark, d).filter("reason IS NULL AND NOT fifo"))
    return X.sqs_isolation_plan(chunks, request_errors(chunks))


@query("settle_outcomes", over("outcomes sqs_outcomes", "SELECT id, outcome, reason FROM conclusive", SETTLED))
def _(spark, d):
    rows = verdicts(spark, d)
    return settle.settle_outcomes(rows.select("id"), reports(rows))


@query("settled_ids", over("outcomes sqs_outcomes", "SELECT id, outcome, reason FROM settled", SETTLED))
def _(spark, d):
    return settled_rows(verdicts(spark, d))


@query("kept_for_retry", over("outcomes sqs_outcomes", """
SELECT id, resolved_target, resolved_destination FROM triaged WHERE id NOT IN (SELECT id FROM settled)""", SETTLED))
def _(spark, d):
    rows = verdicts(spark, d)
    return settle.kept_for_retry(rows.select("id", "resolved_target", "resolved_destination"), settled_rows(rows))


@query("batch_stats", over("outcomes sqs_outcomes", """
SELECT count(*) AS selected, count(*) FILTER (WHERE outcome = 'confirmed') AS sent, CAST(0 AS BIGINT) AS poison,
       count(*) FILTER (WHERE outcome = 'poison') AS dlq, count(*) FILTER (WHERE outcome IS NULL) AS kept,
       (SELECT CAST(coalesce(sum(errors), 0) AS BIGINT) FROM outcomes) + (SELECT count(*) FILTER (WHERE error) FROM sqs_outcomes) AS sender_errors,
       (SELECT CAST(coalesce(bool_or(fatal), false) AS BIGINT) FROM outcomes) AS fatal
FROM triaged t LEFT JOIN settled s ON s.id = t.id""", SETTLED))
def _(spark, d):
    rows = verdicts(spark, d)
    return settle.batch_stats(rows.select("id"), settled_rows(rows), rows.select("errors", "fatal"), dead_letter=True)


@query("pending_after_settle", over("outcomes sqs_outcomes resolved", """
SELECT id, target, destination, payload FROM outbox WHERE id NOT IN (SELECT id FROM settled)""", SETTLED))
def _(spark, d):
    """What is pending after two batches, where rows with low ids arrive after the first one and its snapshot."""
    tables, box = new_tables(spark), outbox(spark, d)
    done = stored(settled_rows(verdicts(spark, d)))
    log = PendingLog(tables, box.schema, CONFIG)
    for epoch, part in enumerate(("id % 10 <> 3", "id % 10 = 3")):
        log.append(box.filter(part), epoch)
        tables.write(done.filter(part), "settled", epoch)
        committed(tables, epoch)
        if not epoch:
            log.compact()
    return log.rows().select("id", "target", "destination", "payload")
