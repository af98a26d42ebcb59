"""Queries on message preparation, ordering and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.operators import chunks as C, messages as M, routing, triage as T
from sluice.plans.catalog import query
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, NOW, new_tables, outbox
from sluice.session import spread, stored
from sluice.sources.publish import write_messages


def triaged(spark, d) -> DataFrame:
    return T.triage(spread(routing.routable_events(outbox(spark, d), CONFIG)), CONFIG, NOW)


def stored_triage(spark, d) -> DataFrame:
    """Verdicts of all routable rows, their options parsed once, for jobs that read them repeatedly.

    Only rows that are sent keep their payload.
    """
    return stored(triaged(spark, d).selectExpr("id", "event_ts", "resolved_target", "resolved_destination", "triage", "reason",
                                               "CASE WHEN triage = 'dispatch' THEN payload END AS payload", "_section"))


def provider_events(spark, d, rows: DataFrame | None = None) -> DataFrame:
    return M.provider_events(triaged(spark, d) if rows is None else rows, CONFIG)


def messages(spark, d, rows: DataFrame | None = None) -> DataFrame:
    return M.pubsub_messages(provider_events(spark, d, rows))


def entries(spark, d, rows: DataFrame | None = None) -> DataFrame:
    return M.sqs_entries(provider_events(spark, d, rows), CONFIG)


def stored_messages(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Verdicts of the prepared messages, for queries that read them repeatedly."""
    return stored(messages(spark, d, rows).select("id", "topic", "ordering_key", "reason", "rejected_field"))


def stored_entries(spark, d, rows: DataFrame | None = None) -> DataFrame:
    return stored(entries(spark, d, rows).select("id", "queue", "fifo", "message_group_id", "deduplication_id", "given_group",
                                                 "message_size", "reason", "rejected_field"))


def chunked_entries(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Stored entries with the chunk of their request; entries of FIFO queues and refused ones have none."""
    every = stored_entries(spark, d, rows)
    chunks = C.greedy_chunks(every.filter("reason IS NULL AND NOT fifo"))
    return stored(every.join(chunks.select("id", "chunk_no"), "id", "left"))


def sized_standard_entries(spark, d) -> DataFrame:
    """Sendable standard-queue entries with sizes spread up to 300 kB."""
    rows = entries(spark, d).filter("reason IS NULL AND NOT fifo")
    return rows.select("id", "queue", (F.col("id") * 7919 % 300_000 + 1).alias("message_size"))


@query("provider_events", over("triaged", """
SELECT id, resolved_target AS target, resolved_destination AS destination, hex(encode(payload)) AS payload_hex, epoch_us(event_ts) AS event_us
FROM triaged WHERE triage = 'dispatch'"""))
def _(spark, d):
    return provider_events(spark, d).select("id", "target", "destination", F.hex("payload").alias("payload_hex"),
                                            F.unix_micros("event_time").alias("event_us"))


@query("publish_record", over("triaged", """
SELECT id, resolved_target AS target, resolved_destination AS destination,
       CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(event_ts) AS DOUBLE) / 1000000 AS latency_s,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes FROM triaged WHERE triage = 'dispatch'"""))
def _(spark, d):
    return M.publish_record(provider_events(spark, d), NOW)


@query("prepared_messages", over("messages entries", """
SELECT 'pubsub' AS target, topic AS destination, id, ordering_key AS order_key, data AS body FROM messages WHERE reason IS NULL
UNION ALL SELECT 'sqs', queue, id, message_group_id, body FROM entries WHERE reason IS NULL"""))
def _(spark, d):
    """Prepared messages by way of the message table, split by target."""
    events = provider_events(spark, d)
    rows, path = M.prepared(M.pubsub_messages(events), M.sqs_entries(events, CONFIG)), new_tables(spark).path("prepared")
    write_messages(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("pubsub_messages", over("messages", """
SELECT id, topic, data, ordering_key, attribute_type, reason, rejected_field FROM messages"""))
def _(spark, d):
    return messages(spark, d).select("id", "topic", F.col("data").cast("string").alias("data"), "ordering_key",
                                     F.try_element_at("attributes", F.lit("type")).alias("attribute_type"), "reason", "rejected_field")


@query("sqs_entries", over("entries", """
SELECT id, queue, fifo, CAST(id AS VARCHAR) AS entry_id, body, message_group_id, deduplication_id, delay_seconds, message_size, reason, rejected_field
FROM entries"""))
def _(spark, d):
    return entries(spark, d).select(
        "id", "queue", "fifo", "entry_id", F.col("body").cast("string").alias("body"), "message_group_id", "deduplication_id",
        F.col("delay_seconds").cast("bigint").alias("delay_seconds"), "message_size", "reason", "rejected_field")


@query("route_counts", over("routable", """
SELECT resolved_target, resolved_destination, count(*) AS events FROM routable GROUP BY resolved_target, resolved_destination"""))
def _(spark, d):
    return routing.route_counts(outbox(spark, d), CONFIG)


@query("pubsub_order_groups", over("messages", """
SELECT id, topic, ordering_key, row_number() OVER (PARTITION BY topic, ordering_key ORDER BY id) AS position
FROM messages WHERE reason IS NULL AND ordering_key <> ''"""))
def _(spark, d):
    return M.pubsub_order_groups(messages(spark, d))


@query("sqs_fifo_sequence", over("entries", """
SELECT id, queue, message_group_id, row_number() OVER (PARTITION BY queue, message_group_id ORDER BY id) AS request_no
FROM entries WHERE reason IS NULL AND fifo"""))
def _(spark, d):
    return M.sqs_fifo_sequence(entries(spark, d))


@query("sqs_chunks_by_count", over("entries", """
SELECT id, queue, (row_number() OVER (PARTITION BY queue ORDER BY id) - 1) // 10 + 1 AS chunk_no
FROM entries WHERE reason IS NULL AND NOT fifo"""))
def _(spark, d):
    return C.chunks_by_count(entries(spark, d).filter("reason IS NULL AND NOT fifo"))


@query("sqs_chunks", over("entries", "SELECT id, queue, chunk_no FROM walk", """
sized AS (SELECT id, queue, id * 7919 % 300000 + 1 AS size, row_number() OVER (PARTITION BY queue ORDER BY id) AS rn
          FROM entries WHERE reason IS NULL AND NOT fifo),
walk(id, queue, rn, chunk_no, entries, bytes) AS (
  SELECT id, queue, rn, CAST(1 AS BIGINT), CAST(1 AS BIGINT), size FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.id, s.queue, s.rn, chunk_no + CASE WHEN entries >= 10 OR bytes + size > 1048576 THEN 1 ELSE 0 END,
         CASE WHEN entries >= 10 OR bytes + size > 1048576 THEN 1 ELSE entries + 1 END,
         CASE WHEN entries >= 10 OR bytes + size > 1048576 THEN size ELSE bytes + size END
  FROM walk w JOIN sized s ON s.queue = w.queue AND s.rn = w.rn + 1)"""))
def _(spark, d):
    return C.greedy_chunks(sized_standard_entries(spark, d))
