"""Queries that run the relay and the stream operators over the test tables."""

from __future__ import annotations

from contextlib import suppress
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.config import PUBSUB, SQS
from sluice.functions.pubsub import PERMANENT_CODES
from sluice.plans.catalog import query
from sluice.plans.messaging import messages
from sluice.plans.monitoring import EMITTED_SQL, HOUR, failure_records
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, NOW, new_tables, outbox
from sluice.session import KEYED_STATE, settings, stored
from sluice.sources.publish import in_order, in_requests
from sluice.sources.tables import COMMITTED, RelayTables
from sluice.streaming.relay import FatalAfterCommit, Relay
from sluice.streaming.retry import SENT, deliver_in_order
from sluice.streaming.suppress import suppress_stream

# One batch for all that is pending, and several: a batch costs some twenty small jobs, whatever it holds.
LARGE = replace(CONFIG, batch_target=1_000_000)
RELAY_TARGET = 1_000
UNTIL_STILL = 1_000_000
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
TOPIC_COLUMNS = ["topic", "ordering_key"]


def send_topic(row) -> tuple[str, str | None, str | None, bool]:
    """Test sender: some messages are unavailable, some are refused for good."""
    if row.id % 13 == 0:
        return "error", "503", "unavailable", False
    if row.id % 17 == 0:
        return "error", "400", f"rejected {row.id}", False
    return "ok", None, None, False


def send_any(row) -> tuple[str, str | None, str | None, bool]:
    return "ok", None, None, False


def send_late(row) -> tuple[str, str | None, str | None, bool]:
    """A topic sender that times out on some messages."""
    return ("deadline", None, "deadline exceeded", False) if row.id % 13 == 0 else ("ok", None, None, False)


def healed_topic(row) -> tuple[str, str | None, str | None, bool]:
    return ("error", "400", f"rejected {row.id}", False) if row.id % 17 == 0 else ("ok", None, None, False)


def queue_sender(later: bool):
    """Test sender of requests: some entries are refused for good, and ``later`` some fail for now."""
    def send(queue: str, entries: pd.DataFrame) -> pd.DataFrame:
        ids = entries["id"].to_numpy()
        fault, wait = ids % 19 == 0, (ids % 23 == 0) & later
        return pd.DataFrame({"id": ids, "status": np.where(fault | wait, "error", "ok"),
                             "code": np.where(fault, "InvalidParameterValue", np.where(wait, "InternalError", None)),
                             "message": np.where(fault, "bad entry", np.where(wait, "try later", None)), "sender_fault": fault})

    return send


def send_all(queue: str, entries: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": entries["id"].to_numpy(), "status": "ok", "code": None, "message": None, "sender_fault": False})


def publishers(topic=send_topic, queue=queue_sender(True)) -> dict:
    return {PUBSUB: in_order(topic, TOPIC_COLUMNS, PERMANENT_CODES), SQS: in_requests(queue)}


TEST_OUTCOMES = """
judged AS (
  SELECT id, true AS topical, topic AS dest, ordering_key AS key, ordering_key <> '' AND id % 13 = 0 AS blocking,
         CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'poison' ELSE 'confirmed' END AS outcome
  FROM messages WHERE reason IS NULL
  UNION ALL
  SELECT id, false, queue, CASE WHEN fifo THEN message_group_id ELSE '' END, fifo AND id % 23 = 0 AND id % 19 <> 0,
         CASE WHEN id % 19 = 0 THEN 'poison' WHEN id % 23 = 0 THEN NULL ELSE 'confirmed' END
  FROM entries WHERE reason IS NULL),
stops AS (SELECT dest, key, min(id) AS stop FROM judged WHERE blocking GROUP BY dest, key),
refused AS (SELECT id, reason FROM messages WHERE reason IS NOT NULL UNION ALL SELECT id, reason FROM entries WHERE reason IS NOT NULL
            UNION ALL SELECT id, reason FROM triaged WHERE triage <> 'dispatch'),
first AS (SELECT t.id, r.id IS NOT NULL AS refused, topical, j.dest, j.key, stop IS NULL OR t.id <= stop AS attempted,
                 CASE WHEN stop IS NULL OR t.id <= stop THEN outcome END AS outcome
          FROM triaged t LEFT JOIN refused r USING (id) LEFT JOIN judged j USING (id) LEFT JOIN stops s ON s.dest = j.dest AND s.key = j.key),
kept AS (SELECT * FROM first WHERE NOT refused AND outcome IS NULL)"""


def relayed(spark, d, target: int) -> RelayTables:
    """Tables of a streaming relay that outlives an outage.

    Rows arrive in three parts, ids dealt out so that low ones come late. The
    stream takes two of them while the senders are flaky, two batches each;
    then it starts again from its checkpoint with the last part and sound
    senders, and runs batch after batch until nothing is pending.
    """
    tables = new_tables(spark)
    box, stored = outbox(spark, d), tables.path("source")
    for part, senders, most in ((2, publishers(), 2), (1, publishers(), 2), (0, publishers(healed_topic, queue_sender(False)), UNTIL_STILL)):
        box.filter(F.col("id") % 3 == part).write.mode("append").parquet(stored)
        arrivals = spark.readStream.schema(box.schema).parquet(stored)
        relay = Relay(replace(CONFIG, batch_target=target), tables, senders, clock=lambda: NOW, batches=most, compact_every=4)
        relay.start(arrivals, tables.path("checkpoint"), {"availableNow": True}).awaitTermination()
    return tables


@query("stream_relay", over("messages entries", """
SELECT id, 'poison' AS outcome, reason FROM refused
UNION ALL SELECT id, CASE WHEN id % 17 = 0 THEN 'poison' ELSE 'confirmed' END, CASE WHEN id % 17 = 0 THEN 'rejected ' || CAST(id AS VARCHAR) END
FROM messages WHERE reason IS NULL
UNION ALL SELECT id, CASE WHEN id % 19 = 0 THEN 'poison' ELSE 'confirmed' END, CASE WHEN id % 19 = 0 THEN 'InvalidParameterValue: bad entry' END
FROM entries WHERE reason IS NULL""", TEST_OUTCOMES))
def _(spark, d):
    """Arrivals through the streaming relay, several batches a trigger, until all is settled."""
    return relayed(spark, d, RELAY_TARGET).settled().select("id", "outcome", "reason")


class Crash(BaseException):
    """Ends a relay without giving it a chance to log anything."""


class CrashingTables(RelayTables):
    """Tables of a relay that dies right before its commit."""

    def write(self, df, name, batch_id):
        if name == "batch_log":
            raise Crash
        super().write(df, name, batch_id)


@query("commit_rule", over("messages entries", """
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(attempt AS BIGINT) AS attempt, state, CAST(selected AS BIGINT) AS selected, CAST(sent AS BIGINT) AS sent,
       CAST(dlq AS BIGINT) AS dlq, CAST(kept AS BIGINT) AS kept, CAST(errors AS BIGINT) AS sender_errors, CAST(fatal AS BIGINT) AS fatal,
       CAST(1 AS BIGINT) AS batch_errors FROM (
  SELECT 0 AS batch_id, 0 AS attempt, 'failed' AS state, 0 AS selected, 0 AS sent, 0 AS dlq, 0 AS kept, 0 AS errors, 0 AS fatal
  UNION ALL SELECT 0, 1, 'crashed', 0, 0, 0, 0, 0, 0
  UNION ALL SELECT 0, 2, 'committed', count(*), count(*) FILTER (WHERE outcome = 'confirmed'), count(*) FILTER (WHERE refused OR outcome = 'poison'),
    count(*) FILTER (WHERE NOT refused AND outcome IS NULL), count(*) FILTER (WHERE topical AND attempted AND outcome IS NULL), 0 FROM first
  UNION ALL SELECT 1, 0, 'committed', count(*), count(*) FILTER (WHERE NOT topical), 0, count(*) FILTER (WHERE topical),
    count(*) FILTER (WHERE topical AND key = '') + 2 * count(DISTINCT dest || '|' || key) FILTER (WHERE topical AND key <> ''),
    CASE WHEN bool_or(topical AND key <> '') THEN 1 ELSE 0 END FROM kept
  UNION ALL SELECT 2, 0, 'committed', count(*), count(*), 0, 0, 0, 0 FROM kept WHERE topical) a""", TEST_OUTCOMES))
def _(spark, d):
    """Attempts at batches: one that lacks a sender, one cut short by a crash, one with sender errors, a fatal one, one that ends it."""
    tables, box = new_tables(spark), outbox(spark, d)
    flaky = Relay(LARGE, tables, publishers(), clock=lambda: NOW)
    runs = [(replace(flaky, publishers={PUBSUB: publishers()[PUBSUB]}), ValueError),
            (replace(flaky, tables=CrashingTables(tables.spark, tables.root)), Crash), (flaky, ()),
            (replace(flaky, publishers=publishers(send_late, send_all)), FatalAfterCommit), (replace(flaky, publishers=publishers(send_any, send_all)), ())]
    for relay, expected in runs:
        with suppress(expected):
            relay.run_batch(box, tables.next_batch_id())
    counts = ["selected", "sent", "dlq", "kept", "sender_errors", "fatal"]
    commits = tables.batch_commits().select("batch_id", F.lit(COMMITTED).alias("state"), *counts)
    errors = tables.batch_log().agg(F.sum("failed")).scalar()
    return tables.states().join(commits, ["batch_id", "state"], "left").select(
        "batch_id", F.col("attempt").cast("bigint").alias("attempt"), "state", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], errors.alias("batch_errors"))


def send_second_time(key: tuple, message: int, body: str, tries: int) -> tuple[str | None, str | None]:
    """Test sender: some messages are unavailable at first, some are refused for good."""
    if message % 13 == 0 and not tries:
        return None, None
    return ("poison", f"rejected {message}") if message % 17 == 0 else ("confirmed", None)


@query("stream_retry_order", over("messages", """
SELECT topic, ordering_key, id, row_number() OVER (PARTITION BY topic, ordering_key ORDER BY late, id) AS place, CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END AS tries,
       CASE WHEN id % 17 = 0 THEN 'poison' ELSE 'confirmed' END AS outcome, CASE WHEN id % 17 = 0 THEN 'rejected ' || CAST(id AS VARCHAR) END AS reason
FROM (SELECT *, id % 3 = 0 AS late FROM messages WHERE reason IS NULL AND ordering_key <> '') m"""))
def _(spark, d):
    """Keyed messages through the retry queues over several micro-batches: what waits goes out before what arrives later."""
    tables = new_tables(spark)
    source, out = tables.path("source"), tables.path("sent")
    rows = messages(spark, d).filter("reason IS NULL AND ordering_key <> ''").selectExpr(
        f"'{PUBSUB}' AS target", "topic AS destination", "ordering_key AS order_key", "id", "CAST(data AS STRING) AS body")
    rows = stored(rows)
    total = rows.count()

    def step(arriving: DataFrame) -> None:
        arriving.write.mode("append").parquet(source)
        stream = deliver_in_order(spark.readStream.schema(rows.schema).parquet(source), send_second_time, timedelta(milliseconds=1))
        # Timers alone would start batch after batch, so a run over what is there would not end.
        with settings(spark, KEYED_STATE | {NO_DATA_BATCHES: "false"}):
            (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", tables.path("checkpoint"))
             .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    step(rows.filter("id % 3 <> 0"))
    step(rows.filter("id % 3 = 0"))
    # Nothing arrives any more; a row without an id keeps time for the keys that still wait.
    heartbeat = rows.limit(0).unionByName(spark.range(1).selectExpr("'' AS target", "'' AS destination", "'' AS order_key", "CAST(NULL AS BIGINT) AS id", "'' AS body"))
    sent = spark.read.schema(SENT).parquet(out)
    while sent.count() < total:
        step(heartbeat)
        sent = spark.read.schema(SENT).parquet(out)
    return sent.select(F.col("destination").alias("topic"), F.col("order_key").alias("ordering_key"), "id", "place", "tries", "outcome", "reason")


@query("stream_suppress_failures", EMITTED_SQL)
def _(spark, d):
    """Failure records arriving in time order: a slice of history, then a run of the stream over what is new."""
    tables = new_tables(spark)
    records = failure_records(spark, d)
    stored = tables.path("source")
    for part in ("at < '2024-01-11'", "at >= '2024-01-11' AND at < '2024-01-21'", "at >= '2024-01-21'"):
        records.filter(part).write.mode("append").parquet(stored)
        arrivals = spark.readStream.schema(records.schema).parquet(stored)
        suppress_stream(arrivals, HOUR, tables, tables.path("checkpoint"), {"availableNow": True}).awaitTermination()
    emitted = tables.read("emitted", "signature string, at timestamp, id bigint, suppressed_count bigint")
    return emitted.select("signature", F.unix_micros("at").alias("at_us"), "id", "suppressed_count")
