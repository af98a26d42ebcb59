"""The outbox, attempts, deliveries and batch log seen over the test tables.

Everything is derived row by row from ``events``, so it grows with the table.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.config import PUBSUB, SQS, Backend, RelayConfig
from sluice.session import configure, shared_dir
from sluice.sources.tables import RelayTables

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
CONFIG = RelayConfig(
    backends=(Backend(PUBSUB, "topic-click"), Backend(SQS, "https://sqs.example/1/q0")),
    timestamp_col="event_ts", batch_target=100, max_age=timedelta(days=7), dlq_table="dead_letters",
    source_table="outbox")


def new_tables(spark: SparkSession) -> RelayTables:
    """Tables under a fresh folder of the shared directory."""
    return RelayTables(configure(spark), f"{shared_dir(spark)}/relay-{uuid4().hex}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def every(n: int, remainder: int = 0, col: str = "id") -> Column:
    return F.col(col) % n == remainder


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows with empty payloads, bad topics, broken options and unknown targets."""
    options = """concat('{"pubsub":{"orderingKey":"user-', user_id, '","attributes":{"type":"', event_type, '","n":', event_id % 7,
        '}},"sqs":{"messageGroupId":"user-', user_id, '","delaySeconds":', event_id % 950, '}}')"""
    queue = "concat('https://sqs.example/1/q', user_id % 3)"
    to_topic = "event_type IN ('click', 'view')"
    return events(spark, sf_dir).selectExpr(
        "event_id AS id", "CAST(ts AS TIMESTAMP) AS event_ts",
        "CASE WHEN event_id % 97 = 0 THEN '' ELSE props END AS payload",
        f"CASE WHEN {to_topic} THEN 'pubsub' WHEN event_type = 'purchase' THEN 'sqs' WHEN event_type = 'signup' THEN '' "
        "WHEN event_id % 2 = 0 THEN 'sqs' ELSE 'kafka' END AS target",
        f"CASE WHEN event_id % 5 = 0 THEN NULL WHEN {to_topic} AND event_id % 53 = 0 THEN 'bad/topic' "
        f"WHEN {to_topic} THEN concat('topic-', event_type) WHEN user_id % 2 = 0 THEN concat({queue}, '.fifo') ELSE {queue} END AS destination",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '{bad' WHEN event_id % 103 = 0 THEN '[]' "
        """WHEN event_id % 107 = 0 THEN '{"pubsub":[],"sqs":[]}' """
        """WHEN event_id % 109 = 0 THEN '{"pubsub":{"orderingKey":42},"sqs":{"messageGroupId":42}}' """
        f"ELSE {options} END AS options")


def attempts(messages: DataFrame) -> DataFrame:
    """Publish attempts of sendable Pub/Sub messages, with retries of permanent errors."""
    first = """struct(id * 2 + 1 AS seq, 1 AS attempt,
        CASE WHEN id % 31 = 0 THEN 'deadline' WHEN id % 17 = 0 OR id % 13 = 0 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN id % 31 = 0 THEN NULL WHEN id % 17 = 0 THEN '400' WHEN id % 13 = 0 THEN '503' END AS code,
        CASE WHEN id % 31 = 0 THEN 'deadline exceeded' WHEN id % 17 = 0 THEN 'bad request' WHEN id % 13 = 0 THEN 'unavailable' END AS message)"""
    second = """struct(id * 2 + 2 AS seq, 2 AS attempt, CASE WHEN id % 34 = 0 THEN 'ok' ELSE 'error' END AS status,
        CASE WHEN id % 34 = 0 THEN NULL WHEN id % 51 = 0 THEN '400' ELSE '503' END AS code,
        CASE WHEN id % 34 = 0 THEN NULL WHEN id % 51 = 0 THEN concat('rejected ', id) ELSE 'unavailable' END AS message)"""
    both = f"inline(CASE WHEN id % 17 = 0 AND id % 31 <> 0 THEN array({first}, {second}) ELSE array({first}) END)"
    return messages.filter("reason IS NULL").selectExpr("id", both).selectExpr("*", "false AS sender_fault")


def responses(entries: DataFrame) -> DataFrame:
    """SQS responses to ``entries`` with their chunks.

    Some chunks fail for now, some are refused for good and their entries sent
    again alone; some entries of an answered request are not mentioned.
    """
    together = "OVER (PARTITION BY queue, chunk_no, CASE WHEN fifo THEN id END)"
    requests = entries.filter("reason IS NULL").selectExpr(
        "id", f"NOT fifo AND max(id % 59 = 0) {together} AS failed", f"NOT fifo AND max(id % 47 = 0) {together} AS refused",
        f"count(*) {together} AS members")

    def said(attempt: int, status: str, code: str | None = None, message: str | None = None, fault: bool = False) -> str:
        given = [f"'{v}'" if v else "CAST(NULL AS STRING)" for v in (status, code, message)]
        return f"struct(id * 2 + {attempt} AS seq, {attempt} AS attempt, {given[0]} AS status, {given[1]} AS code, {given[2]} AS message, {str(fault).lower()} AS sender_fault)"

    later, never = ("ServiceUnavailable", "try later"), ("InvalidMessageContents", "invalid characters")

    def entry(attempt: int) -> str:
        return (f"WHEN id % 29 = 0 THEN NULL WHEN id % 19 = 0 THEN {said(attempt, 'error', 'InvalidParameterValue', 'bad entry', True)} "
                f"WHEN id % 23 = 0 THEN {said(attempt, 'error', 'InternalError', 'try later')} ELSE {said(attempt, 'ok')} END")

    first = f"CASE WHEN failed THEN {said(1, 'request_error', *later)} WHEN refused THEN {said(1, 'request_error', *never)} {entry(1)}"
    second = (f"CASE WHEN failed OR NOT refused OR members = 1 THEN NULL WHEN id % 47 = 0 THEN {said(2, 'request_error', *never)} "
              f"WHEN id % 37 = 0 THEN {said(2, 'request_error', *later)} {entry(2)}")
    return requests.selectExpr("id", f"inline(filter(array({first}, {second}), s -> s IS NOT NULL))")


def request_errors(chunks: DataFrame) -> DataFrame:
    """Failed SQS requests among the chunks."""
    return chunks.select("queue", "chunk_no").distinct().filter("chunk_no % 3 = 0 OR chunk_no % 5 = 0").selectExpr(
        "queue", "chunk_no", "CASE WHEN chunk_no % 3 = 0 THEN 'InvalidMessageContents' ELSE 'ServiceUnavailable' END AS code",
        "CASE WHEN chunk_no % 3 = 0 THEN 'invalid characters' ELSE 'try later' END AS message")


def expected(messages: DataFrame) -> DataFrame:
    return messages.filter("reason IS NULL").selectExpr(
        "id", "topic AS destination", "ordering_key", "lpad(CAST(id AS STRING), 15, '0') AS body")


def delivered(messages: DataFrame) -> DataFrame:
    """Deliveries with losses, repeats, unknown ids and some out of order."""
    copies = """filter(array(
        CASE WHEN id % 41 <> 0 THEN struct(id AS as_id, CASE WHEN id % 59 = 0 THEN id * 4 - 1997 ELSE id * 4 END AS arrival) END,
        CASE WHEN id % 37 = 0 THEN struct(id AS as_id, id * 4 + 1 AS arrival) END,
        CASE WHEN id % 43 = 0 THEN struct(id + 1000000000 AS as_id, id * 4 + 2 AS arrival) END), c -> c IS NOT NULL)"""
    rows = expected(messages).selectExpr("destination", "ordering_key", "body", f"inline({copies})")
    return rows.withColumnRenamed("as_id", "id")


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per hundred events; every thirteenth batch was rolled back."""
    e = events(spark, sf_dir).withColumn("batch_no", F.expr("event_id div 100"))
    failed = F.col("batch_no") % 13 == 5
    counts = e.groupBy("batch_no").agg(
        F.max("ts").cast("timestamp").alias("committed_at"),
        F.count(F.lit(1)).alias("selected"),
        F.count_if(F.col("event_type").isin("click", "view")).alias("sent"),
        F.lit(0).cast("bigint").alias("poison"),
        F.count_if(F.col("event_type") == "error").alias("dlq"),
        F.count_if(F.col("event_type").isin("signup", "purchase")).alias("kept"),
        F.count_if(F.col("event_id") % 31 == 0).alias("sender_errors"),
        F.max(F.when(F.col("event_id") % 997 == 0, 1).otherwise(0)).cast("bigint").alias("fatal"),
        (F.sum("user_id") % 5000).alias("_age"), (F.sum("user_id") % 300).alias("_publish"))
    zeroed = ["selected", "sent", "poison", "dlq", "kept", "sender_errors", "fatal"]
    return counts.select(
        "batch_no", "committed_at", *[F.when(failed, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in zeroed],
        F.when(failed, 1).otherwise(0).cast("bigint").alias("failed"), (F.col("_age") / 8.0).alias("oldest_age_s"),
        (F.col("_publish") / 64.0).alias("publish_s"), (F.col("_publish") / 128.0).alias("db_s"))
