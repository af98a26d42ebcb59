"""Queries on the delivery audit and on consumer-side deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.operators import audit, stats
from sluice.plans.catalog import query
from sluice.plans.messaging import stored_entries, stored_messages
from sluice.plans.monitoring import COUNTER_SQL
from sluice.plans.sqltext import over
from sluice.plans.testdata import batch_log, delivered, events, every, expected
from sluice.streaming.dedup import dedup_deliveries


@query("audit_missing", over("delivered", "SELECT id FROM expected WHERE id NOT IN (SELECT id FROM delivered)"))
def _(spark, d):
    m = stored_messages(spark, d)
    return audit.audit_missing(expected(m), delivered(m))


@query("audit_duplicates", over("delivered", """
SELECT CAST(sum(n) AS BIGINT) AS deliveries, CAST(sum(n - 1) AS BIGINT) AS duplicates,
       count(*) FILTER (WHERE id NOT IN (SELECT id FROM expected)) AS unknown_ids
FROM (SELECT id, count(*) AS n FROM delivered GROUP BY id) c"""))
def _(spark, d):
    m = stored_messages(spark, d)
    return audit.audit_duplicates(expected(m), delivered(m))


@query("audit_order", over("delivered", """
SELECT ordering_key, count(*) AS deliveries, count(*) FILTER (WHERE body < before) AS violations
FROM (SELECT ordering_key, body, lag(body) OVER (PARTITION BY ordering_key ORDER BY arrival) AS before FROM delivered WHERE ordering_key <> '') d
GROUP BY ordering_key"""))
def _(spark, d):
    return audit.audit_order(delivered(stored_messages(spark, d)))


@query("audit_latency", """
SELECT max(n) AS events, max(CASE WHEN rn = greatest(1, CAST(floor(0.5 * n) AS BIGINT)) THEN latency END) AS p50_us,
       max(CASE WHEN rn = greatest(1, CAST(floor(0.9 * n) AS BIGINT)) THEN latency END) AS p90_us,
       max(CASE WHEN rn = greatest(1, CAST(floor(0.99 * n) AS BIGINT)) THEN latency END) AS p99_us, max(latency) AS max_us
FROM (SELECT latency, row_number() OVER (ORDER BY latency) AS rn, count(*) OVER () AS n
      FROM (SELECT CAST(floor(value * 1000) AS BIGINT) AS latency FROM events) l) r""")
def _(spark, d):
    latencies = events(spark, d).select(F.col("event_id").alias("id"), F.floor(F.col("value") * 1000).cast("bigint").alias("latency_us"))
    return audit.audit_latency(latencies)


def samples(spark, d) -> DataFrame:
    """Metric samples, one per batch: what was sent so far and what is left."""
    running = stats.counters_running(batch_log(spark, d)).withColumnsRenamed({"events_sent": "sent_total"})
    lag = batch_log(spark, d).select("batch_no", F.col("oldest_age_s").alias("lag_s"))
    total = batch_log(spark, d).agg(F.sum("sent").alias("total")).scalar()
    rows = running.join(lag, "batch_no").withColumn("_total", total)
    return rows.select((F.col("batch_no") + 1).alias("elapsed_s"), "sent_total", (F.col("_total") - F.col("sent_total")).alias("backlog"), "lag_s")


@query("audit_drain", over("batch_log", """
SELECT (SELECT drain_s FROM done) AS drain_s, (SELECT total / drain_s FROM done) AS events_per_s, max(lag_s) AS max_lag_s, count(*) AS samples
FROM samples WHERE elapsed_s <= (SELECT drain_s FROM done)""", """
samples AS (SELECT batch_no + 1 AS elapsed_s, CAST(sum(sent) OVER (ORDER BY batch_no) AS BIGINT) AS sent_total,
                   CAST(sum(sent) OVER () AS BIGINT) AS total, oldest_age_s AS lag_s FROM batch_log),
done AS (SELECT min(elapsed_s) AS drain_s, max(total) AS total FROM samples WHERE sent_total >= total)"""))
def _(spark, d):
    total = batch_log(spark, d).agg(F.sum("sent").alias("total")).scalar()
    return audit.audit_drain(samples(spark, d), total)


@query("audit_bodies", over("delivered", """
SELECT destination, body, CAST(sum(n) AS BIGINT) AS surplus
FROM (SELECT destination, body, -1 AS n FROM expected UNION ALL SELECT destination, body, 1 FROM delivered) b
GROUP BY destination, body HAVING sum(n) <> 0"""))
def _(spark, d):
    m = stored_messages(spark, d)
    return audit.audit_bodies(expected(m), delivered(m))


@query("audit_counter_delta", over("batch_log", "\nUNION ALL ".join(
    f"SELECT '{n}' AS name, CAST(coalesce(sum({e}) FILTER (WHERE batch_no % 2 = 1), 0) AS DOUBLE) AS delta FROM batch_log"
    for n, e in COUNTER_SQL.items())))
def _(spark, d):
    log = batch_log(spark, d)

    def snapshot(part: DataFrame) -> DataFrame:
        totals = part.agg(*[F.sum(F.expr(e)).cast("double").alias(n) for n, e in stats.COUNTERS.items()])
        return totals.unpivot([], totals.columns, "name", "value")

    return audit.audit_counter_delta(snapshot(log.filter("batch_no % 2 = 0")), snapshot(log))


@query("dedup_deliveries", over("entries", """
SELECT destination, deduplication_id, id, arrival, copies
FROM (SELECT *, row_number() OVER (PARTITION BY destination, deduplication_id ORDER BY arrival, id) AS rn,
             count(*) OVER (PARTITION BY destination, deduplication_id) AS copies
      FROM (SELECT queue AS destination, deduplication_id, id, id * 2 AS arrival FROM entries WHERE reason IS NULL AND fifo
            UNION ALL SELECT queue, deduplication_id, id, id * 2 + 500 FROM entries WHERE reason IS NULL AND fifo AND id % 3 = 0) x) y
WHERE rn = 1"""))
def _(spark, d):
    sent = stored_entries(spark, d).filter("reason IS NULL AND fifo").select(F.col("queue").alias("destination"), "deduplication_id", "id")
    first = sent.withColumn("arrival", F.col("id") * 2)
    again = sent.filter(every(3)).withColumn("arrival", F.col("id") * 2 + 500)
    return dedup_deliveries(first.unionByName(again))
