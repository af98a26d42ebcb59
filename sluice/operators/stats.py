"""Counters and gauges over the batch log.

The log has one row per settled batch: batch_no, committed_at, selected, sent,
poison, dlq, kept, sender_errors, fatal, failed, oldest_age_s, publish_s, db_s.
``failed`` is 1 for a batch that was rolled back; its other counts are 0.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from sluice.config import RelayConfig
from sluice.operators.ranking import running_sums

# Counter names and the batch-log expression each one sums.
COUNTERS = {
    "events_selected": "selected",
    "events_sent": "sent",
    "events_poison": "poison",
    "events_dlq": "dlq",
    "events_kept_for_retry": "kept",
    "batches_processed": "1 - failed",
    "batch_errors": "failed",
    "sender_errors": "sender_errors",
    "fatal_after_commit_errors": "fatal",
}


def _with_counters(log: DataFrame) -> DataFrame:
    return log.select("batch_no", "committed_at",
                      *[F.expr(e).cast("bigint").alias(f"_{n}") for n, e in COUNTERS.items()])


def counters_running(log: DataFrame) -> DataFrame:
    """Cumulative counters after each batch."""
    rows = running_sums(_with_counters(log), [], "batch_no", {n: f"_{n}" for n in COUNTERS})
    return rows.select("batch_no", *COUNTERS)


def interval_stats(log: DataFrame, interval: timedelta) -> DataFrame:
    """Counter deltas per interval, one row per interval, quiet ones included."""
    width = int(interval.total_seconds() * 1_000_000)
    ticked = _with_counters(log).withColumn("tick", F.expr(f"unix_micros(committed_at) div {width}"))
    deltas = ticked.groupBy("tick").agg(*[F.sum(f"_{n}").alias(n) for n in COUNTERS])
    ticks = deltas.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi")).alias("tick"))
    return ticks.join(deltas, "tick", "left").select("tick", *[F.coalesce(n, F.lit(0)).alias(n) for n in COUNTERS])


def last_batch_gauges(log: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Gauges of the most recent committed batch; saturated when it was full."""
    names = ["batch_no", "selected", "kept", "oldest_age_s", "publish_s", "db_s", "committed_at"]
    last = log.filter("failed = 0").agg(F.max_by(F.struct(*names), "batch_no").alias("_last"))
    return last.select("_last.*").withColumn("saturated", F.col("selected") >= cfg.batch_target)


def _millis(seconds: str) -> Column:
    return F.round(F.floor(F.col(seconds) * 1000) / 1000, 3)


def metrics_table(log: DataFrame, gauge: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Every metric as (name, type, value); lag only with a timestamp column.

    ``gauge`` is the single (backlog, floor) row.
    """
    totals = _with_counters(log).agg(*[F.coalesce(F.sum(f"_{n}"), F.lit(0)).cast("double").alias(n) for n in COUNTERS])
    last = last_batch_gauges(log, cfg)
    gauges = {
        "collect_batch_target": F.lit(float(cfg.batch_target)),
        "last_batch_selected_events": F.col("selected").cast("double"),
        "events_pending_retry": F.col("kept").cast("double"),
        "oldest_event_age_seconds": _millis("oldest_age_s"),
        "last_batch_db_seconds": _millis("db_s"),
        "last_batch_publish_seconds": _millis("publish_s"),
        "backlog_events": F.col("_backlog").cast("double"),
        "backlog_floor": F.col("_floor").cast("double"),
        "last_successful_batch_timestamp_seconds": F.unix_millis("committed_at") / 1000,
    }
    if not cfg.timestamp_col:
        del gauges["oldest_event_age_seconds"]
    filled = (last.withColumn("_backlog", gauge.select("backlog").scalar())
              .withColumn("_floor", gauge.select(F.col("floor").cast("int")).scalar())
              .select(*[c.alias(n) for n, c in gauges.items()]))

    def unpivot(df: DataFrame, kind: str, suffix: str) -> DataFrame:
        long = df.unpivot([], df.columns, "name", "value")
        return long.select(F.concat("name", F.lit(suffix)).alias("name"), F.lit(kind).alias("type"), "value")

    return unpivot(totals, "counter", "_total").unionByName(unpivot(filled, "gauge", ""))


def health_staleness(log: DataFrame, now: datetime, started: datetime, threshold: timedelta) -> DataFrame:
    """One row: age of the last commit and whether the relay is healthy.

    The start time stands in until the first commit. A threshold of zero or
    less switches the check off.
    """
    last = log.filter("failed = 0").agg(F.greatest(F.max("committed_at"), F.lit(started)).alias("last"))
    age = F.unix_micros(F.lit(now)) - F.unix_micros("last")
    limit = int(threshold.total_seconds() * 1_000_000)
    healthy = F.lit(True) if limit <= 0 else age <= limit
    return last.select((age / 1e6).alias("age_s"), healthy.alias("healthy"))
