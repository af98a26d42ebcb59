"""Delivery audit: completeness, duplicates, order, latency and drain rate.

Delivered rows hold (id, destination, ordering_key, body, arrival), expected
rows at least (id, destination, body). Deliveries may repeat ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators.ranking import previous_values, running_sums
from sluice.session import stored


def audit_missing(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Expected ids that never arrived."""
    return expected.select("id").join(delivered.select("id").distinct(), "id", "left_anti")


def audit_duplicates(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: deliveries, repeats beyond the first, and unknown ids."""
    counted = delivered.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = expected.select("id").distinct().withColumn("_known", F.lit(True))
    return counted.join(known, "id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("deliveries"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("_known").isNull()).alias("unknown_ids"))


def audit_order(delivered: DataFrame) -> DataFrame:
    """Out-of-order deliveries per key; an adjacent repeat is no violation."""
    keyed = delivered.filter("ordering_key <> ''").select("ordering_key", "body", "arrival")
    stepped = previous_values(keyed, ["ordering_key"], "arrival", {"_before": "body"})
    return stepped.groupBy("ordering_key").agg(
        F.count(F.lit(1)).alias("deliveries"), F.count_if(F.col("body") < F.col("_before")).alias("violations"))


def audit_latency(latencies: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Latency at index int(p * n) - 1 of the sorted list, and the maximum.

    ``latencies`` holds (id, latency_us). No row is numbered: distinct values
    are counted, running counts are taken inside ranges of values and across
    the ranges, and a rank falls on the value whose running count reaches it.
    """
    histogram = stored(latencies.groupBy("latency_us").agg(F.count(F.lit(1)).alias("_n")))
    running = running_sums(histogram, [], "latency_us", {"_upto": "_n"})
    placed = running.withColumn("_total", histogram.agg(F.sum("_n")).scalar())

    def at(p: float) -> Column:
        rank = F.least(F.greatest(F.floor(F.lit(p) * F.col("_total")), F.lit(1)), F.col("_total"))
        return F.min(F.when(F.col("_upto") >= rank, F.col("latency_us")))

    return placed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events"),
        *[at(p).alias(f"p{round(p * 100)}_us") for p in percentiles],
        F.max("latency_us").alias("max_us"))


def audit_drain(samples: DataFrame, events: int | Column) -> DataFrame:
    """Drain report from metric samples (elapsed_s, sent_total, backlog, lag_s).

    Samples after the first drained one are ignored; without one the report
    has no duration.
    """
    wanted = events if isinstance(events, Column) else F.lit(events)
    sized = samples.withColumn("_wanted", wanted)
    done = sized.filter((F.col("sent_total") >= F.col("_wanted")) & (F.col("backlog") == 0))
    drained = sized.withColumn("_end", done.agg(F.min("elapsed_s")).scalar())
    seen = drained.filter(F.col("_end").isNull() | (F.col("elapsed_s") <= F.col("_end")))
    return seen.agg(F.max("_end").alias("drain_s"), (F.max("_wanted") / F.max("_end")).alias("events_per_s"),
                    F.max("lag_s").alias("max_lag_s"), F.count(F.lit(1)).alias("samples"))


def audit_bodies(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Bodies per destination whose delivered count differs from the expected one."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select("destination", "body", F.lit(sign).cast("bigint").alias("_n"))

    both = signed(expected, -1).unionByName(signed(delivered, 1))
    return both.groupBy("destination", "body").agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def audit_counter_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each metric between two (name, value) snapshots."""
    old = before.select("name", F.col("value").alias("_old"))
    rows = after.select("name", "value").join(old, "name", "left")
    return rows.select("name", (F.col("value") - F.coalesce("_old", F.lit(0.0))).alias("delta"))
