"""Producing outbox rows: bulk load and generated workloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sluice.config import SQS
from sluice.functions.once import first_match, instant
from sluice.session import shuffle_width

EXPLODE_ROWS = 10_000


def produce_events(events: DataFrame, now: datetime) -> DataFrame:
    """Outbox rows from (payload, target, destination, ordering_key).

    Empty route columns become NULL; an ordering key becomes the options of
    its provider.
    """
    as_sqs = "to_json(struct(struct(ordering_key AS messageGroupId) AS sqs))"
    as_pubsub = "to_json(struct(struct(ordering_key AS orderingKey) AS pubsub))"
    options = first_match(("coalesce(ordering_key, '') = ''", "NULL"), (f"target = '{SQS}'", as_sqs), otherwise=as_pubsub)
    return events.selectExpr(f"{instant(now)} AS timestamp", "payload", "nullif(target, '') AS target",
                             "nullif(destination, '') AS destination", f"{options} AS options")


def uniform_count(total: Column, index: Column, parts: Column) -> Column:
    """Even split; the remainder goes to the first parts."""
    base = F.floor(total / parts).cast("bigint")
    return base + F.when(index < total - base * parts, 1).otherwise(0)


def power_law_count(total: Column, index: Column, parts: Column) -> Column:
    """Each part takes half of what is left, rounded up; the last takes the rest."""
    # Halving and rounding down k times leaves floor(total / 2^k).
    left = F.floor(total / F.pow(F.lit(2.0), index)).cast("bigint")
    return F.when(index == parts - 1, left).otherwise(F.floor((left + 1) / 2).cast("bigint"))


def _expand(plan: DataFrame, count: str) -> DataFrame:
    """One row per event of each plan row, numbered ``n`` from 1.

    Blocks of numbers are spread over tasks first, so a plan row with most of
    the events is not expanded by one task. The task count is explicit: sized
    by the bytes before the expansion, tasks would be merged into a few.
    """
    blocks = plan.filter(F.col(count) > 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count), F.lit(EXPLODE_ROWS).cast("bigint"))))
    spread = blocks.repartition(shuffle_width(plan.sparkSession), F.xxhash64(*plan.columns, "_from"))
    return spread.withColumn("n", F.explode(F.sequence("_from", F.least(F.col("_from") + EXPLODE_ROWS - 1, F.col(count))))).drop("_from")


def ordered_workload(routes: DataFrame, keys: int) -> DataFrame:
    """Events (id, payload, destination, options) of a mixed ordered workload.

    ``routes`` holds (route, destination, events). Half of each route carries
    ordering keys, with power-law sizes.
    """
    ordered = F.floor(F.col("events") / 2).cast("bigint")
    loose = _expand(routes.select("route", "destination", (F.col("events") - ordered).alias("_count")), "_count")
    unkeyed = loose.select(
        F.concat_ws("/", F.lit("load"), "route", F.lit("free"), "n").alias("id"),
        F.concat(F.lit("load of "), "destination").alias("payload"), "destination", F.lit(None).cast("string").alias("options"))
    key_plan = routes.select("route", "destination", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("key"),
                             ordered.alias("_ordered"))
    sized = key_plan.select("route", "destination", "key",
                            power_law_count(F.col("_ordered"), F.col("key"), F.lit(keys)).alias("_count"))
    key_name = F.concat(F.lit("lane "), F.col("key").cast("string"))
    options = F.to_json(F.struct(F.struct(key_name.alias("orderingKey")).alias("pubsub"),
                                 F.struct(key_name.alias("messageGroupId")).alias("sqs")))
    keyed = _expand(sized, "_count").select(
        F.concat_ws("/", F.lit("load"), "route", "key", "n").alias("id"),
        F.concat(F.lit("load of "), "destination").alias("payload"), "destination", options.alias("options"))
    return unkeyed.unionByName(keyed)


def plain_workload(routes: DataFrame) -> DataFrame:
    """Events (id, payload, destination) with no ordering keys."""
    rows = _expand(routes.select("route", "destination", F.col("events").alias("_count")), "_count")
    return rows.select(
        F.concat_ws("/", F.lit("load"), "route", "n").alias("id"), F.concat(F.lit("load of "), "destination").alias("payload"), "destination")
