"""Bounded backlog probe and the backlog gauge."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from sluice.config import RelayConfig
from sluice.operators.ranking import oldest
from sluice.operators.routing import with_routes

# Fixed value: probe spacing when no statistics interval is set.
FALLBACK_INTERVAL = timedelta(seconds=10)


def backlog_probe(df: DataFrame, cfg: RelayConfig, limit: int | None = None) -> DataFrame:
    """Routable rows among the oldest ``limit``; capped when the limit was hit."""
    limit = cfg.backlog_limit if limit is None else limit
    narrow = df.select(*dict.fromkeys(c for c in (cfg.id_col, cfg.target_col, cfg.destination_col) if c))
    head = with_routes(oldest(narrow, cfg.id_col, limit), cfg)
    counted = head.agg(F.count_if("routable").alias("routable"), F.count(F.lit(1)).alias("scanned"))
    return counted.withColumn("capped", F.col("scanned") >= limit)


def backlog_gauge(drained: DataFrame, kept: DataFrame, previous: DataFrame, probe: DataFrame | None,
                  since_probe: timedelta, stats_interval: timedelta | None = None) -> DataFrame:
    """One row (backlog, floor) after a batch.

    ``drained`` and ``kept`` are single rows of the batch, ``previous`` the
    gauge so far. A drained batch proves what it left; otherwise the probe
    answers, at most once per interval, or without a probe what was kept is a
    floor.
    """
    base = (previous.select(F.col("backlog").alias("_old"), F.col("floor").alias("_old_floor"))
            .withColumn("_drained", drained.select("drained").scalar())
            .withColumn("_kept", kept.select("kept").scalar()))
    if probe is None:
        value, floor = F.col("_kept"), F.lit(True)
    elif since_probe < (stats_interval or FALLBACK_INTERVAL):
        value, floor = F.col("_old"), F.col("_old_floor")
    else:
        base = (base.withColumn("_probe", probe.select("routable").scalar())
                .withColumn("_capped", probe.select("capped").scalar()))
        value, floor = F.col("_probe"), F.col("_capped")
    return base.select(F.when(F.col("_drained"), F.col("_kept")).otherwise(value).alias("backlog"),
                       F.when(F.col("_drained"), F.lit(False)).otherwise(floor).alias("floor"))
