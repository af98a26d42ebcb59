"""Consumer-side removal of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["destination", "deduplication_id"]


def dedup_deliveries(deliveries: DataFrame) -> DataFrame:
    """First arrival of each deduplication id, with how many came.

    ``deliveries`` holds (destination, deduplication_id, id, arrival). Map
    tasks reduce repeats first, so one much repeated id costs a row per task.
    """
    return (deliveries.groupBy(*KEY)
            .agg(F.min_by(F.struct("id", "arrival"), F.struct("arrival", "id")).alias("_first"), F.count(F.lit(1)).alias("copies"))
            .select(*KEY, "_first.id", "_first.arrival", "copies"))


def dedup_stream(deliveries: DataFrame, time_col: str, within: str) -> DataFrame:
    """Streaming form: a repeat within the watermark delay is dropped."""
    return deliveries.withWatermark(time_col, within).dropDuplicatesWithinWatermark(KEY)
