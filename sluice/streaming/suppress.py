"""Streaming suppression of repeated failure records."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sluice.operators.failures import suppress_step
from sluice.sources.tables import RelayTables


def suppress_stream(records: DataFrame, window: timedelta, tables: RelayTables, checkpoint: str,
                    trigger: dict) -> StreamingQuery:
    """Emit unsuppressed records of a (signature, at, id) stream into ``emitted``.

    Each micro-batch runs the batch operator from the state its predecessor
    wrote, so a signature with most of the records is still split over tasks.
    State and emissions are replaced, not appended, when a micro-batch replays.
    Silence that is over is dropped from the state once records are a further
    window on, so the state follows the signatures at work, not all ever seen.
    """
    def on_batch(df: DataFrame, epoch: int) -> None:
        state = tables.read_batch("suppression_state", epoch - 1) if epoch else None
        emitted, left = suppress_step(df, window, state, lateness=window)
        tables.write(left, "suppression_state", epoch)
        tables.write(emitted, "emitted", epoch)

    return (records.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


class SuppressionProcessor(StatefulProcessor):
    """Keyed state form of the same rule, for low-latency streams.

    State is two numbers per signature. Records of a signature are taken in
    the order they arrive.
    """

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("silence", "next_at bigint, pending bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_at, pending = self.state.get() if self.state.exists() else (None, 0)
        for pdf in rows:
            emitted = []
            for at, record in zip(pdf["at_us"], pdf["id"]):
                if next_at is not None and at < next_at:
                    pending += 1
                    continue
                emitted.append((key[0], int(at), record, pending))
                next_at, pending = int(at) + self.window_us, 0
            self.state.update((next_at, pending))
            yield pd.DataFrame(emitted, columns=["signature", "at_us", "id", "suppressed_count"])

    def close(self) -> None:
        pass


def suppress_keyed(records: DataFrame, window: timedelta) -> DataFrame:
    """Streaming (signature, at_us, id, suppressed_count) of emitted records.

    Start it under ``settings(spark, KEYED_STATE)`` where the session has Spark's default state store.
    """
    width = int(window.total_seconds() * 1_000_000)
    keyed = records.select("signature", F.unix_micros("at").alias("at_us"), "id").groupBy("signature")
    return keyed.transformWithStateInPandas(
        SuppressionProcessor(width), "signature string, at_us bigint, id bigint, suppressed_count bigint",
        outputMode="Append", timeMode="None")
