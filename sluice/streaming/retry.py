"""Ordered delivery with a retry queue per key, as keyed state.

The form for streams of keyed messages alone: a key's unsent messages wait in
its state, a message that is not settled holds back those behind it, and a
timer tries again when nothing new arrives. Keys are independent, so a key's
work is one task's but no other key waits for it. Start the stream under
``settings(spark, KEYED_STATE)`` where the session has Spark's default state
store: that has no lists and timers per key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.functions.once import micros

KEY = ["target", "destination", "order_key"]
WAITING = "id bigint, body string, tries int"
SENT = "target string, destination string, order_key string, id bigint, outcome string, reason string, tries int, place bigint"

# Takes (key, id, body, tries so far) and returns (outcome, reason); no outcome leaves the message waiting.
SendKeyed = Callable[[tuple, int, str, int], tuple[str | None, str | None]]


class RetryQueue(StatefulProcessor):
    """Sends the messages of a key in the order they came, those that wait first."""

    def __init__(self, send: SendKeyed, delay: timedelta) -> None:
        self.send, self.delay_ms = send, max(1, micros(delay) // 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.place = handle.getValueState("place", "place bigint")

    def _work(self, key: tuple, arrived: list[tuple], timer_values) -> Iterator[pd.DataFrame]:
        # Each call on a state is a round trip to the JVM, and most keys have nothing that waits.
        waited = [tuple(w) for w in self.waiting.get()]
        queue, (place,), sent = deque(waited + arrived), self.place.get() or (0,), []
        while queue:
            message, body, tries = queue[0]
            outcome, reason = self.send(key, message, body, tries)
            if outcome is None:
                queue[0] = (message, body, tries + 1)
                break
            place += 1
            sent.append((*key, message, outcome, reason, tries + 1, place))
            queue.popleft()
        if queue:
            self.waiting.put(list(queue))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.delay_ms)
        elif waited:
            self.waiting.clear()
        if sent:
            self.place.update((place,))
            yield pd.DataFrame(sent, columns=[c.split()[0] for c in SENT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).dropna(subset=["id"]).sort_values("id")
        arrived = [(int(i), b, 0) for i, b in zip(frame["id"], frame["body"])]
        if arrived or self.waiting.exists():
            yield from self._work(key, arrived, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield from self._work(key, [], timerValues)

    def close(self) -> None:
        pass


def deliver_in_order(messages: DataFrame, send: SendKeyed, delay: timedelta = timedelta(seconds=1)) -> DataFrame:
    """Settled messages of a stream (target, destination, order_key, id, body), each key in order.

    ``place`` is a message's position among the settled ones of its key and
    ``tries`` how often it was sent. Rows without an id only keep time.
    """
    return messages.groupBy(*KEY).transformWithStateInPandas(RetryQueue(send, delay), SENT, outputMode="Append", timeMode="ProcessingTime")
