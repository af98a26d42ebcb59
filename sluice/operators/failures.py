"""Failure signatures and suppression of repeated failure records."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.config import PUBSUB, SQS
from sluice.functions.once import micros, text
from sluice.functions.pubsub import permanent_error
from sluice.functions.sqs import INVALID_QUEUE, permanent_request_error
from sluice.session import stored

# Windows per block, and blocks per span.
BLOCK_WINDOWS = 16
SPAN_BLOCKS = 64
NEVER = np.iinfo(np.int64).min


def rejection_signatures(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, signature) of rows refused before any publish.

    Pub/Sub messages over a provider limit are logged unconditionally and so
    have no signature. A bad queue URL is one failure per queue.
    """
    from_pubsub = messages.filter("rejected_field IS NOT NULL").selectExpr(
        "id", f"concat_ws('|', '{PUBSUB}', topic, rejected_field, 'malformed-options') AS signature")
    bad_queue = f"reason = {text(INVALID_QUEUE)}"
    from_sqs = entries.filter(f"reason IS NOT NULL AND NOT {bad_queue}").selectExpr(
        "id", f"CASE WHEN rejected_field IS NOT NULL THEN concat_ws('|', '{SQS}', queue, rejected_field, 'malformed-options') "
              f"ELSE concat_ws('|', '{SQS}', queue, given_group, 'local-poison') END AS signature")
    from_queues = entries.filter(bad_queue).groupBy("queue").agg(F.expr("min(id) AS id")).selectExpr(
        "id", f"concat_ws('|', '{SQS}', queue, 'invalid-queue-url') AS signature")
    return from_pubsub.unionByName(from_sqs).unionByName(from_queues)


def attempt_signatures(messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, signature) of failed Pub/Sub attempts.

    A permanent first failure goes to the isolated retry without a record.
    """
    quiet = f"attempt = 1 AND status = 'error' AND {permanent_error('code')}"
    failed = attempts.filter(f"status <> 'ok' AND NOT ({quiet})").select("id", "message")
    rows = failed.join(messages.select("id", "topic", "ordering_key"), "id")
    return rows.selectExpr("id", f"concat_ws('|', '{PUBSUB}', topic, ordering_key, message) AS signature")


def response_signatures(entries: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, signature) of failed SQS sends.

    A failed entry is one failure. A request that failed whole is one, under
    its first entry; one refused for good is a failure only where it held a
    single entry, as otherwise its entries go out again alone.
    """
    rows = entries.filter("reason IS NULL").select("id", "queue", "chunk_no")
    together = "OVER (PARTITION BY queue, chunk_no, CASE WHEN chunk_no IS NULL THEN id END)"
    sized = rows.selectExpr("*", f"count(*) {together} AS _n", f"min(id) {together} AS _first")
    said = responses.filter("status <> 'ok'").join(sized, "id").selectExpr(
        "*", "attempt = 1 AND _n > 1 AS _shared", f"{permanent_request_error('code')} AS _refused")
    entry = said.filter("status = 'error'").selectExpr("id", f"concat_ws('|', '{SQS}', queue, code, message) AS signature")
    request = said.filter("status = 'request_error' AND (NOT _shared OR (id = _first AND NOT _refused))").selectExpr(
        "id", f"concat_ws('|', '{SQS}', queue, message) AS signature")
    return entry.unionByName(request)


def failure_signatures(*records: DataFrame) -> DataFrame:
    """Failure records per signature."""
    union = records[0]
    for more in records[1:]:
        union = union.unionByName(more)
    return union.groupBy("signature").agg(F.count(F.lit(1)).alias("failures"))


def _first_emits(times: np.ndarray, window: int) -> np.ndarray:
    """For each instant, index of the next one outside its silent window."""
    return np.searchsorted(times, times + window, side="left")


def _table(signature: str, block: int, n: int, entries: np.ndarray, exits: np.ndarray, trailing: np.ndarray) -> pd.DataFrame:
    """Summary row; neighbouring entries that lead to the same exit are merged."""
    kept = np.append((exits[1:] != exits[:-1]) | (trailing[1:] != trailing[:-1]), True)
    return pd.DataFrame({"signature": signature, "block": block, "n": n, "entries": [entries[kept].tolist()],
                         "exits": [exits[kept].tolist()], "trailing": [trailing[kept].tolist()]})


def _summarise(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """How one block of a signature's history maps incoming to outgoing silence.

    Silence carried into a block ends within a window of its first instant, so
    only the instants of that window and the next one can be the block's first
    emission. Each maps to the last emission it leads to and the number of
    records after that one.
    """
    pdf = pdf.sort_values("at")
    times, counts = pdf["at"].to_numpy(), pdf["n"].to_numpy()
    size = len(times)
    last = np.arange(size)
    jump = np.append(_first_emits(times, window), size)
    while (jump[:size] < size).any():
        last = np.where(jump[:size] < size, last[np.minimum(jump[:size], size - 1)], last)
        jump = jump[jump]
    width = min(size, int(np.searchsorted(times, times[0] + window, side="left")) + 1)
    ends, total = last[:width], np.cumsum(counts)
    return _table(pdf["signature"].iloc[0], pdf["block"].iloc[0], int(total[-1]), times[:width], times[ends],
                  total[-1] - total[ends] + counts[ends] - 1)


def _through(row, next_at: np.ndarray, pending: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Silence after a block, for every silence carried into it."""
    at = np.searchsorted(row.entries, next_at, side="left")
    emits, place = at < len(row.entries), np.minimum(at, len(row.entries) - 1)
    return (np.where(emits, np.asarray(row.exits)[place] + window, next_at),
            np.where(emits, np.asarray(row.trailing)[place], pending + row.n))


def _compose(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Summary of a span, from the summaries of its blocks in order."""
    rows = list(pdf.sort_values("block").itertuples(index=False))
    entries = exits = trailing = np.empty(0, dtype=np.int64)
    open_until = int(rows[0].entries[0]) + window
    for row in rows:
        exits, trailing = _through(row, exits + window, trailing, window)
        exits = exits - window
        # Silence that outlasts all blocks so far can still end in this one.
        if not len(entries) or entries[-1] < open_until:
            fresh = np.asarray(row.entries)
            entries = np.concatenate([entries, fresh])
            exits = np.concatenate([exits, np.asarray(row.exits)])
            trailing = np.concatenate([trailing, np.asarray(row.trailing)])
    return _table(rows[0].signature, rows[0].span, int(pdf["n"].sum()), entries, exits, trailing)


def _carry(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Walk the summaries of each (signature, span) in order, carrying the silence.

    The first one starts from ``state_at`` and ``state_pending``, which earlier
    records left behind.
    """
    key, next_at, pending = None, NEVER, 0
    for pdf in frames:
        states = []
        for row in pdf.itertuples(index=False):
            if (row.signature, row.span) != key:
                key, next_at, pending = (row.signature, row.span), int(row.state_at), int(row.state_pending)
            before = next_at, pending
            after_at, after_pending = _through(row, np.array([next_at]), np.array([pending]), window)
            next_at, pending = int(after_at[0]), int(after_pending[0])
            states.append((row.signature, row.block, *before, next_at, pending))
        yield pd.DataFrame(states, columns=["signature", "block", "next_at", "pending", "after_at", "after_pending"])


def _emit(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Emitted records of one block, given the silence carried into it."""
    pdf = pdf.sort_values("at")
    times, counts = pdf["at"].to_numpy(), pdf["n"].to_numpy()
    following = _first_emits(times, window)
    before = np.cumsum(counts) - counts
    row = int(np.searchsorted(times, int(pdf["next_at"].iloc[0]), side="left"))
    picked, suppressed, seen = [], [], -int(pdf["pending"].iloc[0])
    while row < len(times):
        picked.append(row)
        suppressed.append(int(before[row]) - seen)
        seen = int(before[row]) + 1
        row = int(following[row])
    return pd.DataFrame({"signature": pdf["signature"].iloc[0], "at": times[picked],
                         "id": pdf["id"].to_numpy()[picked], "suppressed_count": suppressed})


SUMMARY = "signature string, block bigint, n bigint, entries array<bigint>, exits array<bigint>, trailing array<bigint>"
WALKED = "signature string, block bigint, next_at bigint, pending bigint, after_at bigint, after_pending bigint"


def _walk(summaries: DataFrame, width: int) -> DataFrame:
    return (summaries.repartition("signature", "span").sortWithinPartitions("signature", "span", "block")
            .mapInPandas(lambda frames: _carry(frames, width), WALKED))


def suppress_step(records: DataFrame, window: timedelta, state: DataFrame | None = None,
                  lateness: timedelta | None = None) -> tuple[DataFrame, DataFrame]:
    """Emitted records, and the silence left behind per signature.

    ``records`` holds (signature, at, id); ``state`` is what the step over all
    earlier records left, as (signature, state_at, state_pending).

    The window is anchored at the last emitted record, which makes a
    signature's history one long chain. Blocks of windows are summarised in
    parallel, their summaries are composed to spans in parallel, and only the
    spans are walked one after the other. The blocks of each span, then the
    records of each block, follow in parallel from where the walk entered them.
    """
    width = micros(window)
    span = width * BLOCK_WINDOWS
    id_type = records.schema["id"].dataType.simpleString()
    instants = stored(
        records.groupBy("signature", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .withColumn("block", F.expr(f"(at - pmod(at, {span}L)) div {span}L")))
    summaries = stored(instants.groupBy("signature", "block").applyInPandas(lambda pdf: _summarise(pdf, width), SUMMARY)
                       .withColumn("span", F.expr(f"(block - pmod(block, {SPAN_BLOCKS})) div {SPAN_BLOCKS}")))
    spans = summaries.groupBy("signature", "span").applyInPandas(lambda pdf: _compose(pdf, width), SUMMARY)
    if state is None:
        started = spans.withColumns({"state_at": F.lit(NEVER), "state_pending": F.lit(0).cast("bigint")})
    else:
        started = spans.join(state.select("signature", "state_at", "state_pending"), "signature", "left") \
            .fillna({"state_at": NEVER, "state_pending": 0})
    span_states = stored(_walk(started.withColumn("span", F.lit(0).cast("bigint")), width))

    entered = span_states.selectExpr("signature", "block AS span", "next_at AS state_at", "pending AS state_pending")
    block_states = _walk(summaries.join(entered, ["signature", "span"]), width).select("signature", "block", "next_at", "pending")
    emitted = (instants.join(block_states, ["signature", "block"]).groupBy("signature", "block")
               .applyInPandas(lambda pdf: _emit(pdf, width), f"signature string, at bigint, id {id_type}, suppressed_count bigint"))

    left = span_states.groupBy("signature").agg(F.expr("max_by(struct(after_at, after_pending), block) AS s")) \
        .selectExpr("signature", "s.after_at AS state_at", "s.after_pending AS state_pending")
    if state is not None:
        left = left.unionByName(state.select(left.columns).join(left.select("signature"), "signature", "left_anti"))
    if lateness is not None:
        newest = instants.agg(F.max("at")).scalar()
        left = left.filter((F.col("state_pending") > 0) | newest.isNull() | (F.col("state_at") > newest - F.lit(micros(lateness))))
    return emitted.withColumn("at", F.timestamp_micros("at")), left


def suppress_failures(records: DataFrame, window: timedelta) -> DataFrame:
    """Records that get through: the first of a signature, then at most one per window.

    ``suppressed_count`` says how many were silenced since the one before.
    """
    return suppress_step(records, window)[0]
