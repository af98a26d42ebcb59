"""Outcome rules and the relay loop end to end."""

import json
import os
import uuid
from dataclasses import replace
from datetime import datetime, timezone

import pytest

from sluice.config import PUBSUB, SQS, Backend, RelayConfig
from sluice.functions.pubsub import PERMANENT_CODES
from sluice.operators import outcomes, settle
from sluice.session import shared_dir
from sluice.sources.publish import in_order
from sluice.sources.tables import RelayTables, read_dead_letters
from sluice.streaming.relay import FatalAfterCommit, Relay

NOW = datetime(2026, 6, 23, 12, tzinfo=timezone.utc)
CFG = RelayConfig(backends=(Backend(PUBSUB), Backend(SQS)), dlq_table="dlq", batch_target=100)
LAYOUT = "id bigint, timestamp timestamp, payload string, target string, destination string, options string"
ATTEMPTS = "id bigint, seq bigint, attempt int, status string, code string, message string, sender_fault boolean"


def messages(spark, keys):
    return spark.createDataFrame([(i, "t", k, None) for i, k in keys.items()], "id bigint, topic string, ordering_key string, reason string")


def attempts(spark, reports):
    rows = [(i, n, a, s, c, f"m{i}", False) for n, (i, a, s, c) in enumerate(reports)]
    return spark.createDataFrame(rows, ATTEMPTS)


def test_pubsub_rules(spark):
    reports = [(1, 1, "ok", None), (2, 1, "deadline", None), (3, 1, "error", "503"),
               (4, 1, "error", "400"), (4, 2, "ok", None), (5, 1, "error", "400"), (5, 2, "error", "OutOfRange"),
               (6, 1, "error", "400"), (6, 2, "error", "503"), (7, 1, "error", "400"), (7, 2, "deadline", None)]
    for key, errors, fatal in (("", [0, 1, 1, 0, 0, 2, 2, 0], [False] * 8),
                               ("k", [0, 2, 1, 0, 0, 1, 2, 0], [False, True, False, False, False, False, True, False])):
        got = outcomes.pubsub_outcomes(messages(spark, {i: key for i in range(1, 9)}), attempts(spark, reports)).orderBy("id").collect()
        assert [r["outcome"] for r in got] == ["confirmed", None, None, "confirmed", "poison", None, None, None]
        assert [r["errors"] for r in got] == errors and [r["fatal"] for r in got] == fatal
        assert got[4]["reason"] == "m5"


def test_head_of_line(spark):
    reports = [(1, 1, "ok", None), (2, 1, "error", "400"), (2, 2, "error", "400"), (3, 1, "error", "503"), (4, 1, "ok", None), (5, 1, "ok", None)]
    got = outcomes.pubsub_ordered_outcomes(messages(spark, {1: "a", 2: "a", 3: "a", 4: "a", 5: "b"}), attempts(spark, reports)).orderBy("id").collect()
    assert [r["attempted"] for r in got] == [True, True, True, False, True]
    assert [r["outcome"] for r in got] == ["confirmed", "poison", None, None, "confirmed"]


def test_sqs_rules(spark):
    entries = spark.createDataFrame([(i, "q", "", False, None, 1 + (i > 6)) for i in range(1, 9)],
                                    "id bigint, queue string, message_group_id string, fifo boolean, reason string, chunk_no bigint")
    said = [(1, "ok", None, None, False), (2, "error", "Bad", "why", True), (3, "error", "Internal", "later", False),
            (5, "request_error", "InvalidMessageContents", "chars", False), (7, "request_error", "Throttled", "slow", False),
            (8, "request_error", "Throttled", "slow", False)]
    responses = spark.createDataFrame([(i, i, s, c, m, f) for i, s, c, m, f in said],
                                      "id bigint, seq bigint, status string, code string, message string, sender_fault boolean")
    got = {r["id"]: (r["outcome"], r["reason"], r["errors"]) for r in outcomes.sqs_outcomes(entries, responses).collect()}
    assert got == {1: ("confirmed", None, 0), 2: ("poison", "Bad: why", 0), 3: (None, None, 0), 4: (None, None, 0),
                   5: (None, None, 0), 6: (None, None, 0), 7: (None, None, 1), 8: (None, None, 0)}


def test_refused_chunk_is_settled_by_isolated_sends(spark):
    entries = spark.createDataFrame([(i, "q", "", False, None, 1 + (i > 4)) for i in range(1, 6)],
                                    "id bigint, queue string, message_group_id string, fifo boolean, reason string, chunk_no bigint")
    whole = ("request_error", "InvalidMessageContents", "chars", False)
    said = [(i, 1, *whole) for i in range(1, 6)] + [(1, 2, "ok", None, None, False), (2, 2, "ok", None, None, False), (3, 2, *whole),
                                                    (4, 2, "request_error", "Throttled", "slow", False)]
    responses = spark.createDataFrame(said, "id bigint, seq bigint, status string, code string, message string, sender_fault boolean")
    got = {r["id"]: (r["outcome"], r["reason"], r["errors"]) for r in outcomes.sqs_outcomes(entries, responses).collect()}
    assert got == {1: ("confirmed", None, 0), 2: ("confirmed", None, 0), 3: ("poison", "chars", 0), 4: (None, None, 1), 5: ("poison", "chars", 0)}


def test_lone_entries_are_poisoned_and_larger_chunks_isolated(spark):
    chunks = spark.createDataFrame([(1, "q", 1), (2, "q", 2), (3, "q", 2), (4, "q", 3)], "id bigint, queue string, chunk_no bigint")
    errors = spark.createDataFrame([("q", 1, "BatchRequestTooLong", "big"), ("q", 2, "BatchRequestTooLong", "big"), ("q", 3, "Throttled", "slow")],
                                   "queue string, chunk_no bigint, code string, message string")
    got = {r["id"]: (r["action"], r["reason"]) for r in outcomes.sqs_isolation_plan(chunks, errors).collect()}
    assert got == {1: ("poison", "big"), 2: ("isolate", None), 3: ("isolate", None), 4: ("keep", None)}


def test_poison_counts_once(spark):
    batch, done = spark.range(4), spark.createDataFrame([(0, "confirmed", None), (1, "poison", "x")], "id bigint, outcome string, reason string")
    errors = spark.createDataFrame([(2, False), (1, True)], "errors bigint, fatal boolean")
    for dead_letter, poison, dlq in ((True, 0, 1), (False, 1, 0)):
        row = settle.batch_stats(batch, done, errors, dead_letter).first().asDict()
        assert row == {"selected": 4, "sent": 1, "poison": poison, "dlq": dlq, "kept": 2, "sender_errors": 3, "fatal": 1}


def test_dead_letter_document(spark):
    row = (1, datetime(2026, 1, 2, 3, 4, 5, 120000), "p", None, "d", '{"b": 1, "a": {"z": [1, "x"]}}', "old", bytearray(b'{"k":1}'), "pubsub", "d")
    df = spark.createDataFrame([(*row, "why"), (*row, "")], LAYOUT + ", ordering_key string, blob binary, resolved_target string, resolved_destination string, reason string")
    base = df.columns[:8]
    with_reason, without = (json.loads(r["event"]) for r in settle.dead_letters(df, base, CFG, NOW).collect())
    assert with_reason.pop("error") == "why"
    assert with_reason == without == {
        "dead_lettered_at": "2026-06-23T12:00:00Z", "destination": "d", "target": "pubsub", "source_schema": "public", "source_table": "events",
        "original_event": {"id": 1, "timestamp": "2026-01-02T03:04:05.12Z", "payload": "p", "target": None, "destination": "d",
                           "options": {"b": 1, "a": {"z": [1, "x"]}}, "ordering_key": "old", "blob": {"k": 1}}}


def ok(row):
    return "ok", None, None, False


def recorder(folder, send=ok):
    """Senders that note every delivery in a file of their task."""
    def sending(kind, key):
        def run(row):
            result = send(row)
            if result[0] == "ok":
                with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex[:6]}", "a") as out:
                    out.write(json.dumps([kind, getattr(row, key[0]), getattr(row, key[1]), row.id]))
            return result

        return in_order(run, key, PERMANENT_CODES if kind == PUBSUB else ())

    return {PUBSUB: sending(PUBSUB, ["topic", "ordering_key"]), SQS: sending(SQS, ["queue", "order_group"])}


def delivered(folder):
    names = sorted(os.listdir(folder), key=lambda n: os.stat(f"{folder}/{n}").st_mtime_ns)
    return [json.loads(open(f"{folder}/{n}").read()) for n in names]


def new_relay(spark, folder, send=ok, **changes):
    tables = RelayTables(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return Relay(replace(CFG, **changes), tables, recorder(folder, send), clock=lambda: NOW)


def outbox(spark, rows):
    return spark.createDataFrame([(i, NOW, p, t, d, o) for i, p, t, d, o in rows], LAYOUT)


def keyed(target, key):
    return json.dumps({"pubsub": {"orderingKey": key}} if target == PUBSUB else {"sqs": {"messageGroupId": key}})


def test_mixed_delivery_retry_order_and_dead_letters(spark, tmp_path):
    """Poison is dead-lettered, a broken queue stays, a failing key keeps its order across batches."""
    rows = [(i, "p", PUBSUB, "topic-a", None) for i in range(12)]
    rows += [(100 + i, "p", PUBSUB, "topic-a", keyed(PUBSUB, f"k{i % 2}")) for i in range(12)]
    rows += [(200 + i, "p", SQS, "queue", None) for i in range(15)]
    rows += [(300 + i, "p", SQS, "queue.fifo", keyed(SQS, f"g{i % 2}")) for i in range(8)]
    rows += [(400, "", SQS, "queue", None), (401, "p", PUBSUB, "bad/topic", None), (402, "p", SQS, "queue", "{bad"), (403, "p", "kafka", "x", None)]
    rows += [(500 + i, "p", SQS, "missing", None) for i in range(3)]
    box = outbox(spark, rows)

    def flaky(row):
        if row.id in (104, 302) or row.id >= 500:
            return "error", "503", "unavailable", False
        return "ok", None, None, False

    relay = new_relay(spark, tmp_path, flaky, batch_target=500)
    first = relay.run_batch(box, 0)
    # 104 holds back 106, 108, 110 of its key; 302 holds back 304, 306.
    assert (first["selected"], first["dlq"], first["kept"], first["sent"]) == (53, 3, 4 + 3 + 3, 40)
    again = replace(relay, publishers=recorder(tmp_path, lambda r: flaky(r) if r.id >= 500 else ok(r)))
    log = again.drain(box)
    assert [r["kept"] for r in log] == [3, 3]
    sent = delivered(tmp_path)
    assert len(sent) == len({s[3] for s in sent}) == 12 + 12 + 15 + 8
    for key in ("k0", "k1", "g0", "g1"):
        ids = [s[3] for s in sent if s[2] == key]
        assert ids == sorted(ids) and ids
    letters = {r["id"]: r["error"] for r in read_dead_letters(relay.tables.dead_letters()).collect()}
    assert letters == {400: "Event is invalid for SQS", 401: "Pub/Sub topic name is syntactically invalid",
                       402: "malformed event options: options column must be valid JSON"}


def test_batches_of_one_queue(spark, tmp_path):
    box = outbox(spark, [(i, "p", SQS, "q", None) for i in range(250)])
    log = new_relay(spark, tmp_path).drain(box)
    assert [(r["selected"], r["drained"]) for r in log] == [(100, False), (100, False), (50, True)]
    assert sorted(s[3] for s in delivered(tmp_path)) == list(range(250))


def test_nothing_is_lost_when_a_batch_dies(spark, tmp_path):
    """A batch killed while publishing, then one killed before its log row, are both delivered again."""
    box = outbox(spark, [(i, "p", SQS, "q.fifo", keyed(SQS, "g")) for i in range(60)])

    def dying(row):
        if row.id == 30:
            raise RuntimeError("killed")
        return "ok", None, None, False

    relay = new_relay(spark, tmp_path, dying)
    with pytest.raises(Exception, match="killed"):
        relay.run_batch(box, 0)
    assert relay.tables.settled().isEmpty() and relay.tables.next_batch_id() == 0

    class Unlogged(RelayTables):
        def write(self, df, name, batch_id):
            if name == "batch_log":
                raise RuntimeError("killed before commit")
            super().write(df, name, batch_id)

    healthy = replace(relay, publishers=recorder(tmp_path))
    with pytest.raises(RuntimeError, match="before commit"):
        replace(healthy, tables=Unlogged(spark, relay.tables.root)).run_batch(box, 0)
    assert relay.tables.settled().isEmpty()
    healthy.drain(box)
    assert relay.tables.settled().filter("outcome = 'confirmed'").count() == 60
    assert {s[3] for s in delivered(tmp_path)} == set(range(60))


def test_a_target_without_publisher_fails_the_batch(spark, tmp_path):
    box = outbox(spark, [(1, "p", PUBSUB, "topic-a", None), (2, "p", SQS, "q", None)])
    relay = new_relay(spark, tmp_path)
    with pytest.raises(ValueError, match="no publisher"):
        replace(relay, publishers={PUBSUB: relay.publishers[PUBSUB]}).run_batch(box, 0)
    assert relay.tables.settled().isEmpty() and not delivered(tmp_path)


def test_a_deadline_on_a_key_commits_then_stops(spark, tmp_path):
    box = outbox(spark, [(i, "p", PUBSUB, "topic-a", keyed(PUBSUB, "k")) for i in range(4)])
    relay = new_relay(spark, tmp_path, lambda r: ("deadline", None, "slow", False) if r.id == 2 else ("ok", None, None, False))
    with pytest.raises(FatalAfterCommit):
        relay.run_batch(box, 0)
    assert sorted(r["id"] for r in relay.tables.settled().collect()) == [0, 1]
    assert relay.tables.batch_log().first()["sender_errors"] == 2


def test_a_replayed_micro_batch_stores_arrivals_once(spark, tmp_path):
    relay = new_relay(spark, tmp_path)
    box = outbox(spark, [(i, "p", SQS, "q", None) for i in range(5)])
    for _ in range(2):
        relay.tables.write(box, "arrivals", 0)
    assert relay.arrived(box).count() == 5
    relay.drain(relay.arrived(box))
    assert len(delivered(tmp_path)) == 5
