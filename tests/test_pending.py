"""The log of pending rows, attempts at batches, and the relay that keeps going."""

import time
import uuid
from dataclasses import replace
from datetime import timedelta

import pytest
from check import compare, connect

from sluice.functions.pubsub import PERMANENT_CODES
from sluice.operators import stats
from sluice.plans import streams
from sluice.plans.catalog import load
from sluice.session import KEYED_STATE, settings, shared_dir
from sluice.sources.pending import PendingLog
from sluice.sources.publish import in_order
from sluice.sources.tables import RelayTables
from sluice.streaming.retry import SENT, deliver_in_order
from test_relay import CFG, PUBSUB, SQS, new_relay, outbox, recorder


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def settle(tables, batch_id, done):
    rows = tables.spark.createDataFrame([(i, "confirmed", None) for i in done], "id bigint, outcome string, reason string")
    tables.write(rows, "settled", batch_id)
    tables.write(tables.spark.range(1).selectExpr(f"{batch_id}L AS batch_no"), "batch_log", batch_id)


@pytest.fixture
def log(spark):
    tables = RelayTables(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return PendingLog(tables, outbox(spark, [(0, "p", "t", "d", None)]).schema, CFG)


def box(spark, numbers):
    return outbox(spark, [(i, "p", "t", "d", None) for i in numbers])


def test_batch_ten_reads_no_settled_row(spark, log):
    """Ten batches of ten rows: what the last one opens holds only what is pending, and a late low id is in it."""
    log.append(box(spark, range(10, 100)), 0)
    for batch_id in range(8):
        settle(log.tables, batch_id, range(10 + 10 * batch_id, 20 + 10 * batch_id))
        log.compact()
    log.append(box(spark, [3]), 1)
    assert ids(log.rows()) == [3, *range(90, 100)]
    opened = spark.read.schema(log.schema).parquet(*[f for f in log.rows().inputFiles() if "/settled/" not in f])
    assert ids(opened) == [3, *range(90, 100)]
    settle(log.tables, 8, [3])
    assert ids(log.rows()) == list(range(90, 100))


def test_epochs_that_come_again(spark, log):
    for _ in range(2):
        log.append(box(spark, range(5)), 0)
    settle(log.tables, 0, [0, 1])
    log.compact()
    log.append(box(spark, range(5)), 0)  # replayed after its snapshot: settled rows stay settled
    assert ids(log.rows()) == [2, 3, 4]
    log.append(box(spark, [7]), 1)
    log.tables.write(box(spark, [99]), "settled", 1)  # a batch that was never logged
    assert ids(log.rows()) == [2, 3, 4, 7]


def test_an_unfinished_compaction_changes_nothing(spark, log):
    log.append(box(spark, range(5)), 0)
    box(spark, [42]).write.parquet(f"{log.tables.path('snapshots')}/snapshot=0")
    assert ids(log.rows()) == list(range(5))
    log.compact()
    assert ids(log.rows()) == list(range(5)) and log.newest().version == 0


def test_attempts_are_logged(spark, tmp_path):
    rows = outbox(spark, [(1, "p", PUBSUB, "topic-a", None), (2, "p", SQS, "q", None)])
    relay = new_relay(spark, tmp_path)
    with pytest.raises(ValueError):
        replace(relay, publishers={SQS: relay.publishers[SQS]}).run_batch(rows, 0)
    with pytest.raises(streams.Crash):
        replace(relay, tables=streams.CrashingTables(spark, relay.tables.root)).run_batch(rows, 0)
    assert relay.tables.next_batch_id() == 0 and relay.tables.settled().isEmpty()
    relay.run_batch(rows, 0)
    states = relay.tables.states().orderBy("attempt").collect()
    assert [(r["batch_id"], r["state"]) for r in states] == [(0, "failed"), (0, "crashed"), (0, "committed")]
    assert "no publisher" in states[0]["error"]
    total = stats.counters_running(relay.tables.batch_log()).agg({"batch_errors": "max", "batches_processed": "max", "events_sent": "max"}).first()
    assert total.asDict() == {"max(batch_errors)": 1, "max(batches_processed)": 1, "max(events_sent)": 2}


def test_a_kept_row_goes_out_without_arrivals(spark, tmp_path):
    """A row that is kept once is sent by a later tick of the clock, with no new row in the stream."""
    relay = new_relay(spark, tmp_path / "none")
    marks = tmp_path / "marks"
    marks.mkdir()

    def once(row):
        if not list(marks.iterdir()):
            (marks / "tried").write_text("x")
            return "error", "503", "unavailable", False
        return "ok", None, None, False

    sent = tmp_path / "sent"
    sent.mkdir()
    relay = replace(relay, publishers={PUBSUB: in_order(once, ["topic", "ordering_key"], PERMANENT_CODES)} | {SQS: recorder(sent)[SQS]})
    source = relay.tables.path("source")
    one = outbox(spark, [(7, "p", PUBSUB, "topic-a", None)])
    one.write.parquet(source)
    stream = relay.start(spark.readStream.schema(one.schema).parquet(source), relay.tables.path("checkpoint"), {"processingTime": "1 second"}, ticks=True)
    try:
        deadline = time.time() + 240
        while not ids(relay.tables.settled()) and time.time() < deadline and stream.exception() is None:
            time.sleep(1)
    finally:
        stream.stop()
    assert ids(relay.tables.settled()) == [7] and (marks / "tried").exists()
    assert relay.tables.batch_log().filter("kept = 1").count() >= 1


def test_the_relay_runs_many_small_batches(spark):
    tables = streams.relayed(spark, "/root/testdata/sf0.001", target=400)
    log = tables.batch_commits().filter("selected > 0").collect()
    assert len(log) >= 4 and max(r["selected"] for r in log) <= 400 + 20
    settled = tables.settled()
    assert settled.count() == settled.select("id").distinct().count()


def test_retry_queues_keep_time_by_themselves(spark, tmp_path):
    """Waiting messages go out by their timer; each key stays in order."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(30).selectExpr("'pubsub' AS target", "'t' AS destination", "concat('k', id % 3) AS order_key", "id", "'b' AS body")
    rows.write.parquet(source)
    stream = deliver_in_order(spark.readStream.schema(rows.schema).parquet(source), streams.send_second_time, timedelta(milliseconds=5))
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    try:
        deadline, found = time.time() + 240, []
        while len(found) < 30 and time.time() < deadline and running.exception() is None:
            time.sleep(1)
            found = spark.read.schema(SENT).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        running.stop()
    assert len(found) == 30
    for key in ("k0", "k1", "k2"):
        own = sorted((r["place"], r["id"], r["tries"]) for r in found if r["order_key"] == key)
        assert [i for _, i, _ in own] == sorted(i for _, i, _ in own) and [p for p, _, _ in own] == list(range(1, 11))
        assert all(t == (2 if i % 13 == 0 else 1) for _, i, t in own)


def test_retry_queues_run_under_the_default_state_store(spark, tmp_path):
    """Sessions that name no state store have one without lists and timers; the query brings its own and leaves the session as it was."""
    spark.range(160).selectExpr(
        "id AS event_id", "timestamp'2024-01-30 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 3 AS user_id",
        "IF(id % 2 = 0, 'click', 'view') AS event_type", "1.0D AS value", "'{}' AS props").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("part-*")).rename(tmp_path / "events.parquet")
    found, (store,) = load()["stream_retry_order"], KEYED_STATE
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    with settings(spark, {store: default}):
        assert compare(spark, connect(str(tmp_path)), str(tmp_path), found.build, found.sql) is None
        assert spark.conf.get(store) == default and spark.conf.get(streams.NO_DATA_BATCHES) == "true"


def test_settings_come_back_after_an_error(spark):
    with pytest.raises(ValueError), settings(spark, {streams.NO_DATA_BATCHES: "false", "sluice.test": "1"}):
        assert spark.conf.get("sluice.test") == "1"
        raise ValueError
    assert spark.conf.get(streams.NO_DATA_BATCHES) == "true" and spark.conf.get("sluice.test", None) is None
