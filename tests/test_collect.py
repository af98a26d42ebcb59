"""Collection, backlog and generated-load cases with known answers."""

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.config import Backend, RelayConfig
from sluice.operators import backlog, collect, routing, triage
from sluice.operators.audit import audit_latency
from sluice.session import stored
from sluice.sources.producer import plain_workload, power_law_count, uniform_count

BOTH = RelayConfig(backends=(Backend("pubsub", "topic-default"), Backend("sqs")), options_col="", timestamp_col="", batch_target=40)
ONE = replace(BOTH, backends=(Backend("pubsub", "topic-default"),))
LAYOUT = "id string, payload string, target string, destination string"
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(i, "p", t, d) for i, t, d in rows], LAYOUT)


def rows(prefix, n, target, destination):
    return [(f"{prefix}-{i:03d}", target, destination) for i in range(n)]


def test_fair_share_between_two_routes(spark):
    df = frame(spark, rows("000-route-a", 100, "sqs", "queue-a") + rows("900-route-b", 10, "pubsub", "topic-b") + rows("500", 5, "kafka", "x"))
    got = collect.fair_share_rows(df, BOTH).groupBy("resolved_destination").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).collect()
    assert {r["resolved_destination"]: (r["n"], r["last"]) for r in got} == {
        "queue-a": (20, "000-route-a-019"), "topic-b": (10, "900-route-b-009")}


def test_explicit_and_defaulted_destination_are_one_route(spark):
    df = frame(spark, rows("000-explicit", 50, "pubsub", "topic-default") + rows("100-default", 50, "pubsub", ""))
    got = [r["id"] for r in collect.fair_share_ids(df, ONE).collect()]
    assert sorted(got) == [f"000-explicit-{i:03d}" for i in range(40)]


def test_bounded_probe_counts_only_what_the_relay_owns(spark):
    cfg = replace(BOTH, backends=(Backend("sqs", "", ("queue-a",)),))
    df = frame(spark, [("1", "sqs", "queue-a"), ("2", "sqs", "other"), ("3", "sqs", "queue-a"), ("4", "pubsub", "queue-a"), ("5", "sqs", "queue-a")])
    assert tuple(backlog.backlog_probe(df, cfg, 100).first()) == (3, 5, False)
    assert tuple(backlog.backlog_probe(df, cfg, 2).first()) == (1, 2, True)


@pytest.mark.parametrize("counts, target, drained", [
    ({}, 10, True), ({"A": 9}, 10, True), ({"A": 10}, 10, False), ({"A": 4, "B": 4}, 10, True), ({"A": 5, "B": 1}, 10, False), ({"A": 1}, 1, False)])
def test_drained(spark, counts, target, drained):
    batch = spark.createDataFrame([(d, d) for d, n in counts.items() for _ in range(n)], "resolved_target string, resolved_destination string")
    assert collect.batch_drained(batch, replace(BOTH, batch_target=target)).first()["drained"] is drained


@pytest.mark.parametrize("drained, probe, since, expected", [
    (True, True, 60, (2, False)), (False, False, 60, (2, True)), (False, True, 60, (7, True)), (False, True, 1, (5, False))])
def test_backlog_gauge(spark, drained, probe, since, expected):
    one = spark.range(1)
    gauge = backlog.backlog_gauge(
        one.select(F.lit(drained).alias("drained")), one.select(F.lit(2).alias("kept")),
        one.select(F.lit(5).alias("backlog"), F.lit(False).alias("floor")),
        one.select(F.lit(7).alias("routable"), F.lit(True).alias("capped")) if probe else None, timedelta(seconds=since))
    assert tuple(gauge.first()) == expected


def test_drain_schedule_of_one_queue(spark):
    df = frame(spark, rows("e", 250, "sqs", "q"))
    got = collect.drain_schedule(df, replace(BOTH, batch_target=100)).orderBy("batch_no").collect()
    assert [r["selected"] for r in got] == [100, 100, 50]


@few
@given(st.lists(st.integers(1, 60), min_size=1, max_size=6), st.integers(1, 50))
def test_drain_schedule_and_share_bound(spark, sizes, target):
    cfg = replace(BOTH, batch_target=target)
    df = frame(spark, [r for n, size in enumerate(sizes) for r in rows(f"r{n}", size, "sqs", f"q{n}")])
    want, left = [], list(sizes)
    while any(left):
        share = max(1, -(-target // sum(1 for n in left if n)))
        want.append(sum(min(share, n) for n in left))
        left = [max(0, n - share) for n in left]
    got = collect.drain_schedule(df, cfg).orderBy("batch_no").collect()
    assert [r["selected"] for r in got] == want
    assert want[0] <= target + len(sizes) - 1 and collect.fair_share_ids(df, cfg).count() == want[0]


@pytest.mark.parametrize("backends, target, destination, label", [
    (("pubsub", "sqs"), "", "d", "R11 ambiguous target"), (("pubsub", "sqs"), "kafka", "d", "R10 unknown target"),
    (("pubsub",), "sqs", None, "R7 disabled backend"), (("pubsub",), "", None, "R12 no destination"), (("pubsub",), "", "d", None),
    (("pubsub", "sqs"), "sqs", None, "R12 no destination")])
def test_unroutable_labels(spark, backends, target, destination, label):
    cfg = replace(BOTH, backends=tuple(Backend(b) for b in backends))
    routed = routing.resolve_routes(frame(spark, [("1", target, destination)]), cfg)
    assert routed.selectExpr(f"{routing.unroutable_label(cfg)} AS l").first()["l"] == label


def test_long_allowlists_join(spark):
    df = frame(spark, [("1", "sqs", "a"), ("2", "sqs", "b"), ("3", "pubsub", "c"), ("4", "pubsub", "")])
    owned = spark.createDataFrame([("sqs", "a"), ("sqs", "a")], "resolved_target string, resolved_destination string")
    assert sorted(r["id"] for r in routing.owned_events(df, BOTH, owned).collect()) == ["1", "3", "4"]


def test_expiry_is_strict_and_lag_is_of_the_first_row(spark):
    now = datetime(2026, 6, 23, 12, tzinfo=timezone.utc)
    cfg = replace(BOTH, timestamp_col="timestamp", max_age=timedelta(seconds=60))
    stamps = ["2026-06-23T11:58:59.999999Z", "2026-06-23T11:59:00Z", "2026-06-23T11:59:30Z", "2026-06-23T12:01:00Z", None, "not-a-time"]
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate(stamps)], "id string, timestamp string")
    got = df.selectExpr("id", f"{triage.expired(df, cfg, now)} AS x").orderBy("id").collect()
    assert [r["x"] for r in got] == [True, False, False, False, False, False]
    assert triage.outbox_lag(df.filter("id > '1'"), cfg, now).first()["lag_s"] == 30.0
    assert triage.outbox_lag(df.filter("id > '2'"), cfg, now).first()["lag_s"] == 0.0
    assert triage.outbox_lag(df.filter("id > '3'"), cfg, now).first()["lag_s"] == 0.0


def test_generated_counts(spark):
    df = spark.range(7).selectExpr("CAST(id AS INT) AS i")
    uniform = [r[0] for r in df.select(uniform_count(F.lit(100), F.col("i"), F.lit(7))).collect()]
    power = [r[0] for r in df.select(power_law_count(F.lit(100), F.col("i"), F.lit(7))).collect()]
    assert uniform == [15, 15, 14, 14, 14, 14, 14] and power == [50, 25, 13, 6, 3, 2, 1]


def test_a_large_route_is_generated_by_many_tasks(spark):
    routes = spark.createDataFrame([(0, "d", 95_000), (1, "e", 3)], "route int, destination string, events bigint")
    made = plain_workload(routes)
    assert made.count() == 95_003 and made.select("id").distinct().count() == 95_003
    assert made.filter("destination = 'd'").select(F.spark_partition_id()).distinct().count() > 1


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_collection_plan(spark, tmp_path):
    """Group limits run before the shuffle; ids are picked without payloads; bounds reach the scan."""
    path = str(tmp_path / "outbox")
    spark.range(1000).selectExpr("id", "'p' AS payload", "'sqs' AS target", "concat('q', id % 3) AS destination").write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(collect.fair_share_ids(df, BOTH))
    assert plan.count("WindowGroupLimit") >= 4 and "payload" not in plan
    assert "PushedFilters: [In(target" in plan
    ids = collect.fair_share_ids(df, BOTH)
    ids.write.parquet(str(tmp_path / "ids"))
    assert "LessThanOrEqual(id,ScalarSubquery" in plan_of(collect.fair_share_rows(df, BOTH, spark.read.parquet(str(tmp_path / "ids"))))


def test_payload_ranges_leave_out_the_gap_before_a_young_row(spark, tmp_path):
    """A young row on a quiet route does not make the payload scan read the rows between."""
    rows = spark.range(0, 20_000, 1, 1).selectExpr("id", "repeat('p', 50) AS payload", "'sqs' AS target", "IF(id = 19999, 'quiet', 'busy') AS destination")
    path = str(tmp_path / "box")
    rows.write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(path)
    box, cfg = spark.read.parquet(path), RelayConfig(backends=(Backend("sqs"),), batch_target=100)
    ids = stored(collect.fair_share_ids(box, cfg))
    assert collect.id_ranges(ids, "id", most=2) == [(0, 49), (19999, 19999)]
    batch = collect.fair_share_rows(box, cfg, ids)
    assert sorted(r["id"] for r in batch.select("id").collect()) == [*range(50), 19999]
    plan = plan_of(batch)
    assert "LessThanOrEqual(id,49)" in plan and "EqualTo(id,19999)" in plan


def test_ids_without_gaps_and_empty_batches(spark):
    texts = spark.createDataFrame([("a",), ("m",), ("z",)], "id string")
    assert collect.id_ranges(texts, "id") == [("a", "z")] and collect.id_ranges(texts.limit(0), "id") == []
    assert collect.id_ranges(spark.range(5), "id") == [(0, 4)]
    assert collect.id_ranges(spark.createDataFrame([(1,), (5,), (6,), (9,)], "id long"), "id") == [(1, 1), (5, 6), (9, 9)]


def test_percentiles_from_counts(spark):
    rng = random.Random(1)
    for n in (1, 2, 9, 100, 333):
        values = [rng.choice([5, 5, 7, 9, rng.randrange(1000)]) for _ in range(n)]
        got = audit_latency(spark.createDataFrame(list(enumerate(values)), "id long, latency_us long")).first()
        ordered = sorted(values)
        wanted = [ordered[min(max(int(p * n) - 1, 0), n - 1)] for p in (0.5, 0.9, 0.99)]
        assert [got["events"], got["p50_us"], got["p90_us"], got["p99_us"], got["max_us"]] == [n, *wanted, ordered[-1]]
