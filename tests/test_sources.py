"""Tables, message sink, snapshots and stream deduplication."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from sluice.config import Backend, RelayConfig
from sluice.session import shared_dir
from sluice.sources.outbox import OUTBOX_SCHEMA, pending, read_outbox
from sluice.sources.publish import write_messages
from sluice.sources.tables import SETTLED, RelayTables, compact_settled
from sluice.streaming.dedup import dedup_stream

CFG = RelayConfig(backends=(Backend("sqs"),))


def tables(spark):
    return RelayTables(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")


def test_only_logged_batches_count(spark):
    t = tables(spark)
    assert t.settled().isEmpty() and t.next_batch_id() == 0
    done = spark.createDataFrame([(1, "confirmed", None)], "id bigint, outcome string, reason string")
    t.write(done, "settled", 0)
    t.write(done.withColumn("id", F.lit(2).cast("bigint")), "settled", 1)
    t.write(spark.range(1).selectExpr("CAST(0 AS BIGINT) AS batch_no"), "batch_log", 0)
    assert [r["id"] for r in t.settled().collect()] == [1]
    assert t.next_batch_id() == 1
    t.write(done.limit(0), "settled", 0)
    assert t.read("settled", SETTLED).filter("batch_id = 0").isEmpty()


def test_pending_and_compaction(spark, tmp_path):
    t = tables(spark)
    box = spark.range(10).selectExpr("id", "'p' AS payload", "'sqs' AS target", "'q' AS destination")
    t.write(spark.range(4).selectExpr("id", "'confirmed' AS outcome", "CAST(NULL AS STRING) AS reason"), "settled", 0)
    t.write(spark.range(1).selectExpr("CAST(0 AS BIGINT) AS batch_no"), "batch_log", 0)
    compact_settled(t, box, CFG, str(tmp_path / "next"))
    kept = read_outbox(spark, str(tmp_path / "next"))
    assert sorted(r["id"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    assert sorted(r["id"] for r in pending(kept, t.settled(), CFG).collect()) == [4, 5, 6, 7, 8, 9]


def test_outbox_formats(spark, tmp_path):
    box = spark.range(3).selectExpr("id", "current_timestamp() AS timestamp", "'p' AS payload", "'sqs' AS target", "'q' AS destination", "'{}' AS options")
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        box.write.format(fmt).save(path)
        assert read_outbox(spark, path, fmt, OUTBOX_SCHEMA).select("id").count() == 3


def test_message_table_is_split_by_target(spark, tmp_path):
    path = str(tmp_path / "messages")
    write_messages(spark.range(4).selectExpr("id", "CASE WHEN id < 3 THEN 'sqs' ELSE 'pubsub' END AS target"), path)
    assert spark.read.parquet(path).filter("target = 'sqs'").count() == 3


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(20).selectExpr("'q' AS destination", "concat('d', id % 5) AS deduplication_id", "id", "timestamp_seconds(id) AS at")
    rows.write.parquet(source)
    arrivals = spark.readStream.schema(rows.schema).parquet(source)
    (dedup_stream(arrivals, "at", "1 hour").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out)
    assert got.count() == 5 and got.select("deduplication_id").distinct().count() == 5


def test_a_role_switched_off_leaves_the_default_route(spark):
    from sluice.operators.routing import routable_events

    cfg = replace(CFG, backends=(Backend("sqs", "q"),), target_col="", destination_col="")
    df = spark.createDataFrame([(1, "p")], "id bigint, payload string")
    assert tuple(routable_events(df, cfg).first()) == (1, "p", "sqs", "q")
