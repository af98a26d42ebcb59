"""Headline queries at one scale; prints a single JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from sluice.plans.catalog import load

# The stages of a relay batch and the reports over whole tables.
HEADLINE = [
    "fair_share_select", "fair_share_select_full", "drain_batches", "backlog_probe", "unroutable_audit", "triage",
    "pubsub_messages", "sqs_entries", "prepared_messages", "pubsub_order_groups", "sqs_chunks", "classify_pubsub_ordered",
    "head_of_line", "settle_outcomes", "batch_stats", "dead_letters", "pending_after_settle", "counters_running",
    "suppress_failures", "audit_missing", "audit_order", "audit_latency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sluice-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.log.level", "ERROR").getOrCreate())
    names = sys.argv[1:] or HEADLINE
    registry = load()
    registry["resolve_routes"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "events": events, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
