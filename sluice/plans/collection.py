"""Queries on scanning, routing, collection, triage and time."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.config import PUBSUB, SQS, Backend
from sluice.functions.values import as_bytes, as_text, as_timestamp
from sluice.operators import backlog, collect, routing, triage as T
from sluice.plans.catalog import query
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, NOW, events, every, outbox
from sluice.session import spread
from sluice.sources.outbox import scan_outbox
from sluice.sources.producer import ordered_workload, power_law_count, produce_events

OWNING = replace(CONFIG, backends=(Backend(PUBSUB, "topic-click", ("topic-click",)),
                                   Backend(SQS, "https://sqs.example/1/q0", ("https://sqs.example/1/q0", "https://sqs.example/1/q2.fifo"))))


def batch(spark: SparkSession, d: str) -> DataFrame:
    return collect.fair_share_rows(outbox(spark, d), CONFIG)


@query("scan_outbox", over("resolved", """
SELECT resolved_target, resolved_destination, id, epoch_us(event_ts) AS event_us, payload, target, destination, options FROM resolved"""))
def _(spark, d):
    rows = scan_outbox(outbox(spark, d), CONFIG)
    return rows.withColumn("event_us", F.unix_micros("event_ts")).drop("event_ts")


@query("scan_invariant", over("fair", """
SELECT count(*) AS selected,
       count(*) FILTER (WHERE resolved_target NOT IN ('pubsub', 'sqs') OR resolved_destination = '') AS broken FROM fair"""))
def _(spark, d):
    return T.scan_invariant(batch(spark, d), CONFIG)


@query("resolve_routes", over("resolved", """
SELECT id, resolved_target, resolved_destination,
       coalesce(resolved_target IN ('pubsub', 'sqs') AND resolved_destination <> '', false) AS routable FROM resolved"""))
def _(spark, d):
    return routing.resolve_routes(outbox(spark, d), CONFIG).select("id", *routing.ROUTE, "routable")


@query("routable_events", over("routable", "SELECT id, resolved_target, resolved_destination, payload FROM routable"))
def _(spark, d):
    return routing.routable_events(outbox(spark, d), CONFIG).select("id", *routing.ROUTE, "payload")


@query("owned_events", over("routable", """
SELECT id, resolved_target, resolved_destination FROM routable
WHERE (resolved_target <> 'pubsub' OR resolved_destination IN ('topic-click'))
  AND (resolved_target <> 'sqs' OR resolved_destination IN ('https://sqs.example/1/q0', 'https://sqs.example/1/q2.fifo'))"""))
def _(spark, d):
    return routing.owned_events(outbox(spark, d), OWNING).select("id", *routing.ROUTE)


@query("route_groups_default_together", over("routable", """
SELECT resolved_target, resolved_destination, count(*) FILTER (WHERE coalesce(destination, '') <> '') AS explicit_events,
       count(*) FILTER (WHERE coalesce(destination, '') = '') AS defaulted_events
FROM routable GROUP BY resolved_target, resolved_destination"""))
def _(spark, d):
    blank = F.coalesce("destination", F.lit("")) == ""
    return routing.routable_events(outbox(spark, d), CONFIG).groupBy(*routing.ROUTE).agg(
        F.count_if(~blank).alias("explicit_events"), F.count_if(blank).alias("defaulted_events"))


@query("unroutable_audit", over("resolved", """
SELECT CASE WHEN resolved_target IS NULL THEN 'R11 ambiguous target'
            WHEN resolved_target NOT IN ('pubsub', 'sqs') THEN 'R10 unknown target'
            ELSE 'R12 no destination' END AS reason, count(*) AS events
FROM resolved WHERE NOT coalesce(resolved_target IN ('pubsub', 'sqs') AND resolved_destination <> '', false) GROUP BY 1"""))
def _(spark, d):
    return routing.unroutable_audit(outbox(spark, d), CONFIG)


@query("normalize_values", over("outbox", """
SELECT id, CAST(id AS VARCHAR) AS id_text, coalesce(destination, '') AS destination_text,
       strftime(event_ts, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN rtrim(strftime(event_ts, '%f'), '0') = '' THEN '' ELSE '.' || rtrim(strftime(event_ts, '%f'), '0') END
         || 'Z' AS event_text,
       hex(encode(coalesce(options, ''))) AS options_hex FROM outbox"""))
def _(spark, d):
    df = outbox(spark, d)
    kind = {f.name: f.dataType for f in df.schema}
    texts = [f"{as_text(c, kind[c])} AS {n}_text" for c, n in (("id", "id"), ("destination", "destination"), ("event_ts", "event"))]
    return df.selectExpr("id", *texts, f"hex({as_bytes('options', kind['options'])}) AS options_hex")


@query("eligible_routes", over("routable", """
SELECT resolved_target, resolved_destination, count(*) OVER () AS route_count
FROM (SELECT DISTINCT resolved_target, resolved_destination FROM routable) r"""))
def _(spark, d):
    return collect.eligible_routes(outbox(spark, d), CONFIG)


@query("fair_share_select", over("fair", "SELECT id, resolved_target, resolved_destination FROM fair"))
def _(spark, d):
    return collect.fair_share_ids(outbox(spark, d), CONFIG)


@query("fair_share_select_full", over("fair", """
SELECT id, resolved_target, resolved_destination, epoch_us(event_ts) AS event_us, payload, target, destination, options FROM fair"""))
def _(spark, d):
    return batch(spark, d).withColumn("event_us", F.unix_micros("event_ts")).drop("event_ts")


@query("per_route_sequence", over("routable", """
SELECT id, resolved_target, resolved_destination,
       row_number() OVER (PARTITION BY resolved_target, resolved_destination ORDER BY id) AS seq FROM routable"""))
def _(spark, d):
    return collect.per_route_sequence(outbox(spark, d), CONFIG)


@query("backlog_probe", over("resolved", """
SELECT count(*) FILTER (WHERE resolved_target IN ('pubsub', 'sqs') AND resolved_destination <> '') AS routable,
       count(*) AS scanned, count(*) >= 1000 AS capped
FROM (SELECT * FROM resolved ORDER BY id LIMIT 1000) head"""))
def _(spark, d):
    return backlog.backlog_probe(outbox(spark, d), CONFIG, limit=1000)


@query("batch_drained", over("fair", """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS selected, count(*) AS routes,
       NOT coalesce(max(n) >= greatest(1, (100 + count(*) - 1) // nullif(count(*), 0)), false) AS drained
FROM (SELECT count(*) AS n FROM fair GROUP BY resolved_target, resolved_destination) r"""))
def _(spark, d):
    return collect.batch_drained(collect.fair_share_ids(outbox(spark, d), CONFIG), CONFIG)


@query("backlog_gauge", over("fair", """
SELECT CASE WHEN drained THEN 0 ELSE routable END AS backlog, CASE WHEN drained THEN false ELSE capped END AS floor
FROM (SELECT NOT coalesce(max(n) >= greatest(1, (100 + count(*) - 1) // nullif(count(*), 0)), false) AS drained
      FROM (SELECT count(*) AS n FROM fair GROUP BY resolved_target, resolved_destination) r) b
CROSS JOIN (SELECT count(*) FILTER (WHERE resolved_target IN ('pubsub', 'sqs') AND resolved_destination <> '') AS routable,
                   count(*) >= 5000 AS capped FROM (SELECT * FROM resolved ORDER BY id LIMIT 5000) h) p"""))
def _(spark, d):
    box = outbox(spark, d)
    drained = collect.batch_drained(collect.fair_share_ids(box, CONFIG), CONFIG)
    start = drained.select(F.lit(0).cast("bigint").alias("backlog"), F.lit(True).alias("floor"))
    kept = drained.select(F.lit(0).cast("bigint").alias("kept"))
    return backlog.backlog_gauge(drained, kept, start, backlog.backlog_probe(box, CONFIG, limit=5000), timedelta(seconds=30))


@query("drain_batches", over("routable", """
SELECT batch_no, CAST(sum(least(share, size - depth)) AS BIGINT) AS selected
FROM walk JOIN sizes ON size > depth GROUP BY batch_no""", """
sizes AS (SELECT count(*) AS size FROM routable GROUP BY resolved_target, resolved_destination),
walk(batch_no, depth, share) AS (
  SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), greatest(1, (100 + count(*) - 1) // count(*)) FROM sizes HAVING count(*) > 0
  UNION ALL
  SELECT batch_no + 1, depth + share, greatest(1, (100 + count(*) - 1) // count(*))
  FROM walk JOIN sizes ON size > depth + share GROUP BY batch_no, depth, share)"""))
def _(spark, d):
    return collect.drain_schedule(outbox(spark, d), CONFIG)


@query("normalize_timestamps", """
WITH texts AS (
  SELECT event_id AS id, CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
    WHEN 4 THEN strftime(ts, '%Y-%m-%d')
    WHEN 5 THEN strftime(ts, '%Y') WHEN 6 THEN '' ELSE 'not-a-time' END AS text FROM events)
SELECT id, CASE WHEN regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$')
                THEN epoch_us(CAST(text AS TIMESTAMPTZ))
                WHEN regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d+)?$')
                THEN epoch_us(CAST(text AS TIMESTAMP)) END AS event_us FROM texts""")
def _(spark, d):
    e = events(spark, d).withColumn("id", F.col("event_id"))
    shapes = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm:ss",
              "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd", "yyyy"]
    text = F.when(every(8, 6), "").otherwise("not-a-time")
    for n, shape in enumerate(shapes):
        text = F.when(every(8, n), F.date_format("ts", shape)).otherwise(text)
    texts = e.select("id", text.alias("text"))
    return texts.selectExpr("id", f"unix_micros({as_timestamp('text', texts.schema['text'].dataType)}) AS event_us")


@query("expired_events", over("outbox", """
SELECT id, epoch_us(event_ts) AS event_us FROM outbox WHERE event_ts < TIMESTAMP '2024-01-24 00:00:00'"""))
def _(spark, d):
    df = outbox(spark, d)
    return df.filter(T.expired(df, CONFIG, NOW)).select("id", F.unix_micros("event_ts").alias("event_us"))


@query("triage", over("triaged", "SELECT id, resolved_target, resolved_destination, triage, reason FROM triaged"))
def _(spark, d):
    return T.triage(spread(routing.routable_events(outbox(spark, d), CONFIG)), CONFIG, NOW).select("id", *routing.ROUTE, "triage", "reason")


@query("outbox_lag", over("fair", """
SELECT greatest(0.0, CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(event_ts) AS DOUBLE) / 1000000) AS lag_s
FROM fair ORDER BY id LIMIT 1"""))
def _(spark, d):
    return T.outbox_lag(batch(spark, d), CONFIG, NOW)


@query("produce_events", """
SELECT props AS payload, nullif(CASE event_type WHEN 'purchase' THEN 'sqs' WHEN 'signup' THEN '' ELSE 'pubsub' END, '') AS target,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'dest-' || event_type END AS destination,
       CASE WHEN event_id % 2 = 0 THEN NULL
            WHEN event_type = 'purchase' THEN '{"sqs":{"messageGroupId":"user-' || CAST(user_id AS VARCHAR) || '"}}'
            ELSE '{"pubsub":{"orderingKey":"user-' || CAST(user_id AS VARCHAR) || '"}}' END AS options
FROM events""")
def _(spark, d):
    e = events(spark, d).withColumn("id", F.col("event_id"))
    kind = F.col("event_type")
    rows = e.select(
        F.col("props").alias("payload"), F.when(kind == "purchase", SQS).when(kind == "signup", "").otherwise(PUBSUB).alias("target"),
        F.when(every(5), "").otherwise(F.concat(F.lit("dest-"), kind)).alias("destination"),
        F.when(every(2), "").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("ordering_key"))
    return produce_events(rows, NOW).drop("timestamp")


@query("gen_power_law", """
WITH RECURSIVE halves(route, remaining) AS (
  SELECT 0, (SELECT count(*) FROM events)
  UNION ALL SELECT route + 1, remaining - (remaining + 1) // 2 FROM halves WHERE route < 19),
routes AS (SELECT route, CASE WHEN route = 19 THEN remaining ELSE (remaining + 1) // 2 END AS events FROM halves),
keys(route, key, remaining) AS (
  SELECT route, 0, events // 2 FROM routes
  UNION ALL SELECT route, key + 1, remaining - (remaining + 1) // 2 FROM keys WHERE key < 9),
sized AS (SELECT route, key, CASE WHEN key = 9 THEN remaining ELSE (remaining + 1) // 2 END AS n FROM keys),
loose AS (SELECT route, unnest(generate_series(1, events - events // 2)) AS n FROM routes WHERE events - events // 2 > 0),
keyed AS (SELECT route, key, unnest(generate_series(1, n)) AS n FROM sized WHERE n > 0)
SELECT concat_ws('/', 'load', route, 'free', n) AS id, 'load of topic-' || CAST(route AS VARCHAR) AS payload,
       'topic-' || CAST(route AS VARCHAR) AS destination, NULL AS options FROM loose
UNION ALL
SELECT concat_ws('/', 'load', route, key, n), 'load of topic-' || CAST(route AS VARCHAR), 'topic-' || CAST(route AS VARCHAR),
       '{"pubsub":{"orderingKey":"lane ' || CAST(key AS VARCHAR) || '"},"sqs":{"messageGroupId":"lane ' || CAST(key AS VARCHAR) || '"}}'
FROM keyed""")
def _(spark, d):
    total = events(spark, d).agg(F.count(F.lit(1)).alias("total"))
    routes = total.select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("route"), "total").select(
        "route", F.concat(F.lit("topic-"), F.col("route").cast("string")).alias("destination"),
        power_law_count(F.col("total"), F.col("route"), F.lit(20)).alias("events"))
    return ordered_workload(routes, keys=10)
