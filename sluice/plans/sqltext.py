"""ANSI SQL building blocks for the DuckDB side of every query."""

from __future__ import annotations

OUTBOX = """
  SELECT event_id AS id, ts AS event_ts,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE props END AS payload,
         CASE event_type WHEN 'click' THEN 'pubsub' WHEN 'view' THEN 'pubsub'
              WHEN 'purchase' THEN 'sqs' WHEN 'signup' THEN '' ELSE
              CASE WHEN event_id % 2 = 0 THEN 'sqs' ELSE 'kafka' END END AS target,
         CASE WHEN event_id % 5 = 0 THEN NULL
              WHEN event_type IN ('click','view') THEN
                   CASE WHEN event_id % 53 = 0 THEN 'bad/topic' ELSE concat('topic-', event_type) END
              WHEN user_id % 2 = 0 THEN concat('https://sqs.example/1/q', CAST(user_id % 3 AS VARCHAR(10)), '.fifo')
              ELSE concat('https://sqs.example/1/q', CAST(user_id % 3 AS VARCHAR(10))) END AS destination,
         CASE WHEN event_id % 11 = 0 THEN NULL
              WHEN event_id % 101 = 0 THEN '{bad'
              WHEN event_id % 103 = 0 THEN '[]'
              WHEN event_id % 107 = 0 THEN '{"pubsub":[],"sqs":[]}'
              WHEN event_id % 109 = 0 THEN '{"pubsub":{"orderingKey":42},"sqs":{"messageGroupId":42}}'
              ELSE concat('{"pubsub":{"orderingKey":"user-', CAST(user_id AS VARCHAR(20)),
                   '","attributes":{"type":"', event_type, '","n":', CAST(event_id % 7 AS VARCHAR(10)),
                   '}},"sqs":{"messageGroupId":"user-', CAST(user_id AS VARCHAR(20)),
                   '","delaySeconds":', CAST(event_id % 950 AS VARCHAR(10)), '}}') END AS options
  FROM events"""

RESOLVED = """
  SELECT outbox.*, nullif(target, '') AS resolved_target,
         coalesce(nullif(destination, ''),
                  CASE nullif(target, '') WHEN 'pubsub' THEN 'topic-click'
                       WHEN 'sqs' THEN 'https://sqs.example/1/q0' ELSE '' END) AS resolved_destination
  FROM outbox"""

ROUTABLE = """
  SELECT * FROM resolved WHERE resolved_target IN ('pubsub', 'sqs') AND resolved_destination <> ''"""

FAIR_SHARE = """
  SELECT p.* EXCLUDE (rn) FROM
    (SELECT routable.*, row_number() OVER (PARTITION BY resolved_target, resolved_destination ORDER BY id) AS rn
     FROM routable) p
  CROSS JOIN (SELECT count(*) AS route_count
              FROM (SELECT DISTINCT resolved_target, resolved_destination FROM routable) d) n
  WHERE rn <= greatest(1, CAST(floor((100 + route_count - 1) / route_count) AS BIGINT))"""


def _triaged(source: str) -> str:
    return f"""
  SELECT x.*, CASE WHEN event_ts < TIMESTAMP '2024-01-24 00:00:00' THEN 'expired'
                   WHEN options_error IS NOT NULL THEN 'malformed' ELSE 'dispatch' END AS triage,
         CASE WHEN event_ts < TIMESTAMP '2024-01-24 00:00:00' THEN 'Event expired by MAX_EVENT_AGE_MS'
              ELSE options_error END AS reason
  FROM (SELECT y.*, CASE
          WHEN options IS NULL OR options = '' THEN NULL
          WHEN j IS NULL THEN 'malformed event options: options column must be valid JSON'
          WHEN json_type(j) NOT IN ('OBJECT', 'NULL') THEN 'malformed event options: options column must be an object'
          WHEN coalesce(json_type(j, '$.' || resolved_target), 'NULL') NOT IN ('OBJECT', 'NULL')
          THEN 'malformed event options: ' || resolved_target || ' section must be an object' END AS options_error
        FROM (SELECT {source}.*, CASE WHEN json_valid(options) THEN options END AS j FROM {source}) y) x"""


PUBSUB_MESSAGES = """
  SELECT id, topic, data, ordering_key, attribute_type, coalesce(
           malformed,
           CASE WHEN data = '' AND attribute_type IS NULL AND ordering_key = ''
                THEN 'Pub/Sub message has no data, attributes, or ordering key'
                WHEN contains(topic, '/') OR NOT regexp_matches(topic, '^[A-Za-z][A-Za-z0-9._~+%-]{2,254}$')
                THEN 'Pub/Sub topic name is syntactically invalid' END) AS reason,
         CASE WHEN malformed IS NOT NULL THEN 'orderingKey' END AS rejected_field
  FROM (SELECT id, resolved_destination AS topic, payload AS data,
               CASE WHEN json_type(j, '$.pubsub.orderingKey') = 'VARCHAR'
                    THEN json_extract_string(j, '$.pubsub.orderingKey') ELSE '' END AS ordering_key,
               json_extract_string(j, '$.pubsub.attributes.type') AS attribute_type,
               CASE WHEN json_type(j, '$.pubsub.orderingKey') NOT IN ('VARCHAR', 'NULL')
                    THEN 'malformed event options: orderingKey must be a string' END AS malformed
        FROM triaged WHERE triage = 'dispatch' AND resolved_target = 'pubsub') m"""

SQS_ENTRIES = """
  SELECT id, queue, fifo, body, given_group,
         CASE WHEN fifo AND given_group = '' THEN 'relay-' || sha256(CAST(id AS VARCHAR)) ELSE given_group END AS message_group_id,
         CASE WHEN fifo THEN CAST(id AS VARCHAR) ELSE '' END AS deduplication_id,
         CASE WHEN NOT fifo THEN delay END AS delay_seconds,
         CAST(strlen(body) AS BIGINT) AS message_size,
         coalesce(malformed, CASE WHEN body = '' OR delay > 900 THEN 'Event is invalid for SQS' END) AS reason,
         CASE WHEN malformed IS NOT NULL THEN 'messageGroupId' END AS rejected_field
  FROM (SELECT id, resolved_destination AS queue, payload AS body, suffix(resolved_destination, '.fifo') AS fifo,
               CASE WHEN json_type(j, '$.sqs.messageGroupId') = 'VARCHAR'
                    THEN json_extract_string(j, '$.sqs.messageGroupId') ELSE '' END AS given_group,
               CAST(json_extract_string(j, '$.sqs.delaySeconds') AS BIGINT) AS delay,
               CASE WHEN json_type(j, '$.sqs.messageGroupId') NOT IN ('VARCHAR', 'NULL')
                    THEN 'malformed event options: messageGroupId must be a string' END AS malformed
        FROM triaged WHERE triage = 'dispatch' AND resolved_target = 'sqs') s"""

PUBSUB_ATTEMPTS = """
  SELECT id, CASE WHEN id % 31 = 0 THEN 'deadline' WHEN id % 17 = 0 THEN 'permanent'
                  WHEN id % 13 = 0 THEN 'retryable' ELSE 'ok' END AS first,
         CASE WHEN id % 17 <> 0 OR id % 31 = 0 THEN 'none' WHEN id % 34 = 0 THEN 'ok'
              WHEN id % 51 = 0 THEN 'permanent' ELSE 'retryable' END AS retry
  FROM messages WHERE reason IS NULL"""

PUBSUB_OUTCOMES = """
  SELECT m.id, topic, ordering_key,
         CASE WHEN first = 'ok' OR (first = 'permanent' AND retry = 'ok') THEN 'confirmed'
              WHEN first = 'permanent' AND retry = 'permanent' THEN 'poison' END AS outcome,
         CASE WHEN first = 'permanent' AND retry = 'permanent' THEN 'rejected ' || CAST(m.id AS VARCHAR) END AS reason,
         CASE WHEN first = 'ok' OR (first = 'permanent' AND retry IN ('ok', 'permanent')) THEN 0
              WHEN ordering_key <> '' THEN CASE WHEN first = 'deadline' THEN 2 ELSE 1 END
              WHEN first = 'permanent' THEN 2 ELSE 1 END AS errors,
         ordering_key <> '' AND first = 'deadline' AS fatal,
         ordering_key <> '' AND (first IN ('deadline', 'retryable') OR (first = 'permanent' AND retry = 'retryable')) AS blocking
  FROM messages m JOIN attempts a ON m.id = a.id"""

CHUNKED = """
  SELECT entries.*, CASE WHEN NOT fifo THEN (row_number() OVER (PARTITION BY queue ORDER BY id) - 1) // 10 + 1 END AS chunk_no
  FROM entries WHERE reason IS NULL"""

SQS_REQUESTS = """
  SELECT chunked.*, count(*) OVER c AS members, min(id) OVER c AS first_id, NOT fifo AND bool_or(id % 59 = 0) OVER c AS failed,
         NOT fifo AND bool_or(id % 47 = 0) OVER c AS refused
  FROM chunked WINDOW c AS (PARTITION BY queue, chunk_no, CASE WHEN fifo THEN id END)"""

SQS_OUTCOMES = """
  SELECT id, queue, message_group_id, fifo, chunk_no,
         CASE WHEN failed THEN NULL WHEN refused AND (members = 1 OR id % 47 = 0) THEN 'poison' WHEN refused AND id % 37 = 0 THEN NULL
              WHEN id % 29 = 0 THEN NULL WHEN id % 19 = 0 THEN 'poison' WHEN id % 23 = 0 THEN NULL ELSE 'confirmed' END AS outcome,
         CASE WHEN failed THEN NULL WHEN refused AND (members = 1 OR id % 47 = 0) THEN 'invalid characters' WHEN refused AND id % 37 = 0 THEN NULL
              WHEN id % 29 <> 0 AND id % 19 = 0 THEN 'InvalidParameterValue: bad entry' END AS reason,
         CASE WHEN failed THEN id = first_id ELSE refused AND members > 1 AND id % 47 <> 0 AND id % 37 = 0 END AS error,
         fifo AND (id % 29 = 0 OR (id % 23 = 0 AND id % 19 <> 0)) AS blocking
  FROM sqs_requests"""

DELIVERED = """
  SELECT id, destination, ordering_key, body, CASE WHEN id % 59 = 0 THEN id * 4 - 1997 ELSE id * 4 END AS arrival
  FROM expected WHERE id % 41 <> 0
  UNION ALL SELECT id, destination, ordering_key, body, id * 4 + 1 FROM expected WHERE id % 37 = 0
  UNION ALL SELECT id + 1000000000, destination, ordering_key, body, id * 4 + 2 FROM expected WHERE id % 43 = 0"""

EXPECTED = """
  SELECT id, topic AS destination, ordering_key, lpad(CAST(id AS VARCHAR), 15, '0') AS body FROM messages WHERE reason IS NULL"""

BATCH_LOG = """
  SELECT batch_no, committed_at, selected * (1 - failed) AS selected, sent * (1 - failed) AS sent,
         CAST(0 AS BIGINT) AS poison, dlq * (1 - failed) AS dlq, kept * (1 - failed) AS kept,
         sender_errors * (1 - failed) AS sender_errors, fatal * (1 - failed) AS fatal, failed,
         CAST(users % 5000 AS DOUBLE) / 8 AS oldest_age_s, CAST(users % 300 AS DOUBLE) / 64 AS publish_s,
         CAST(users % 300 AS DOUBLE) / 128 AS db_s
  FROM (SELECT event_id // 100 AS batch_no, max(ts) AS committed_at, count(*) AS selected,
               count(*) FILTER (WHERE event_type IN ('click', 'view')) AS sent,
               count(*) FILTER (WHERE event_type = 'error') AS dlq,
               count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS kept,
               count(*) FILTER (WHERE event_id % 31 = 0) AS sender_errors,
               max(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) AS fatal,
               CAST(sum(user_id) AS BIGINT) AS users,
               CASE WHEN event_id // 100 % 13 = 5 THEN 1 ELSE 0 END AS failed
        FROM events GROUP BY event_id // 100) b"""

VIEWS = {
    "outbox": OUTBOX,
    "resolved": RESOLVED,
    "routable": ROUTABLE,
    "fair": FAIR_SHARE,
    "triaged": _triaged("routable"),
    "triaged_batch": _triaged("fair"),
    "messages": PUBSUB_MESSAGES,
    "entries": SQS_ENTRIES,
    "attempts": PUBSUB_ATTEMPTS,
    "outcomes": PUBSUB_OUTCOMES,
    "chunked": CHUNKED,
    "sqs_requests": SQS_REQUESTS,
    "sqs_outcomes": SQS_OUTCOMES,
    "expected": EXPECTED,
    "delivered": DELIVERED,
    "batch_log": BATCH_LOG,
}

NEEDS = {
    "resolved": ["outbox"],
    "routable": ["resolved"],
    "fair": ["routable"],
    "triaged": ["routable"],
    "triaged_batch": ["fair"],
    "messages": ["triaged"],
    "entries": ["triaged"],
    "attempts": ["messages"],
    "outcomes": ["attempts"],
    "chunked": ["entries"],
    "sqs_requests": ["chunked"],
    "sqs_outcomes": ["sqs_requests"],
    "expected": ["messages"],
    "delivered": ["expected"],
}


def over(views: str, body: str, extra: str = "") -> str:
    """SQL text: the named views with what they need, then ``body``."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for view in views.split():
        need(view)
    recursive = "RECURSIVE " if "walk(" in extra else ""
    parts = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    if extra:
        parts.append(extra)
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body
