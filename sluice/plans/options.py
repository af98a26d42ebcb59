"""Queries on options parsing and provider limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.config import PUBSUB, SQS
from sluice.functions import options as O, pubsub, sqs
from sluice.functions.once import compute_once
from sluice.operators.routing import routable_events
from sluice.operators.triage import with_sections
from sluice.plans.catalog import query
from sluice.plans.messaging import entries, messages
from sluice.plans.sqltext import over
from sluice.plans.testdata import CONFIG, events, every, outbox


def sections(spark, d) -> DataFrame:
    return with_sections(routable_events(outbox(spark, d), CONFIG), CONFIG)


# SQS option sections of many shapes, by id. Each entry is a prefix and a
# suffix around the id, which makes the values differ from row to row.
SQS_SHAPES = [
    ('{"attributes":{"a":{"DataType":"String","StringValue":"v', '"}}}'),
    ('{"attributes":{"n":{"DataType":"Number.int","StringValue":"', '"},"b":{"DataType":"Binary","BinaryValue":"SGVsbG8="}}}'),
    ('{"attributes":{"b":{"DataType":"Binary","BinaryValue":"SGVsbG8"},"c', '":{"DataType":"String","StringValue":"x"}}}'),
    ('{"attributes":{"s', '":{"StringValue":"x"}}}'),
    ('{"attributes":{"s":{"DataType":"String","StringValue":', '}}}'),
    ('{"attributes":[', ']}'),
    ('{"attributes":{"x":{"DataType":"String","StringValue":"v', '","StringListValues":null}}}'),
    ('{"attributes":{"aws.trace":{"DataType":"String","StringValue":"v', '"}}}'),
    ('{"attributes":{"ok":{"DataType":"Binary.gif","StringValue":"v', '"}}}'),
    ('{"attributes":null,"delaySeconds":"', '","messageSystemAttributes":{"AWSTraceHeader":""}}'),
    ('{"delaySeconds":30.0,"messageSystemAttributes":{"AWSTraceHeader":"Root=1-', '"}}'),
    ('{"delaySeconds":30.5,"messageSystemAttributes":{"Other', '":"x"}}'),
    ('{"delaySeconds":', '}'),
]


def _shape_sql() -> str:
    cases = " ".join(f"WHEN {n} THEN '{a}' || CAST(event_id AS VARCHAR) || '{b}'" for n, (a, b) in enumerate(SQS_SHAPES))
    return f"SELECT event_id AS id, CASE event_id % {len(SQS_SHAPES)} {cases} END AS doc FROM events"


SECTION_VIEW = f"""sections AS ({_shape_sql()}),
named AS (SELECT id, k AS name, json_extract(doc, '$.attributes."' || k || '"') AS a
          FROM (SELECT id, doc, unnest(json_keys(doc, '$.attributes')) AS k FROM sections WHERE json_type(doc, '$.attributes') = 'OBJECT') u),
parsed AS (SELECT id, name, json_extract_string(a, '$.DataType') AS data_type,
       CASE WHEN json_type(a, '$.StringValue') = 'VARCHAR' THEN json_extract_string(a, '$.StringValue') END AS string_value,
       CASE WHEN regexp_full_match(json_extract_string(a, '$.BinaryValue'),
                 '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?')
            THEN from_base64(json_extract_string(a, '$.BinaryValue')) END AS binary_value,
       CASE WHEN coalesce(json_extract_string(a, '$.DataType'), '') = '' THEN 'DataType is required'
            WHEN json_type(a, '$.StringValue') NOT IN ('VARCHAR', 'NULL') THEN 'StringValue must be a string'
            WHEN json_type(a, '$.BinaryValue') = 'VARCHAR' AND NOT regexp_full_match(json_extract_string(a, '$.BinaryValue'),
                 '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') THEN 'BinaryValue must be base64'
            WHEN list_contains(json_keys(a), 'StringListValues') THEN 'StringListValues is reserved by SQS and not supported'
       END AS error FROM named)"""


def sqs_sections(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("id", F.col("event_id"))
    doc = F.lit(None).cast("string")
    for n, (before, after) in enumerate(SQS_SHAPES):
        doc = F.when(every(len(SQS_SHAPES), n), F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after))).otherwise(doc)
    return compute_once(e.select("id", doc.alias("doc")), ["id"], {"_section": O.parse_options("doc")})


@query("options_root", over("outbox", """
SELECT id, CASE WHEN options IS NULL OR options = '' THEN NULL
                WHEN NOT json_valid(options) THEN 'malformed event options: options column must be valid JSON'
                WHEN left(options, 1) <> '{' THEN 'malformed event options: options column must be an object' END AS error
FROM outbox"""))
def _(spark, d):
    rows = compute_once(outbox(spark, d), ["id", "options"], {"_parsed": O.parse_options("options")})
    return rows.selectExpr("id", f"{O.root_error('options', '_parsed')} AS error")


@query("options_section", over("triaged", """
SELECT id, resolved_target AS target, coalesce(json_type(j, '$.' || resolved_target) = 'OBJECT', false) AS present, options_error AS error
FROM triaged"""))
def _(spark, d):
    return sections(spark, d).selectExpr("id", "resolved_target AS target",
                                         "coalesce(schema_of_variant(_section) LIKE 'OBJECT%', false) AS present", "options_error AS error")


@query("option_string", over("triaged", """
SELECT id, CASE WHEN json_type(j, p) = 'VARCHAR' THEN json_extract_string(j, p) ELSE '' END AS value,
       CASE WHEN json_type(j, p) NOT IN ('VARCHAR', 'NULL') THEN 'malformed event options: ' || k || ' must be a string' END AS error
FROM (SELECT *, CASE resolved_target WHEN 'pubsub' THEN 'orderingKey' ELSE 'messageGroupId' END AS k,
             CASE resolved_target WHEN 'pubsub' THEN '$.pubsub.orderingKey' ELSE '$.sqs.messageGroupId' END AS p FROM triaged) t"""))
def _(spark, d):
    def by_target(read) -> str:
        to_pubsub, to_sqs = (read("_section", key) for key in ("orderingKey", "messageGroupId"))
        return f"CASE WHEN resolved_target = '{PUBSUB}' THEN {to_pubsub} ELSE {to_sqs} END"

    return sections(spark, d).selectExpr("id", f"{by_target(O.string_value)} AS value", f"{by_target(O.string_error)} AS error")


@query("option_object", over("triaged", """
SELECT id, CAST(CASE WHEN json_type(j, '$.pubsub.attributes') = 'OBJECT' THEN len(json_keys(j, '$.pubsub.attributes')) END AS BIGINT) AS entries
FROM triaged WHERE resolved_target = 'pubsub'"""))
def _(spark, d):
    rows = sections(spark, d).filter(F.col("resolved_target") == PUBSUB)
    return rows.selectExpr("id", f"CAST(size({O.object_value('_section', 'attributes')}) AS BIGINT) AS entries")


@query("sanitize_attributes", over("triaged", """
SELECT id, json_extract_string(j, '$.pubsub.attributes.type') AS kept_type,
       CASE WHEN json_type(j, '$.pubsub.attributes.n') IS NOT NULL THEN 'n' ELSE '' END AS dropped
FROM triaged WHERE resolved_target = 'pubsub' AND json_type(j, '$.pubsub.attributes') = 'OBJECT'"""))
def _(spark, d):
    rows = sections(spark, d).filter(F.col("resolved_target") == PUBSUB)
    rows = compute_once(rows, ["id"], {"_a": O.object_value("_section", "attributes")}).filter("_a IS NOT NULL")
    return rows.selectExpr("id", f"try_element_at({O.kept_attributes('_a')}, 'type') AS kept_type",
                           f"array_join({O.dropped_attributes('_a')}, ',') AS dropped")


@query("sqs_attributes", over("", "SELECT id, name, data_type, string_value, hex(binary_value) AS binary_hex, error FROM parsed", SECTION_VIEW))
def _(spark, d):
    rows = sqs_sections(spark, d).selectExpr("id", f"explode({O.sqs_attributes('_section')}) AS (name, a)")
    return rows.select("id", "name", "a.data_type", "a.string_value", F.hex("a.binary_value").alias("binary_hex"), "a.error")


@query("sqs_binary_attribute", over("", """
SELECT id, json_extract_string(a, '$.BinaryValue') AS text,
       CASE WHEN length(json_extract_string(a, '$.BinaryValue')) % 4 = 0 THEN hex(from_base64(json_extract_string(a, '$.BinaryValue'))) END AS decoded
FROM named WHERE json_type(a, '$.BinaryValue') = 'VARCHAR'""", SECTION_VIEW))
def _(spark, d):
    rows = sqs_sections(spark, d).selectExpr("id", f"explode({O.object_value('_section', 'attributes')}) AS (name, a)")
    rows = rows.select("id", F.try_variant_get("a", "$.BinaryValue", "string").alias("text")).filter("text IS NOT NULL")
    return rows.selectExpr("id", "text", f"hex({O.strict_base64('text')}) AS decoded")


@query("sqs_delay_seconds", over("", """
SELECT id, CASE WHEN whole THEN CAST(number AS BIGINT) END AS delay_seconds,
       CASE WHEN NOT whole THEN 'malformed event options: delaySeconds must be an integer' END AS error
FROM (SELECT id, number, json_type(doc, '$.delaySeconds') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND number = floor(number) AS whole
      FROM (SELECT id, doc, CAST(json_extract_string(doc, '$.delaySeconds') AS DOUBLE) AS number FROM sections) n
      WHERE json_type(doc, '$.delaySeconds') IS NOT NULL) s""", SECTION_VIEW))
def _(spark, d):
    rows = sqs_sections(spark, d).filter("try_variant_get(_section, '$.delaySeconds', 'variant') IS NOT NULL")
    return rows.selectExpr("id", f"CAST({O.delay_value('_section')} AS BIGINT) AS delay_seconds", f"{O.delay_error('_section')} AS error")


@query("sqs_trace_header", over("", """
SELECT id, CASE WHEN id % 13 = 10 THEN json_extract_string(doc, '$.messageSystemAttributes.AWSTraceHeader') ELSE '' END AS trace_header,
       CASE WHEN NOT list_contains(json_keys(doc, '$.messageSystemAttributes'), 'AWSTraceHeader')
            THEN 'malformed event options: only AWSTraceHeader is supported in messageSystemAttributes'
            WHEN json_extract_string(doc, '$.messageSystemAttributes.AWSTraceHeader') = ''
            THEN 'malformed event options: AWSTraceHeader is required' END AS error
FROM sections WHERE json_type(doc, '$.messageSystemAttributes') = 'OBJECT'""", SECTION_VIEW))
def _(spark, d):
    rows = sqs_sections(spark, d).filter("try_variant_get(_section, '$.messageSystemAttributes', 'variant') IS NOT NULL")
    return rows.selectExpr("id", f"{O.trace_value('_section')} AS trace_header", f"{O.trace_error('_section')} AS error")


TOPICS = ["orders.paid", "zz9", "q", "-late", "googly", "a b c", "projects/shop-eu/topics/orders.paid",
          "projects/shop-eu/topics/", "projects/shop-eu/orders.paid", "r2d2+c3po~x%y_z", "projects/shop-eu/topics/googly"]
QUEUES = ["https://sqs.example/1/q", "queue-", "http:///q", "https://sqs.example/", "ftp://host/q", "a b", "q%zz", "bad:seg/", "/path/q",
          "https://user:pw@host:80/q", "https://host?x=/q"]


def _pick(values: list[str], suffixed: bool = False):
    chosen = F.lit(None).cast("string")
    for n, value in enumerate(values):
        chosen = F.when(every(len(values), n, "event_id"), F.lit(value)).otherwise(chosen)
    return F.concat(chosen, F.col("user_id").cast("string")) if suffixed else chosen


def _pick_sql(values: list[str]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


@query("pubsub_topic_valid", f"""
SELECT id, topic, CASE WHEN len(parts) = 4 THEN parts[1] = 'projects' AND parts[2] <> '' AND parts[3] = 'topics' ELSE len(parts) = 1 END
       AND regexp_matches(parts[-1], '^[A-Za-z][A-Za-z0-9._~+%-]{{2,254}}$') AND NOT starts_with(lower(parts[-1]), 'goog') AS valid
FROM (SELECT event_id AS id, {_pick_sql(TOPICS)} AS topic, string_split({_pick_sql(TOPICS)}, '/') AS parts FROM events) t""")
def _(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("id"), _pick(TOPICS).alias("topic"))
    return rows.selectExpr("id", "topic", f"{pubsub.topic_valid('topic')} AS valid")


@query("pubsub_attributes_valid", """
SELECT id, keys <= 100 AND length(name) BETWEEN 1 AND 256 AND width <= 1024 AND NOT starts_with(lower(name), 'goog') AS valid
FROM (SELECT event_id AS id, user_id % 110 AS keys, 1020 + event_id % 8 AS width,
             CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'GoogX' ELSE repeat('k', CAST(250 + event_id % 9 AS INTEGER)) END AS name
      FROM events) a""")
def _(spark, d):
    e = events(spark, d).withColumn("id", F.col("event_id"))
    name = F.when(every(13), "").when(every(11), "GoogX").otherwise(F.repeat(F.lit("k"), (250 + F.col("id") % 9).cast("int")))
    first = F.create_map(name, F.repeat(F.lit("v"), (1020 + F.col("id") % 8).cast("int")))
    keys = (F.col("user_id") % 110).cast("int")
    rest = F.when(keys > 1, F.transform(F.sequence(F.lit(2), keys), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("k"), F.lit("x").alias("v")))) \
        .otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<k: STRING, v: STRING>>)"))
    rows = compute_once(e.select("id", F.map_concat(first, F.map_from_entries(rest)).alias("m")), ["id"], {"attributes": "m"})
    return rows.selectExpr("id", f"{pubsub.attributes_valid('attributes')} AS valid")


@query("pubsub_poison", over("messages", "SELECT id, reason FROM messages WHERE reason IS NOT NULL AND rejected_field IS NULL"))
def _(spark, d):
    return messages(spark, d).filter("reason IS NOT NULL AND rejected_field IS NULL").select("id", "reason")


@query("sqs_text_valid", """
SELECT id, NOT regexp_matches(text, '[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]') AS valid
FROM (SELECT event_id AS id, props || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN chr(1) WHEN 2 THEN chr(9) || chr(10) || chr(13)
             WHEN 3 THEN chr(65534) WHEN 4 THEN chr(128512) WHEN 5 THEN chr(31) ELSE chr(57344) END AS text FROM events) t""")
def _(spark, d):
    tails = ["", "\x01", "\t\n\r", "￾", "\U0001f600", "\x1f", ""]
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.concat("props", _pick(tails)).alias("text"))
    return rows.selectExpr("id", f"{sqs.text_valid('text')} AS valid")


@query("sqs_message_size", over("", """
SELECT s.id, CAST(strlen(props) + coalesce(attribute_bytes, 0) AS BIGINT) AS message_size
FROM sections s JOIN events e ON s.id = e.event_id LEFT JOIN
     (SELECT id, sum(strlen(name) + strlen(data_type) + coalesce(strlen(string_value), 0) + coalesce(octet_length(binary_value), 0)) AS attribute_bytes
      FROM parsed GROUP BY id) a ON a.id = s.id""", SECTION_VIEW))
def _(spark, d):
    shaped = sqs_sections(spark, d).join(events(spark, d).select(F.col("event_id").alias("id"), "props"), "id")
    rows = compute_once(shaped, ["id", "props"], {"attributes": O.sqs_attributes("_section")})
    return rows.selectExpr("id", f"{sqs.message_size('props', 'attributes')} AS message_size")


@query("sqs_attributes_valid", over("", """
SELECT s.id, coalesce(fine, true) AND coalesce(n, 0) <= 10 AS valid FROM sections s LEFT JOIN (SELECT id, count(*) AS n,
         bool_and(regexp_matches(name, '^[A-Za-z0-9_.-]{1,256}$') AND NOT starts_with(lower(name), 'aws.') AND NOT starts_with(lower(name), 'amazon.')
         AND NOT starts_with(name, '.') AND NOT ends_with(name, '.') AND NOT contains(name, '..')
         AND coalesce(split_part(data_type, '.', 1) IN ('String', 'Number', 'Binary'), false)
         AND CASE WHEN starts_with(data_type, 'Binary') THEN binary_value IS NOT NULL AND string_value IS NULL
                  ELSE coalesce(string_value, '') <> '' AND binary_value IS NULL
                       AND NOT regexp_matches(coalesce(string_value, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]') END) AS fine
FROM parsed GROUP BY id) a ON a.id = s.id""", SECTION_VIEW))
def _(spark, d):
    rows = compute_once(sqs_sections(spark, d), ["id"], {"attributes": O.sqs_attributes("_section")})
    return rows.selectExpr("id", f"{sqs.attributes_valid('attributes')} AS valid")


@query("sqs_poison", over("entries", "SELECT id, reason FROM entries WHERE reason IS NOT NULL AND rejected_field IS NULL"))
def _(spark, d):
    return entries(spark, d).filter("reason IS NOT NULL AND rejected_field IS NULL").select("id", "reason")


OBJECTS = ['{"a":1,"b":"x"}', "[1]", '"text"', "null", "7", "{}", '{"a":{"b":2}}']


@query("option_object_errors", f"""
SELECT id, target, CAST(CASE WHEN json_type(j, path) = 'OBJECT' THEN len(json_keys(j, path)) END AS BIGINT) AS entries,
       CASE WHEN coalesce(json_type(j, path), 'NULL') NOT IN ('OBJECT', 'NULL') THEN 'malformed event options: attributes must be an object' END AS error
FROM (SELECT event_id AS id, target, '$.' || target || '.attributes' AS path,
             '{{"' || target || '":{{' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '"attributes":' || {_pick_sql(OBJECTS)} END || '}}}}' AS j
      FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'pubsub' ELSE 'sqs' END AS target FROM events) e) r""")
def _(spark, d):
    """A typed object of either provider: its entries, or its error."""
    given = F.when(every(11, 0, "event_id"), "").otherwise(F.concat(F.lit('"attributes":'), _pick(OBJECTS)))
    rows = events(spark, d).withColumn("resolved_target", F.when(every(2, 0, "user_id"), PUBSUB).otherwise(SQS))
    rows = rows.select(F.col("event_id").alias("id"), "resolved_target", F.concat(
        F.lit('{"'), "resolved_target", F.lit('":{'), given, F.lit("}}")).alias("options"))
    read = compute_once(rows, ["id", "resolved_target"], {"_p": O.parse_options("options")})
    read = compute_once(read, ["id", "resolved_target"], {"_section": O.section_of("_p", "resolved_target", [PUBSUB, SQS])})
    return read.selectExpr("id", "resolved_target AS target", f"CAST(size({O.object_value('_section', 'attributes')}) AS BIGINT) AS entries",
                           f"{O.object_error('_section', 'attributes')} AS error")


# The rule once more, for a reader without lookahead: no blank or control character, every % a full escape up to a ?, and a colon
# in the first segment only in an http(s) address with a host and a path that is not just slashes.
QUEUE_RULE = r"""queue <> '' AND NOT regexp_matches(queue, '[\x00-\x20\x7F]')
  AND len(regexp_extract_all(split_part(queue, '?', 1), '%')) = len(regexp_extract_all(split_part(queue, '?', 1), '%[0-9A-Fa-f]{2}'))
  AND (NOT regexp_matches(queue, '^[^/?#]*:') OR regexp_matches(queue,
       '^[Hh][Tt][Tt][Pp][Ss]?://([^/?#@]*@)?(\[[0-9A-Za-z:.%]+\](:[0-9]*)?|[^/?#:@\[\]{}|\\^`]+(:[0-9]*)?|:[0-9]*)/+[^/?#]'))"""


@query("sqs_queue_valid", f"""
SELECT id, queue, {QUEUE_RULE} AS valid
FROM (SELECT event_id AS id, {_pick_sql(QUEUES)} || CASE WHEN event_id % {len(QUEUES)} = 3 THEN ''
             ELSE CAST(user_id AS VARCHAR) END AS queue FROM events) q""")
def _(spark, d):
    suffix = F.when(every(len(QUEUES), 3, "event_id"), "").otherwise(F.col("user_id").cast("string"))
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.concat(_pick(QUEUES), suffix).alias("queue"))
    return rows.selectExpr("id", "queue", f"{sqs.queue_valid('queue')} AS valid")


@query("sqs_safe_ids", """
SELECT id, CASE WHEN regexp_matches(raw, '^[A-Za-z0-9_-]{1,80}$') THEN raw ELSE sha256(raw) END AS entry_id,
       CASE WHEN length(raw) BETWEEN 1 AND 128 AND NOT contains(raw, ' ') THEN raw ELSE sha256(raw) END AS fifo_id,
       'relay-' || sha256(raw) AS fifo_group
FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'a b' || CAST(event_id AS VARCHAR)
             WHEN 2 THEN 'k/' || CAST(event_id AS VARCHAR) ELSE repeat('x', CAST(78 + event_id % 60 AS INTEGER)) END AS raw FROM events) i""")
def _(spark, d):
    e = events(spark, d).withColumn("id", F.col("event_id"))
    text = F.col("id").cast("string")
    raw = F.when(every(4), text).when(every(4, 1), F.concat(F.lit("a b"), text)).when(every(4, 2), F.concat(F.lit("k/"), text)) \
        .otherwise(F.repeat(F.lit("x"), (78 + F.col("id") % 60).cast("int")))
    return e.select("id", raw.alias("raw")).selectExpr(
        "id", f"{sqs.safe_id('raw', sqs.ENTRY_ID)} AS entry_id", f"{sqs.safe_id('raw', sqs.FIFO_ID)} AS fifo_id",
        f"{sqs.synthetic_group('raw', CONFIG.fifo_group_prefix)} AS fifo_group")
