"""Provider messages from dispatched rows, and the order they go out in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from sluice.config import PUBSUB, SQS, RelayConfig
from sluice.functions import options as O, pubsub, sqs
from sluice.functions.once import column, compute_once, first_match, text
from sluice.functions.values import as_bytes, as_text
from sluice.operators.ranking import row_numbers
from sluice.operators.triage import age_micros, event_time
from sluice.session import stored


def provider_events(triaged: DataFrame, cfg: RelayConfig, carried: tuple[str, ...] = ()) -> DataFrame:
    """Provider-facing view of the dispatched rows, with further columns that are ``carried`` along."""
    payload = as_bytes(column(cfg.payload_col), triaged.schema[cfg.payload_col].dataType)
    return triaged.filter("triage = 'dispatch'").selectExpr(
        f"{column(cfg.id_col)} AS id", "resolved_target AS target", "resolved_destination AS destination",
        f"{payload} AS payload", f"{event_time(triaged, cfg)} AS event_time", "_section", *map(column, carried))


def publish_record(events: DataFrame, now: datetime) -> DataFrame:
    """Latency and size of each event as it is handed to a provider."""
    return events.selectExpr("id", "target", "destination", f"{age_micros('event_time', now)} / 1e6D AS latency_s",
                             "CAST(octet_length(payload) AS BIGINT) AS payload_bytes")


def pubsub_messages(events: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pub/Sub messages with the poison reason of those that cannot be sent.

    ``rejected_field`` names the option that was malformed, if one was.
    """
    sent = events.filter(f"target = '{PUBSUB}'").selectExpr("id", "destination AS topic", "payload AS data", "_section", *map(column, carried))
    read = compute_once(sent, ["id", "topic", "data", *carried], {
        "ordering_key": O.string_value("_section", "orderingKey"),
        "_attributes": O.object_value("_section", "attributes"),
        "_key_error": O.string_error("_section", "orderingKey"),
        "_attributes_error": O.object_error("_section", "attributes")})
    message = ["id", "topic", "data", *carried, "ordering_key"]
    kept = compute_once(read, [*message, "_key_error", "_attributes_error"], {
        "attributes": O.kept_attributes("_attributes"), "dropped_attributes": O.dropped_attributes("_attributes")})
    limit = pubsub.poison_reason("topic", "data", "ordering_key", "attributes")
    return compute_once(kept, [*message, "attributes", "dropped_attributes"], {
        "reason": f"coalesce(_key_error, _attributes_error, {limit})",
        "rejected_field": first_match(("_key_error IS NOT NULL", "'orderingKey'"),
                                      ("_attributes_error IS NOT NULL", "'attributes'"))})


def sqs_entries(events: DataFrame, cfg: RelayConfig, carried: tuple[str, ...] = ()) -> DataFrame:
    """SQS batch entries with the poison reason of those that cannot be sent.

    ``given_group`` is the group id of the options, before any synthetic one.
    """
    sent = events.filter(f"target = '{SQS}'").selectExpr("id", "destination AS queue", "payload AS body", "_section", *map(column, carried))
    read = compute_once(sent, sent.columns, {
        "fifo": sqs.is_fifo("queue"),
        "_url_ok": sqs.queue_valid("queue"),
        "given_group": O.string_value("_section", "messageGroupId"),
        "_dedup": O.string_value("_section", "messageDeduplicationId"),
        "_delay": O.delay_value("_section"),
        "trace_header": O.trace_value("_section"),
        "attributes": O.sqs_attributes("_section")})
    # In the order the checks are made: the first error is the reason.
    errors = {
        "messageGroupId": O.string_error("_section", "messageGroupId"),
        "attributes": O.sqs_attributes_error("_section", "attributes"),
        "messageDeduplicationId": O.string_error("_section", "messageDeduplicationId"),
        "delaySeconds": O.delay_error("_section"),
        "messageSystemAttributes": O.trace_error("_section"),
    }
    found = [f"CASE WHEN ({e}) IS NOT NULL THEN struct({text(field)} AS field, {e} AS error) END" for field, e in errors.items()]
    checked = compute_once(read, [c for c in read.columns if c != "_section"], {
        "_malformed": f"CASE WHEN _url_ok THEN coalesce({', '.join(found)}) END",
        "_poison": sqs.is_poison("body", "attributes", "given_group", "_dedup", "_delay"),
        "message_size": sqs.message_size("body", "attributes")})
    event_id = as_text("id", events.schema["id"].dataType)
    group = first_match(("fifo AND given_group = ''", sqs.synthetic_group(event_id, cfg.fifo_group_prefix)), otherwise="given_group")
    dedup = first_match(("NOT fifo", "''"), ("_dedup <> ''", "_dedup"), otherwise=sqs.safe_id(event_id, sqs.FIFO_ID))
    reason = first_match(("NOT _url_ok", text(sqs.INVALID_QUEUE)), ("_malformed IS NOT NULL", "_malformed.error"),
                         ("_poison", text(sqs.INVALID_EVENT)))
    return checked.selectExpr(
        "id", "queue", "fifo", f"{sqs.safe_id(event_id, sqs.ENTRY_ID)} AS entry_id", "body", "attributes",
        f"{group} AS message_group_id", f"{dedup} AS deduplication_id", "CASE WHEN NOT fifo THEN _delay END AS delay_seconds",
        "trace_header", "message_size", f"{reason} AS reason", "_malformed.field AS rejected_field", "given_group", *map(column, carried))


def pubsub_order_groups(messages: DataFrame) -> DataFrame:
    """Sendable ordered messages with their place in (topic, ordering key).

    Numbering takes three passes; they read a stored copy of three columns.
    """
    ordered = stored(messages.filter("reason IS NULL AND ordering_key <> ''").select("id", "topic", "ordering_key"))
    return row_numbers(ordered, ["topic", "ordering_key"], "id", "position")


def sqs_fifo_sequence(entries: DataFrame) -> DataFrame:
    """Request number of each FIFO entry: one per request, in order, per group."""
    fifo = stored(entries.filter("reason IS NULL AND fifo").select("id", "queue", "message_group_id"))
    return row_numbers(fifo, ["queue", "message_group_id"], "id", "request_no")


def prepared(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Sendable messages of both providers in one layout, for a message table."""
    from_pubsub = messages.filter("reason IS NULL").selectExpr(
        f"'{PUBSUB}' AS target", "topic AS destination", "id", "ordering_key AS order_key", "CAST(data AS STRING) AS body")
    from_sqs = entries.filter("reason IS NULL").selectExpr(
        f"'{SQS}' AS target", "queue AS destination", "id", "message_group_id AS order_key", "CAST(body AS STRING) AS body")
    return from_pubsub.unionByName(from_sqs)
