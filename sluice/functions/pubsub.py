"""Pub/Sub message limits as SQL expressions."""

from __future__ import annotations

from sluice.functions.once import first_match, text, texts

# Provider limits, topic syntax and reason texts.
MAX_DATA_BYTES = 10_000_000
MAX_ATTRIBUTES = 100
MAX_KEY_BYTES = 256
MAX_VALUE_BYTES = 1024
TOPIC_ID = r"\A[A-Za-z][A-Za-z0-9._~+%-]{2,254}\z"
TOO_LARGE = "Pub/Sub message data exceeds 10 MB"
EMPTY_MESSAGE = "Pub/Sub message has no data, attributes, or ordering key"
BAD_ATTRIBUTES = "Pub/Sub attributes exceed provider limits"
BAD_TOPIC = "Pub/Sub topic name is syntactically invalid"
PERMANENT_CODES = ("400", "InvalidArgument", "OutOfRange")


def _reserved(name: str) -> str:
    return f"startswith(lower({name}), 'goog')"


def topic_valid(topic: str) -> str:
    """A bare topic id, or projects/<project>/topics/<topic id>."""
    topic_id = f"substring_index({topic}, '/', -1)"
    prefix_ok = f"{topic} NOT LIKE '%/%' OR {topic} RLIKE {text(r'\Aprojects/[^/]+/topics/[^/]*\z')}"
    return f"(({prefix_ok}) AND {topic_id} RLIKE {text(TOPIC_ID)} AND NOT {_reserved(topic_id)})"


def attributes_valid(attributes: str) -> str:
    entry_ok = (f"e.key <> '' AND octet_length(e.key) <= {MAX_KEY_BYTES} "
                f"AND octet_length(e.value) <= {MAX_VALUE_BYTES} AND NOT {_reserved('e.key')}")
    return (f"(coalesce(size({attributes}) <= {MAX_ATTRIBUTES}, true) "
            f"AND coalesce(forall(map_entries({attributes}), e -> {entry_ok}), true))")


def poison_reason(topic: str, data: str, ordering_key: str, attributes: str) -> str:
    """First limit the message breaks, NULL when it can be published."""
    size = f"coalesce(octet_length({data}), 0)"
    nothing = f"{size} = 0 AND coalesce(size({attributes}), 0) <= 0 AND {ordering_key} = ''"
    return first_match(
        (f"{size} > {MAX_DATA_BYTES}", text(TOO_LARGE)), (nothing, text(EMPTY_MESSAGE)),
        (f"NOT {attributes_valid(attributes)}", text(BAD_ATTRIBUTES)), (f"NOT {topic_valid(topic)}", text(BAD_TOPIC)))


def permanent_error(code: str) -> str:
    return f"coalesce({code} IN ({texts(PERMANENT_CODES)}), false)"
