"""SQS entry limits as SQL expressions."""

from __future__ import annotations

from sluice.functions.once import first_match, text, texts

# Provider limits, id and name syntax, reason texts, error codes.
MAX_ENTRIES = 10
MAX_BYTES = 1024 * 1024
MAX_ATTRIBUTES = 10
MAX_DELAY_SECONDS = 900
ENTRY_ID = r"\A[A-Za-z0-9_-]{1,80}\z"
FIFO_ID = r"""\A[A-Za-z0-9!"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{|}~]{1,128}\z"""
ATTRIBUTE_NAME = r"\A[A-Za-z0-9_.-]{1,256}\z"
DISALLOWED_TEXT = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
INVALID_EVENT = "Event is invalid for SQS"
INVALID_QUEUE = "SQS queue URL is syntactically invalid"
PERMANENT_REQUEST_CODES = (
    "InvalidMessageContents", "BatchRequestTooLong", "InvalidBatchEntryId",
    "BatchEntryIdsNotDistinct", "TooManyEntriesInBatchRequest",
)
# Queue URL syntax: what a URL parser refuses anywhere, a scheme, and an
# absolute http(s) address with a host and a path that is not just slashes.
URL_REFUSED = r"[\x00-\x20\x7F]|\A[^?]*%(?![0-9A-Fa-f]{2})"
URL_FIRST_SEGMENT_COLON = r"\A[^/?#]*:"
URL_ABSOLUTE = (r"\A[Hh][Tt][Tt][Pp][Ss]?://"
                r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
                r"(?:\[[0-9A-Za-z:.%]+\](?::[0-9]*)?|[^\s/?#:@\[\]{}|\\^`]+(?::[0-9]*)?|:[0-9]*)"
                r"/+[^/?#]")


def queue_valid(queue: str) -> str:
    return (f"({queue} <> '' AND NOT {queue} RLIKE {text(URL_REFUSED)} "
            f"AND (NOT {queue} RLIKE {text(URL_FIRST_SEGMENT_COLON)} OR {queue} RLIKE {text(URL_ABSOLUTE)}))")


def is_fifo(queue: str) -> str:
    return f"endswith({queue}, '.fifo')"


def text_valid(value: str) -> str:
    """Valid UTF-8 made only of characters the queue service accepts."""
    return f"(is_valid_utf8({value}) AND NOT {value} RLIKE {text(DISALLOWED_TEXT)})"


def message_size(body: str, attributes: str) -> str:
    """Bytes of the body plus each attribute's name, type and value."""
    entry = ("n + octet_length(e.key) + octet_length(e.value.data_type) "
             "+ coalesce(octet_length(e.value.string_value), 0) + coalesce(octet_length(e.value.binary_value), 0)")
    return f"CAST(octet_length({body}) + coalesce(aggregate(map_entries({attributes}), 0, (n, e) -> {entry}), 0) AS BIGINT)"


def attributes_valid(attributes: str) -> str:
    name_ok = (f"e.key RLIKE {text(ATTRIBUTE_NAME)} AND NOT startswith(lower(e.key), 'aws.') "
               "AND NOT startswith(lower(e.key), 'amazon.') AND NOT startswith(e.key, '.') AND NOT endswith(e.key, '.') "
               "AND NOT contains(e.key, '..')")
    type_ok = "substring_index(e.value.data_type, '.', 1) IN ('String', 'Number', 'Binary')"
    value_ok = first_match(
        ("startswith(e.value.data_type, 'Binary')",
         "e.value.binary_value IS NOT NULL AND octet_length(e.value.binary_value) > 0 AND e.value.string_value IS NULL"),
        otherwise=("e.value.string_value IS NOT NULL AND e.value.binary_value IS NULL AND e.value.string_value <> '' "
                   f"AND {text_valid('e.value.string_value')}"))
    return (f"(coalesce(size({attributes}) <= {MAX_ATTRIBUTES}, true) AND "
            f"coalesce(forall(map_entries({attributes}), e -> coalesce({name_ok} AND {type_ok} AND {value_ok}, false)), true))")


def is_poison(body: str, attributes: str, group_id: str, dedup_id: str, delay: str) -> str:
    """True when the queue service can never accept the entry.

    Delay and deduplication id are checked for both queue kinds, also where
    they are not sent.
    """
    body_text = f"CAST({body} AS STRING)"
    return (f"(coalesce(octet_length({body}), 0) = 0 OR NOT {text_valid(body_text)} "
            f"OR {message_size(body, attributes)} > {MAX_BYTES} OR NOT {attributes_valid(attributes)} "
            f"OR ({group_id} <> '' AND NOT {group_id} RLIKE {text(FIFO_ID)}) "
            f"OR ({dedup_id} <> '' AND NOT {dedup_id} RLIKE {text(FIFO_ID)}) "
            f"OR coalesce({delay} NOT BETWEEN 0 AND {MAX_DELAY_SECONDS}, false))")


def safe_id(value: str, pattern: str) -> str:
    return first_match((f"{value} RLIKE {text(pattern)}", value), otherwise=f"sha2({value}, 256)")


def synthetic_group(event_id: str, prefix: str) -> str:
    return f"concat({text(prefix)}, sha2({event_id}, 256))"


def permanent_request_error(code: str) -> str:
    return f"coalesce({code} IN ({texts(PERMANENT_REQUEST_CODES)}), false)"
