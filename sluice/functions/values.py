"""Normalising column values: text, bytes, timestamps."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, DataType, StringType, TimestampNTZType, TimestampType

from sluice.functions.once import text

# The accepted timestamp layouts, as shape guards. Spark's own
# parser would also take bare dates and years.
RFC3339_SHAPE = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
ZONELESS_SHAPE = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}([.,]\d+)?\z"


def rfc3339(ts: str) -> str:
    """UTC RFC 3339 text with trailing fraction zeros (and a bare dot) removed."""
    whole = f"date_format({ts}, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')"
    return f"concat(rtrim('.', rtrim('0', {whole})), 'Z')"


def as_text(col: str, dtype: DataType) -> str:
    """A column value as text; NULL becomes the empty string."""
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return f"coalesce({rfc3339(col)}, '')"
    return f"coalesce(CAST({col} AS STRING), '')"


def as_bytes(col: str, dtype: DataType) -> str:
    """A column value as bytes; NULL becomes empty bytes."""
    if isinstance(dtype, BinaryType):
        return f"coalesce({col}, X'')"
    return f"CAST({as_text(col, dtype)} AS BINARY)"


def as_timestamp(col: str, dtype: DataType) -> str:
    """UTC timestamp of a timestamp or text column; NULL when it has none."""
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return f"CAST({col} AS TIMESTAMP)"
    if isinstance(dtype, (StringType, BinaryType)):
        dotted = f"replace(CAST({col} AS STRING), ',', '.')"
        shaped = f"{dotted} RLIKE {text(RFC3339_SHAPE)} OR {dotted} RLIKE {text(ZONELESS_SHAPE)}"
        return f"try_to_timestamp(CASE WHEN {shaped} THEN {dotted} END)"
    return "CAST(NULL AS TIMESTAMP)"
