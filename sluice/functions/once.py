"""SQL expression text, and computing columns exactly once.

Expressions in this package are SQL text: one call hands a whole expression to
the JVM, where building it from column objects would take hundreds.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame


def text(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def column(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def instant(moment: datetime) -> str:
    """SQL timestamp of an aware datetime."""
    return f"timestamp_micros({micros(moment - datetime(1970, 1, 1, tzinfo=timezone.utc))}L)"


def first_match(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    """CASE over (condition, value) pairs."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {whens} ELSE {otherwise} END" if branches else otherwise


def compute_once(df: DataFrame, keep: list[str], computed: dict[str, str]) -> DataFrame:
    """Columns ``keep`` and the computed ones, each evaluated once per row.

    The optimizer copies a projected expression into every filter above it.
    For chains of JSON reads the copies multiply, in the plan and in the work
    per row. A one-element generator hands the values on as plain columns,
    which filters are not pushed through.
    """
    fields = ", ".join(f"{text(name)}, {expression}" for name, expression in computed.items())
    return df.selectExpr(*[column(c) for c in keep], f"inline(array(named_struct({fields})))")
