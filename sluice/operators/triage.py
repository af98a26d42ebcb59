"""Triage of a batch: expired, malformed, or ready to dispatch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from sluice.config import RelayConfig
from sluice.functions import options as O
from sluice.functions.once import column, compute_once, first_match, instant, micros, text, texts
from sluice.functions.values import as_timestamp

# Fixed value: reason text of an expired event.
EXPIRED = "Event expired by MAX_EVENT_AGE_MS"


def event_time(df: DataFrame, cfg: RelayConfig) -> str:
    """Normalised event timestamp; NULL without a timestamp column."""
    if not cfg.timestamp_col or cfg.timestamp_col not in df.columns:
        return "CAST(NULL AS TIMESTAMP)"
    return as_timestamp(column(cfg.timestamp_col), df.schema[cfg.timestamp_col].dataType)


def age_micros(ts: str, now: datetime) -> str:
    return f"(unix_micros({instant(now)}) - unix_micros({ts}))"


def expired(df: DataFrame, cfg: RelayConfig, now: datetime) -> str:
    """Strictly older than the maximum age; no usable timestamp never expires."""
    if not cfg.max_age:
        return "false"
    return f"coalesce({age_micros(event_time(df, cfg), now)} > {micros(cfg.max_age)}, false)"


def scan_invariant(batch: DataFrame, cfg: RelayConfig) -> DataFrame:
    """One row: selected rows, and those without a route or a sender.

    A single one of the latter fails the whole batch.
    """
    sound = f"resolved_target IN ({texts(b.target for b in cfg.backends)}) AND resolved_destination <> ''"
    return batch.selectExpr("count(*) AS selected", f"count_if(NOT coalesce({sound}, false)) AS broken")


def with_sections(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Add the target's options section and the structural error, if any."""
    if not cfg.options_col or cfg.options_col not in df.columns:
        return df.selectExpr("*", "CAST(NULL AS VARIANT) AS _section", "CAST(NULL AS STRING) AS options_error")
    raw = f"CAST({column(cfg.options_col)} AS STRING)"
    read = compute_once(df, df.columns, {"_parsed": O.parse_options(raw)})
    sectioned = compute_once(read, read.columns, {
        "_section": O.section_of("_parsed", "resolved_target", [b.target for b in cfg.backends]),
        "_root_error": O.root_error(raw, "_parsed")})
    return sectioned.selectExpr(*[column(c) for c in df.columns], "_section",
                                f"coalesce(_root_error, {O.section_error('_section', 'resolved_target')}) AS options_error")


def triage(df: DataFrame, cfg: RelayConfig, now: datetime) -> DataFrame:
    """Add ``triage`` (expired, malformed, dispatch), ``reason`` and ``_section``.

    Expiry wins over malformed options. ``now`` is the batch's one clock.
    """
    rows, is_expired = with_sections(df, cfg), expired(df, cfg, now)
    verdict = first_match((is_expired, "'expired'"), ("options_error IS NOT NULL", "'malformed'"), otherwise="'dispatch'")
    reason = first_match((is_expired, text(EXPIRED)), otherwise="options_error")
    return compute_once(rows, [*df.columns, "_section"], {"triage": verdict, "reason": reason})


def outbox_lag(batch: DataFrame, cfg: RelayConfig, now: datetime) -> DataFrame:
    """Age in seconds of the first row by id; 0 when empty or without a timestamp."""
    first = batch.selectExpr(f"min_by({event_time(batch, cfg)}, {column(cfg.id_col)}) AS ts")
    return first.selectExpr(f"greatest(0D, coalesce({age_micros('ts', now)} / 1e6D, 0D)) AS lag_s")
