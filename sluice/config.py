"""Relay configuration: column roles, enabled backends and batch settings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame

PUBSUB = "pubsub"
SQS = "sqs"
# Every provider this build can prepare messages for, enabled or not.
KNOWN_TARGETS = (PUBSUB, SQS)


@dataclass(frozen=True)
class Backend:
    """One enabled provider: its target name, default and allowed destinations."""

    target: str
    default_destination: str = ""
    owned_destinations: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelayConfig:
    """Column roles (an empty name switches an optional role off) and limits."""

    backends: tuple[Backend, ...]
    id_col: str = "id"
    timestamp_col: str = "timestamp"
    payload_col: str = "payload"
    target_col: str = "target"
    destination_col: str = "destination"
    options_col: str = "options"
    batch_target: int = 10_000
    max_age: timedelta | None = None
    backlog_limit: int = 100_000
    source_schema: str = "public"
    source_table: str = "events"
    dlq_table: str = ""
    fifo_group_prefix: str = "relay-"

    def __post_init__(self) -> None:
        if self.batch_target < 1:
            raise ValueError("batch_target must be positive")
        if not self.id_col or not self.payload_col:
            raise ValueError("the id and payload roles need a column")
        roles = [name for name in self.roles() if name]
        if len(set(roles)) != len(roles):
            raise ValueError("two column roles share one column")
        targets = [b.target for b in self.backends]
        if len(set(targets)) != len(targets):
            raise ValueError("a backend is listed twice")
        unknown = [t for t in targets if t not in KNOWN_TARGETS]
        if unknown:
            raise ValueError(f"no sender for target: {', '.join(unknown)}")
        if self.dlq_table and self.dlq_table == self.source_table:
            raise ValueError("the dead-letter table must differ from the event table")
        if self.max_age and not self.timestamp_col:
            raise ValueError("max_age needs the timestamp role")

    def roles(self) -> tuple[str, ...]:
        return (self.id_col, self.timestamp_col, self.payload_col,
                self.target_col, self.destination_col, self.options_col)

    def required_columns(self) -> list[str]:
        """Columns that must exist for this configuration to route and send."""
        needed = [self.id_col, self.payload_col]
        if self.max_age:
            needed.append(self.timestamp_col)
        if len(self.backends) > 1:
            needed.append(self.target_col)
        if any(not b.default_destination for b in self.backends):
            needed.append(self.destination_col)
        return [name for name in needed if name]

    def check_columns(self, df: DataFrame) -> None:
        """Fail before any job runs if a configured column is absent.

        Routing refers to the target and destination columns whenever their
        role is configured, so these two must exist even when they are not in
        the required set.
        """
        wanted = dict.fromkeys(self.required_columns())
        wanted.update(dict.fromkeys(c for c in (self.target_col, self.destination_col) if c))
        missing = [name for name in wanted if name not in df.columns]
        if missing:
            raise ValueError(f"event table is missing required columns: {', '.join(missing)}")
