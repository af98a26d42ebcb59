"""Registry of runnable queries: a Spark build and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        REGISTRY[name] = Query(build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    """All registered queries; importing a module registers what it defines."""
    from sluice.plans import collection, delivery, messaging, monitoring, options, settlement, streams  # noqa: F401

    return REGISTRY
