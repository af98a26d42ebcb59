"""Queries of this subpackage: a Spark build and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def load() -> tuple[dict[str, Build], dict[str, str]]:
    from sluice.llm import (archives, ball_tree, contamination, divergence, licenses, ngram_join, packing, prefix_counts, quality, shards, token_files,  # noqa: F401
                            toxicity, url_rules)
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
    return QUERIES, SQL
