"""Ordered per-group computations that survive a group of any size.

A plain window puts a whole group into one task. Here the ordering column is
cut into ranges at splitters drawn from the data. The window runs inside
(group, range), one summary row per (group, range) carries the state across
ranges, and a join brings it back. No task then sees more than one range of a
group, and the results are exactly those of the plain window.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, functions as F

from sluice.session import slice_count

SLICE = "_slice"


def splitters(df: DataFrame, order: str, slices: int) -> DataFrame:
    """One row: a sorted array of at most ``slices`` ordering values, and every n-th of them.

    Each hash class contributes one value, so the sample follows the data's
    own distribution, works for any type and never changes between
    evaluations. It only places the cuts; every row is still processed.
    """
    value = df.selectExpr(f"{order} AS _v", f"pmod(xxhash64({order}), {slices}) AS _class")
    sample = value.groupBy("_class").agg(F.expr("min_by(_v, xxhash64(17, _v)) AS _v"))
    every = f"filter(_cuts, (v, i) -> i % {isqrt(slices)} = 0)"
    return sample.agg(F.expr("array_sort(collect_set(_v)) AS _cuts")).selectExpr(f"struct(_cuts, {every} AS _coarse) AS _places")


def with_slices(df: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """Add the number of the range that each row's ordering value falls in.

    ``order`` is a SQL expression. The lookup is two short scans, first of
    every n-th cut, a list of its own, and then of the cuts that follow it, so
    a row meets about twice the square root of the cuts.
    """
    slices = slices or slice_count(df.sparkSession)
    width = isqrt(slices)
    placed = df.withColumn("_places", splitters(df, order, slices).scalar()).selectExpr("*", f"{order} AS _at")
    coarse = f"greatest(size(filter(_places._coarse, v -> v <= _at)) - 1, 0) * {width} AS _start"
    fine = f"_start + size(filter(slice(_places._cuts, _start + 1, {width}), v -> v <= _at)) AS {SLICE}"
    return placed.selectExpr("*", coarse).selectExpr(*[f"`{c}`" for c in df.columns], fine)


def _join_back(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(summaries, [*keys, SLICE], "left")


def _across(keys: list[str]) -> str:
    """Window over the summary rows of a group: at most one per range."""
    return f"PARTITION BY {', '.join(keys) or '0'} ORDER BY {SLICE}"


def _within(keys: list[str], order: str) -> str:
    return f"PARTITION BY {', '.join([*keys, SLICE])} ORDER BY {order}"


EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UP_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str, slices: int | None = None) -> DataFrame:
    """Position of each row in its group, from 1. Group keys must not be NULL."""
    sliced = with_slices(df, order, slices)
    before = (sliced.groupBy(*keys, SLICE).agg(F.expr("count(*) AS _n"))
              .selectExpr(*keys, SLICE, f"sum(_n) OVER ({_across(keys)} {EARLIER}) AS _before")
              .filter("_before > 0"))
    numbered = sliced.selectExpr("*", f"CAST(row_number() OVER ({_within(keys, order)}) AS BIGINT) AS _local")
    joined = _join_back(numbered, before, keys)
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], f"_local + coalesce(_before, 0) AS {out}")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str],
                 slices: int | None = None) -> DataFrame:
    """Inclusive running totals: ``sums`` maps output name to source column."""
    sliced = with_slices(df, order, slices)
    totals = sliced.groupBy(*keys, SLICE).agg(*[F.expr(f"sum({c}) AS _t_{o}") for o, c in sums.items()])
    before = totals.selectExpr(*keys, SLICE, *[f"sum(_t_{o}) OVER ({_across(keys)} {EARLIER}) AS _b_{o}" for o in sums])
    rows = sliced.selectExpr("*", *[f"sum({c}) OVER ({_within(keys, order)} {UP_TO_HERE}) AS _l_{o}" for o, c in sums.items()])
    joined = _join_back(rows, before, keys)
    return joined.selectExpr(*[f"`{c}`" for c in df.columns],
                             *[f"coalesce(_l_{o}, 0) + coalesce(_b_{o}, 0) AS {o}" for o in sums])


def previous_values(df: DataFrame, keys: list[str], order: str, lags: dict[str, str],
                    slices: int | None = None) -> DataFrame:
    """Value of the preceding row of the group, NULL for its first row."""
    sliced = with_slices(df, order, slices)
    carried = "struct(" + ", ".join(f"{c} AS {o}" for o, c in lags.items()) + ")"
    last = sliced.groupBy(*keys, SLICE).agg(F.expr(f"max_by({carried}, {order}) AS _last"))
    before = last.selectExpr(*keys, SLICE, f"lag(_last) OVER ({_across(keys)}) AS _carry").filter("_carry IS NOT NULL")
    rows = sliced.selectExpr("*", f"lag({carried}) OVER ({_within(keys, order)}) AS _prev")
    joined = _join_back(rows, before, keys)
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], *[f"coalesce(_prev, _carry).{o} AS {o}" for o in lags])


def oldest(df: DataFrame, order: str, limit: int, slices: int | None = None) -> DataFrame:
    """The ``limit`` smallest rows by ``order``, merged in three steps.

    Tasks first meet in ``slices`` groups that each keep ``limit`` rows, those
    in about the square root of as many, so the last merge reads sqrt(slices) *
    limit rows however many tasks the scan has.
    """
    slices = slices or slice_count(df.sparkSession)
    kept = df.withColumn(SLICE, F.spark_partition_id() % slices)
    for groups in (slices, isqrt(slices)):
        kept = kept.withColumn(SLICE, F.col(SLICE) % groups).selectExpr(
            "*", f"row_number() OVER (PARTITION BY {SLICE} ORDER BY {order}) AS _rn").filter(f"_rn <= {limit}").drop("_rn")
    return kept.drop(SLICE).orderBy(order).limit(limit)
