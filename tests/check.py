"""Side-by-side comparison of a query and its DuckDB text."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    return round(value, 9) if isinstance(value, float) else value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, build, sql):
    """None when both sides agree, else a short account of the difference."""
    df = build(spark, sf_dir)
    left = multiset(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = multiset([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        extra, missing = left[1] - right[1], right[1] - left[1]
        return (f"rows {sum(left[1].values())} vs {sum(right[1].values())}; only spark ({sum(extra.values())}): {list(extra)[:2]}; "
                f"only sql ({sum(missing.values())}): {list(missing)[:2]}")
    return None if sum(left[1].values()) else "empty"
