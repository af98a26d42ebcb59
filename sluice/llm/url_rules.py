"""Allow and block rules on hosts and paths, joined as intervals of sorted keys.

A canonical key is the host with its labels reversed, each followed by a dot,
then the path. A rule is the interval of all keys that begin with its own key.
A url has a key for its host and for each parent host, so a rule with a path
also meets subdomains. Keys and rules of one host are sorted together and
swept once; a stack keeps the rules whose interval is open, and its top is the
longest that fits that key. The longest rule over a url's keys wins: by
characters of host and path, then by characters of host, then block.

Only distinct urls are swept, and only keys whose host has a rule. A host with
many keys is swept in several parts, each with a copy of that host's rules.

Null urls and urls without ``://``: empty host and path, no rule, the default
verdict. Rules repeated with both verdicts: block. Null ids and repeated pages
are kept as they are. An empty table gives no rows; without rules every page
gets the default. Other columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import records
from sluice.llm.registry import query

#: Rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PART_KEYS = 100_000
FOUND = "url string, host_rule string, path_rule string, verdict string"

_REST = "regexp_extract(url, '(?s)://(.*)', 1)"
_HOST = f"translate(regexp_extract({_REST}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"


def reversed_host(host: str) -> str:
    """SQL expression of a host's labels in reverse order, each with a dot."""
    return f"concat(array_join(reverse(split({host}, '[.]')), '.'), '.')"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest open rule of each key; rows come sorted by part, key, and rules first."""
    part, stack = None, []
    for batch in batches:
        hits = []
        for host, number, key, url, host_rule, path_rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, number) != part:
                part, stack = (host, number), []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if url is None:
                stack.append((key, host_rule, path_rule, verdict))
            elif stack:
                hits.append((url, *stack[-1][1:]))
        if hits:
            yield records({c: (list(v), pa.string()) for c, v in zip(("url", "host_rule", "path_rule", "verdict"), zip(*hits))})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          part_keys: int = PART_KEYS) -> DataFrame:
    """Host, path, winning rule and verdict of each page; ``rules`` has host, path and verdict."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    spans = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).selectExpr(
        f"{reversed_host('host')} AS top", "host AS host_rule", "path AS path_rule", "verdict")
    urls = rows.filter("url IS NOT NULL").select("url").distinct().selectExpr("url", f"{_HOST} AS host", f"{_PATH} AS path")
    labels = urls.filter("host <> ''").selectExpr("url", "path", "split(host, '[.]') AS labels")
    keys = labels.selectExpr("url", "path", "explode(sequence(1, size(labels))) AS n", "labels").selectExpr(
        "url", "path", "concat(array_join(reverse(slice(labels, n, size(labels))), '.'), '.') AS top")
    # Keys per host that has rules; a host with many is cut into parts.
    parts = keys.groupBy("top").agg(F.count(F.lit(1)).alias("n")).join(spans.select("top").distinct(), "top").selectExpr(
        "top", f"CAST(n div {part_keys} + 1 AS INT) AS parts")
    asked = keys.join(parts, "top").selectExpr("top", "CAST(pmod(xxhash64(url), parts) AS INT) AS part", "concat(top, path) AS key", "url",
                                               "CAST(NULL AS STRING) AS host_rule", "CAST(NULL AS STRING) AS path_rule", "CAST(NULL AS STRING) AS verdict")
    offered = spans.join(parts, "top").selectExpr("top", "explode(sequence(0, parts - 1)) AS part", "concat(top, path_rule) AS key",
                                                  "CAST(NULL AS STRING) AS url", "host_rule", "path_rule", "verdict")
    dealt = asked.unionByName(offered).repartition("top", "part").sortWithinPartitions("top", "part", "key", F.col("url").asc_nulls_first())
    best = dealt.mapInArrow(sweep, FOUND).groupBy("url").agg(F.expr(
        "max_by(struct(host_rule, path_rule, verdict), struct(char_length(host_rule) + char_length(path_rule), char_length(host_rule), verdict)) AS best"))
    named = rows.filter("url IS NOT NULL").join(best, "url", "left").selectExpr(
        "page_id", f"{_HOST} AS host", f"{_PATH} AS path", "concat(best.host_rule, best.path_rule) AS rule",
        f"coalesce(best.verdict, '{default}') AS verdict")
    nameless = rows.filter("url IS NULL").selectExpr("page_id", "'' AS host", "'' AS path", "CAST(NULL AS STRING) AS rule", f"'{default}' AS verdict")
    return named.unionByName(nameless)


_SQL = r"""WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    a AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT b.n, max_by(struct_pack(rule := h || p, v := v), length(h || p)) AS best FROM b JOIN r
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY b.n)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM b LEFT JOIN c USING (n)"""


@query("op7_url_rules", _SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
