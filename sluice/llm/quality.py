"""Quality rules with line frequencies counted across documents.

Lines are normalised (lower case, white space runs as one blank, trimmed) and
hashed. For each host the distinct texts that hold a line are counted; a line
in more than ``max_share`` of a host's distinct texts, and in at least
``min_documents``, is above the limit and is removed. A document that fails a
base rule, or of whose words less than ``min_left`` stay, is rejected.

Copies of one text count once, so a text with many copies does not condemn its
own lines. Counts are per host and line with partial sums, so a hot host or
line is spread; lines above the limit are at most ``lines per text /
max_share`` per host.

Null or empty text: no words, fails the base rule. Null host: a host of its
own. Null ids and repeated rows are kept. An empty table gives no rows. Other
columns are kept as they are, whatever their names; ``_left`` and ``_quality``
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.llm.common import blank_words, bounded_batches, giving_back, written
from sluice.llm.registry import query

MAX_SHARE = 0.05
MIN_DOCUMENTS = 10
MIN_LEFT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, left_words long"

#: Same form of a line in all places that compare lines.
_LINE = "trim(regexp_replace(lower({line}), '[ \\\\t\\\\x0B\\\\f\\\\r]+', ' '))"


def repeat_words(found: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that stand in the text more than once."""
    n = len(found)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int64, count=n)
    key = ids[:n - width + 1]
    for k in range(1, width):
        key = np.unique(key * len(known) + ids[k:n - width + 1 + k], return_inverse=True)[1]
    twice = (np.bincount(key) > 1)[key]
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_stats(text: bytes | None, left: bytes | None) -> tuple[int, ...]:
    """Counts of one text; ``left`` is what line removal leaves of it, null where nothing was removed."""
    text = text or b""
    found = blank_words(text)
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return (len(found), len(text.decode("utf-8", "replace")) - sum(text.count(b) for b in BLANKS), sum(text.count(b) for b in SYMBOLS),
            len(lines) - len(set(lines)), repeat_words(found), len(found) if left is None else len(left.split()))


@giving_back
def _stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in STATS.split(", ")]
    for texts, lefts in batches:
        yield pd.DataFrame([text_stats(t, b) for t, b in zip(texts, lefts)], columns=names, dtype="int64")


def frequent_lines(docs: DataFrame, text_col: str, host: Column, max_share: float, min_documents: int) -> DataFrame:
    """Per host the hashes of lines above the limit, as one short array."""
    texts = docs.select(host.alias("_host"), F.col(text_col).cast("string").alias("_text")).filter("_text <> ''")
    texts = texts.selectExpr("_host", "_text", "xxhash64(_text) AS _doc")
    lines = texts.selectExpr("_host", "_doc", "explode(array_distinct(split(_text, '\\n'))) AS _l").selectExpr(
        "_host", "_doc", f"{_LINE.format(line='_l')} AS _l").filter("_l <> ''").selectExpr("_host", "xxhash64(_l) AS _line", "_doc")
    spread = lines.distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {min_documents}")
    totals = texts.select("_host", "_doc").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    above = spread.join(totals, "_host").filter(f"_n > {max_share} * _docs")
    return above.groupBy("_host").agg(F.sort_array(F.collect_set("_line")).alias("_lines"))


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE,
           min_documents: int = MIN_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """All rows and columns, with ``_left`` (text without frequent lines, null where whole) and the struct ``_quality``."""
    bounded_batches(docs.sparkSession)
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))
    # Stored, so that its size is known before the texts meet it: a small one is sent to them.
    frequent = written(frequent_lines(docs, text_col, host, max_share, min_documents), "frequent-lines")
    taken = {c.lower() for c in docs.columns} | {"_left", "_quality"}
    of_host, lines, stats = (next(n for n in (f"{stem}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for stem in ("_host", "_lines", "_stats"))
    frequent = frequent.selectExpr(f"_host AS {of_host}", f"_lines AS {lines}")
    rows = docs.drop("_left", "_quality").withColumn(of_host, host).join(frequent, of_host, "left").drop(of_host)
    kept_lines = f"filter(split(CAST(`{text_col}` AS STRING), '\\n'), l -> NOT array_contains({lines}, xxhash64({_LINE.format(line='l')})))"
    left = f"CASE WHEN {lines} IS NOT NULL THEN array_join({kept_lines}, '\\n') END"
    rows = rows.withColumn("_left", F.expr(left)).drop(lines).withColumn(
        stats, F.pandas_udf(_stats, STATS)(F.col(text_col).cast("binary"), F.col("_left").cast("binary")))
    failed = f"{stats}.n_words < {MIN_WORDS} OR 100 * {stats}.n_repeat_words > {MAX_REPEAT_PERCENT} * {stats}.n_words"
    depleted = f"{stats}.left_words < {min_left} * {stats}.n_words"
    return rows.withColumn("_quality", F.expr(f"struct({stats}.*, {failed} AS base_failed, NOT ({failed}) AND NOT ({depleted}) AS kept)")).drop(stats)


_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text FROM documents),
    l AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
    m AS (SELECT r, host, text, line, trim(regexp_replace(lower(line), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM l),
    f AS (SELECT host, norm FROM m WHERE norm <> '' GROUP BY host, norm HAVING count(DISTINCT text) >= 10
      AND count(DISTINCT text) > 0.05 * (SELECT count(DISTINCT text) FROM d WHERE d.host = m.host AND text <> '')),
    k AS (SELECT r, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) FILTER (WHERE f.norm IS NULL) AS left_words,
      count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines
      FROM m LEFT JOIN f USING (host, norm) GROUP BY r),
    w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
    u AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
    g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
    h AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
    c AS (SELECT r, i, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM h),
    p AS (SELECT r, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY r),
    s AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      coalesce(left_words, 0) AS left_words FROM d JOIN w USING (r) JOIN k USING (r) LEFT JOIN p USING (r))
    SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (left_words < 0.5 * n_words) AS kept FROM s"""


@query("op6_quality_rules", _SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs).selectExpr("doc_id", "_quality.n_words", "_quality.word_chars", "_quality.n_symbols", "_quality.n_dup_lines",
                                   "_quality.n_repeat_words", "_quality.base_failed", "_quality.kept")
