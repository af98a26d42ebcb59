"""How far the sources of a language are apart in their words, by count-level bitmaps.

A language keeps the terms that enough of its documents hold. A source's share
of a term depends only on how often the term occurs in it, so a source is a
set of levels: for each count, the bit set of the terms with that count. For
two sources the number of terms with count ``c`` in one and ``d`` in the other
is the size of the intersection of two bit sets, found by AND and popcount,
and it is multiplied by the difference of the two shares. Terms that a source
lacks are the complement of its levels and are not stored.

Terms of a language are hashed into chunks and numbered inside a chunk from
the most frequent down, so words of 64 bits have many levels at the front and
few behind. A level is stored as its words that are not zero. A task compares
the sources of two blocks over one chunk, so no task holds a language, and
languages with very many sources or terms only make more tasks. Counts are
added up per task before they are shuffled. The result has a row for each two
sources of a language: that is what is asked for.

Null text, language and source are read as ''. A text without terms counts for
its group only. Repeated rows and null or repeated ids are documents of their
own. A language without kept terms has pairs with value 0 and no terms. An
empty table gives no rows. Other columns are unused. All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.common import records, slices, written
from sluice.llm.registry import query

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
CHUNK_TERMS = 4096
BLOCK_SOURCES = 32
FLUSH = 300_000
#: Bytes outside letters and non-ASCII become blanks, A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, one string, other string, value long"


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters; none for null."""
    return text.translate(LETTERS).split() if text else []


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Occurrences and documents of each term in each group, added up in each task first, written."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                yield records({"lang": ([lang] * len(n), pa.string()), "source": ([source] * len(n), pa.string()),
                               "term": ([t.decode() for t in n], pa.string()), "n": (list(n.values()), pa.int64()), "docs": ([docs[t] for t in n], pa.int64())})
            seen.clear()

        for batch in slices(batches, text_column=2):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # Bytes that are no UTF-8 become replacement characters.
                found = terms((text or b"").decode("utf-8", "replace").encode())
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in seen.values()) > FLUSH:
                yield from flushed()
        yield from flushed()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    rows = docs.select(*named, F.col(text_col).cast("binary")).mapInArrow(count, COUNTS)
    return written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), by long division so that nothing overflows."""
    rest, found = counts + PRIOR, np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def differences(words: np.ndarray, owners: np.ndarray, levels: np.ndarray, bits: np.ndarray, totals: list[int], size: int, first: np.ndarray,
                second: np.ndarray) -> np.ndarray:
    """Summed differences of shares over one chunk, for each source of ``first`` and each of ``second``.

    ``words``, ``owners``, ``levels`` and ``bits`` are the stored words of the
    levels; ``owners`` and both lists are numbers of sources, which have
    ``totals``. The chunk has ``size`` terms.
    """
    found = np.zeros((len(first), len(second)), dtype=np.int64)
    if not size:
        return found
    share = np.empty(len(owners), dtype=np.int64)
    for source, total in enumerate(totals):
        own = owners == source
        share[own] = shares(levels[own], total)
    zero = np.array([shares(np.zeros(1, dtype=np.int64), t)[0] for t in totals])
    order = np.lexsort((owners, words))
    words, owners, share, bits = words[order], owners[order], share[order], bits[order]
    sources = np.arange(len(totals))
    for word in range(-(-size // 64)):
        a, b = np.searchsorted(words, [word, word + 1])
        full = np.uint64((1 << min(64, size - 64 * word)) - 1)
        rest = np.full(len(totals), full)
        np.bitwise_xor.at(rest, owners[a:b], bits[a:b])  # levels of a source are disjoint: what is left has count 0
        owner = np.concatenate([owners[a:b], sources])
        by_owner = np.argsort(owner, kind="stable")
        owner = owner[by_owner]
        value, held = np.concatenate([share[a:b], zero])[by_owner], np.concatenate([bits[a:b], rest])[by_owner]
        left, right = np.isin(owner, first), np.isin(owner, second)
        joint = np.bitwise_count(held[left][:, None] & held[right][None, :]).astype(np.int64)
        joint *= np.abs(value[left][:, None] - value[right][None, :])
        rows = np.add.reduceat(joint, np.searchsorted(owner[left], first), axis=0)
        found += np.add.reduceat(rows, np.searchsorted(owner[right], second), axis=1)
    return found


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    lang, one_block, other_block = key[0].as_py(), key[2].as_py(), key[3].as_py()
    heads = table.filter(pa.compute.equal(table["n"], 0)).sort_by("source")
    names, blocks = heads["source"].to_pylist(), heads["block"].to_numpy()
    numbers = {s: i for i, s in enumerate(names)}
    rows = table.filter(pa.compute.greater(table["n"], 0))
    owners = np.array([numbers[s] for s in rows["source"].to_pylist()], dtype=np.int64)
    first, second = np.flatnonzero(blocks == one_block), np.flatnonzero(blocks == other_block)
    out: tuple[list, list, list] = [], [], []
    if len(first) and len(second):
        found = differences(rows["word"].to_numpy(), owners, rows["n"].to_numpy(), rows["bits"].to_numpy().view(np.uint64),
                            heads["total"].to_pylist(), heads["size"][0].as_py(), first, second)
        for i, a in enumerate(first):
            for j, b in enumerate(second):
                if one_block != other_block or a < b:
                    for column, value in zip(out, (names[a], names[b], int(found[i, j]))):
                        column.append(value)
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "one": pa.array(out[0], pa.string()),
                     "other": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS,
          top: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """Per group and part ``pair`` or ``term``: items, values and ranks."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(f"docs >= {min_documents}")
    kept = written(kept.select("lang", "term", "lang_n"), "kept-terms")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = written(langs.selectExpr("lang", "coalesce(v, 0L) AS v", "coalesce(lang_total, 0L) AS lang_total",
                                     f"greatest(1L, ceil(coalesce(v, 0L) / {chunk_terms})) AS chunks", f"ceil(sources / {block_sources}) AS blocks"), "langs")
    in_chunk = Window.partitionBy("lang", "chunk").orderBy(F.desc("lang_n"), "term")
    placed = kept.join(langs, "lang").withColumn("chunk", F.expr("pmod(xxhash64(term), chunks)")).withColumn("place", F.row_number().over(in_chunk) - 1)
    cells = written(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").selectExpr(
        "lang", "source", f"coalesce(n, 0L) + {PRIOR} * v AS total", f"lang_total + {PRIOR} * v AS lang_total", "chunks", "blocks", "pmod(xxhash64(source), blocks) AS block")
    groups = written(groups, "groups")
    pairs = pair_values(cells, groups)
    both = pairs.selectExpr("lang", "one AS source", "other AS item", "value").unionByName(pairs.selectExpr("lang", "other AS source", "one AS item", "value"))
    share = "1L + (CAST({n} + {prior} AS DECIMAL(20, 0)) * {scale}L) div {total}"
    ratio = cells.join(groups.select("lang", "source", "total", F.col("lang_total").alias("lang_sum")), ["lang", "source"]).selectExpr(
        "lang", "source", "term AS item", share.format(n="n", prior=PRIOR, scale=SCALE, total="total") + " AS p",
        share.format(n="lang_n", prior=PRIOR, scale=SCALE, total="lang_sum") + " AS q").filter("p > q").selectExpr("lang", "source", "item", "p - q AS value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order)) for part, rows in (("pair", both), ("term", ratio))]
    return ranked[0].unionByName(ranked[1].filter(f"rank <= {top}")).select("lang", "source", "part", "item", "value", "rank")


def bitmaps(cells: DataFrame) -> DataFrame:
    """The stored levels: per group, chunk and count the words of its bit set that are not zero."""
    return written(cells.groupBy("lang", "source", "chunk", "n", F.expr("CAST(place div 64 AS INT)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits")), "bitmaps")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``one``, ``other`` and the summed difference, once for each two sources of a language."""
    sizes = cells.groupBy("lang", "chunk").agg(F.countDistinct("place").alias("size"))
    chunks = groups.select("lang", "chunks").distinct().selectExpr("lang", "explode(sequence(0L, chunks - 1)) AS chunk")
    sizes = chunks.join(sizes, ["lang", "chunk"], "left").selectExpr("lang", "chunk", "coalesce(size, 0L) AS size")
    # A row with count 0 stands for a source in a chunk, whether or not it has terms there.
    heads = groups.join(sizes, "lang").selectExpr("lang", "chunk", "source", "block", "blocks", "total", "size", "0L AS n", "0 AS word", "0L AS bits")
    levels = bitmaps(cells).join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"]).selectExpr(
        "lang", "chunk", "source", "block", "blocks", "0L AS total", "0L AS size", "n", "word", "bits")
    met = "explode(transform(sequence(0L, blocks - 1), b -> struct(least(b, block) AS one_block, greatest(b, block) AS other_block)))"
    rows = heads.unionByName(levels).selectExpr("*", f"{met} AS met").selectExpr("*", "met.*").drop("met", "blocks")
    partial = rows.groupBy("lang", "chunk", "one_block", "other_block").applyInArrow(_compare, SUMS)
    return written(partial.groupBy("lang", "one", "other").agg(F.sum("value").alias("value")), "pair-values")


_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
    c AS (SELECT g.lang, g.source, k.term, lang_n, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER o + 5 * count(*) OVER o) AS p,
      1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER o + 5 * count(*) OVER o) AS q FROM c WINDOW o AS (PARTITION BY lang, source)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
    rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g AS a
        JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op12_source_divergence", _SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
