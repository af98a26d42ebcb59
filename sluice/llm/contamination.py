"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Benchmark texts are normalised to words, and every window of ``WINDOW`` words
in a row (a shorter item is one window) is a pattern. Words of the benchmark
are symbols, so a pattern is a short string of symbols; all other words are
one symbol that occurs in no pattern. A document is scanned once, and the end
positions that the automaton reports are word numbers, which map back to byte
offsets of the original text.

The automaton holds the benchmark, whose size is measured first. A large one
is read in parts of about ``max_bytes``, as many as it takes; each part is one
pass over the documents, and between passes documents and the hits so far are
written, so neither the driver nor a worker holds more than one part. Inside a
part an automaton takes stretches of at most ``max_words`` words, which
overlap by a window; a part with more words has several. Documents are not
shuffled.

Null or empty text: no words, no hits. Items without words have no windows.
Null item ids: their windows count as hits, but they are listed nowhere.
Repeated items count once. Null document ids and repeated rows are kept. An
empty table gives no rows. Other columns are unused; one named ``_hits`` is
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import bounded_batches, bounded_parts, giving_back, words, written
from sluice.llm.registry import query

WINDOW = 10
#: Bytes of a part. Words of an automaton: fewer than there are symbols.
MAX_BYTES = 8 << 20
MAX_WORDS = 1_000_000
MAX_ITEMS = 100_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FIRST_SYMBOL = 0x100
#: Symbols are code points, but for the surrogates, which strings cannot hold.
SURROGATES = 0xD800, 0x800
NO_SYMBOL = "\x01"
HITS = "n_words long, spans array<array<int>>, items array<long>, offsets array<array<int>>"


def _symbol(i: int) -> str:
    point = FIRST_SYMBOL + i
    return chr(point if point < SURROGATES[0] else point + SURROGATES[1])


class WindowAutomaton:
    """All windows of some stretches of items as one automaton over word symbols."""

    def __init__(self, stretches: list[tuple[int | None, list[bytes]]], window: int) -> None:
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        patterns: dict[str, set] = {}
        for item_id, found in stretches:
            line = "".join(self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in found)
            for at in range(max(1, len(line) - window + 1) if line else 0):
                patterns.setdefault(line[at:at + window], set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(ids)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, found: list[bytes]) -> tuple[list[list[int]], set]:
        """Word spans of windows, end excluded, and the items with windows there."""
        if self.empty or not found:
            return [], set()
        line = "".join([self.symbols.get(w, NO_SYMBOL) for w in found])
        spans, items = [], set()
        for end, (length, ids) in self.automaton.iter(line):
            spans.append([end + 1 - length, end + 1])
            items.update(ids)
        return merge_spans(spans), items


def automata(items: list[tuple[int | None, bytes, int]], window: int, max_words: int) -> list[WindowAutomaton]:
    """Automata that together hold all windows of the items, each over at most ``max_words`` words."""
    groups: list[list[tuple[int | None, list[bytes]]]] = [[]]
    size, step = 0, max(window, max_words)
    for item_id, text, _ in items:
        found = words(text)
        for at in range(0, max(1, len(found) - window + 1), step - window + 1):
            stretch = found[at:at + step]
            if size + len(stretch) > max_words and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append((item_id, stretch))
            size += len(stretch)
    return [WindowAutomaton(g, window) for g in groups]


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    """Spans as few disjoint ones, sorted; spans that touch are joined."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return merged


def byte_offsets(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Byte offsets in the original text of word spans."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [[places[a][0], places[b - 1][1]] for a, b in spans]


def _scanner(items: list[tuple[int | None, bytes, int]], window: int, max_words: int):
    """Hits of a text in the part, merged with those of earlier parts where there are any."""
    built: list[WindowAutomaton] = []

    def scanned(text: bytes, spans: list, ids: set) -> tuple:
        found = words(text)
        for automaton in built:
            more, held = automaton.scan(found)
            spans, ids = spans + more, ids | held
        spans = merge_spans(spans)
        return len(found), spans, sorted(i for i in ids if i is not None), byte_offsets(text, spans)

    @giving_back
    def hits(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        built.extend(() if built else automata(items, window, max_words))
        for texts, spans, ids in batches:
            rows = [scanned(t, [list(map(int, x)) for x in (s if s is not None else ())], set(map(int, i if i is not None else ())))
                    for t, s, i in zip(texts, spans, ids)]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "offsets"])

    return F.pandas_udf(hits, HITS)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              window: int = WINDOW, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All rows and columns, with the struct ``_hits``: words, hit spans, items and byte offsets."""
    bounded_batches(docs.sparkSession)
    text, rows = F.col(text_col).cast("binary"), docs
    spans, ids = F.lit(None).cast("array<array<int>>"), F.lit(None).cast("array<long>")
    for n, part in enumerate(bounded_parts(benchmark, item_col, item_text_col, max_bytes, MAX_ITEMS)):
        rows = (written(rows, "hits") if n else rows).withColumn("_hits", _scanner(part, window, max_words)(text, spans, ids))
        spans, ids = F.col("_hits.spans"), F.col("_hits.items")
    return rows


_SQL = r"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS w
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM bw WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    occ AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
    hit AS (SELECT r, i, occ.n, item_id FROM occ JOIN win USING (w, n)),
    words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
    its AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM hit GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)"""


@query("op8_decontamination", _SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_hit = "aggregate(_hits.spans, 0L, (a, s) -> a + s[1] - s[0])"
    listed = "array_join(array_sort(transform(_hits.items, i -> CAST(i AS STRING))), ',')"
    return with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).selectExpr(
        "doc_id", "_hits.n_words", f"{n_hit} AS n_hit", "CAST(size(_hits.items) AS LONG) AS n_items",
        f"sha2({listed}, 256) AS items_sha256", f"{n_hit} > 0 AS contaminated")
