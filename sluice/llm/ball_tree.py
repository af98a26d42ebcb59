"""Ranked lexical search by exact inner products over sparse ball trees.

A score is an inner product of an item's term weights and a document's term
values. Documents are held as sparse vectors over the terms of the items. A
task takes its documents in blocks, builds a ball tree over each (a node holds
the centroid and the radius of its documents, halved along the line between two
far ones), and walks it best first for each item: no document below a node
scores more than

    item . centroid + |item| * radius

(with the item's terms that occur below the node, as the others add nothing)
and once that falls below the item's fiftieth score so far, the rest of the
block is passed over. Vectors are scaled by the square root of the weights on
both sides, which leaves the product as it is and evens out the radius. Bounds
are doubles, made larger by far more than their rounding error; leaves are
scored in 64-bit integers, so the result is exact whatever is pruned. The best
scores are carried from block to block of a task, and each task hands over
fifty rows an item.

Items are taken in parts of a bounded size, one pass over the documents' term
rows each; none are left out. Null or empty text on either side: no terms, no
rows. Each row of the items is an item and each row of the documents a
document, so repeated rows rank as often as they stand there. Null document
ids rank last among equal scores; null item ids are kept. Empty tables give no
rows. Other columns are unused.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.common import bounded_parts, records, slices, words, written
from sluice.llm.registry import query
from sluice.llm.segments import spans

TOP = 50
BLOCK = 2048
LEAF = 32
#: A part's items: bytes of their texts, and how many.
MAX_BYTES, MAX_ITEMS = 8 << 20, 20_000
LANES = 64
TERMS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_no int, item_id long, times long, doc_id long, score long"


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """Items as sparse vectors, and for each term the items that hold it."""

    def __init__(self, ids: list[int | None], times: list[int], terms: list[list[int]], weights: np.ndarray) -> None:
        self.ids, self.times, self.weights = ids, times, weights
        self.terms = [np.array([t for t in own if weights[t] > 0], dtype=np.int64) for own in terms]
        flat = np.concatenate(self.terms) if self.terms else np.zeros(0, dtype=np.int64)
        item = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        order = np.argsort(flat, kind="stable")
        self.by_term, self.count = item[order], np.bincount(flat, minlength=len(weights))
        self.start = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.ids)

    def products(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Inner products of all items and one sparse vector of scaled values."""
        counts = self.count[terms]
        return np.bincount(self.by_term[spans(self.start[terms], counts)], np.repeat(values, counts), len(self))


class BallTree:
    """A ball tree over the rows of a sparse matrix, given by row offsets, columns and integer values."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, leaf: int = LEAF) -> None:
        self.columns, local = np.unique(terms, return_inverse=True)
        scaled = values * np.sqrt(weights[terms].astype(float))
        lengths = np.diff(offsets)
        squares = np.add.reduceat(np.append(scaled * scaled, 0.0), offsets[:-1]) * (lengths > 0)
        self.order = order = np.arange(len(lengths))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.radius, self.centroids = [], []

        def dots(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
            at = spans(offsets[rows], lengths[rows])
            ends = np.cumsum(lengths[rows])
            sums = np.concatenate([[0.0], np.cumsum(scaled[at] * vector[local[at]])])
            return sums[ends] - sums[ends - lengths[rows]]

        def dense(row: int) -> np.ndarray:
            vector = np.zeros(len(self.columns))
            vector[local[offsets[row]:offsets[row + 1]]] = scaled[offsets[row]:offsets[row + 1]]
            return vector

        def build(lo: int, hi: int) -> int:
            rows, number = order[lo:hi].copy(), len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            at = spans(offsets[rows], lengths[rows])
            centroid = np.bincount(local[at], scaled[at], len(self.columns)) / len(rows)
            own = float(centroid @ centroid)
            apart = squares[rows] - 2 * dots(rows, centroid) + own
            # Differences of large squares: their rounding error is far below a 1e-9th of the squares and of the partial sums.
            self.radius.append(math.sqrt(max(0.0, float(apart.max())) + 1e-9 * (float(squares[rows].sum()) + own)))
            held = np.flatnonzero(centroid)
            self.centroids.append((self.columns[held], centroid[held]))
            if hi - lo > leaf:
                far = dense(rows[int(apart.argmax())])
                other = dense(rows[int((squares[rows] - 2 * dots(rows, far)).argmax())])
                line = dots(rows, far - other)
                middle = len(rows) // 2
                order[lo:hi] = rows[np.argpartition(line, middle)]
                if line.max() > line.min():
                    self.nodes[number] = (lo, hi, build(lo, lo + middle), build(lo + middle, hi))
            return number

        build(0, len(lengths))
        # Rows in the order of the leaves, so a leaf's entries stand in a row.
        at = spans(offsets[order], lengths[order])
        self.terms, self.values = terms[at], values[at]
        self.offsets = np.concatenate([[0], np.cumsum(lengths[order])])

    def bounds(self, items: Items) -> np.ndarray:
        """For each node and item a number that no product below the node exceeds."""
        root = np.sqrt(items.weights.astype(float))
        found = np.empty((len(self.nodes), len(items)))
        for i, ((terms, values), radius) in enumerate(zip(self.centroids, self.radius)):
            norm = np.sqrt(items.products(terms, items.weights[terms].astype(float)))
            found[i] = items.products(terms, values * root[terms]) + norm * radius
        return found * (1 + 1e-9) + 1

    def search(self, item: int, weights: np.ndarray, bounds: np.ndarray, keys: list[tuple], best: list[tuple], top: int) -> int:
        """Put the item's products into the heap ``best`` of (score, key); the number of leaves that were scored.

        ``weights`` has the item's weights at its terms and 0 elsewhere.
        """
        open_nodes, scored = [(-bounds[0, item], 0)], 0
        while open_nodes:
            limit, node = heapq.heappop(open_nodes)
            if len(best) == top and -limit < best[0][0]:
                break
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(open_nodes, (max(limit, -bounds[left, item]), left))
                heapq.heappush(open_nodes, (max(limit, -bounds[right, item]), right))
                continue
            scored += 1
            a, b = self.offsets[lo], self.offsets[hi]
            sums = np.concatenate([[0], np.cumsum(weights[self.terms[a:b]] * self.values[a:b])])
            scores = np.diff(sums[self.offsets[lo:hi + 1] - a])
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == top else 1)).tolist():
                entry = (int(scores[i]), keys[self.order[lo + i]])
                if len(best) < top:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
        return scored


def term_rows(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """A row per document: how many terms it has in all, and which of the vocabulary how often."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(vocabulary)}
        for batch in slices(batches, text_column=1):
            totals, ends, terms, tfs = [], [0], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
            for text in batch.column(1).to_pylist():
                found = words(text)
                own, times = np.unique(np.array([i for i in map(index.get, found) if i is not None], dtype=np.int32), return_counts=True)
                totals.append(len(found))
                ends.append(ends[-1] + len(own))
                terms.append(own)
                tfs.append(times)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(v).astype(np.int32))) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(totals, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(count, TERMS)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def document_values(n: np.ndarray, terms_of: np.ndarray, tfs: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Values of the entries of documents with ``n`` terms each; ``terms_of`` names an entry's document."""
    m = np.array([100 - 50 + (50 * k * documents) // total for k in n.tolist()], dtype=np.int64)[terms_of]
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def best_of_tasks(rows: DataFrame, items: Items, documents: int, total: int, top: int, block: int, leaf: int) -> DataFrame:
    """The best rows an item of each task, from trees over its blocks of documents."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(len(items))]
        weights = np.zeros(len(items.weights), dtype=np.int64)
        for table in _blocks(batches, block):
            ids, n = table.column("doc_id").to_pylist(), table.column("n").to_numpy()
            lists = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            offsets = lists[0].offsets.to_numpy().astype(np.int64)
            terms, tfs = (x.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int64) for x in lists)
            offsets -= offsets[0]
            values = document_values(n, np.repeat(np.arange(len(n)), np.diff(offsets)), tfs, documents, total)
            tree = BallTree(offsets, terms, values, items.weights, leaf)
            bounds = tree.bounds(items)
            keys = [(d is not None, -(d or 0)) for d in ids]
            for i, own in enumerate(items.terms):
                if len(own) and not (len(best[i]) == top and bounds[0, i] < best[i][0][0]):
                    weights[own] = items.weights[own]
                    tree.search(i, weights, bounds, keys, best[i], top)
                    weights[own] = 0
        rows = [(i, items.ids[i], items.times[i], -k if has else None, s) for i, held in enumerate(best) for s, (has, k) in held]
        if rows:
            numbers, *rest = map(list, zip(*rows))
            yield records({"item_no": (numbers, pa.int32())} | {c: (v, pa.int64()) for c, v in zip(("item_id", "times", "doc_id", "score"), rest)})

    return rows.filter("size(terms) > 0").mapInArrow(search, FOUND)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", block: int = BLOCK, leaf: int = LEAF, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each item's best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark, found = docs.sparkSession, []
    for part in bounded_parts(items, item_col, item_text_col, max_bytes, MAX_ITEMS):
        texts = [list(dict.fromkeys(words(t))) for _, t, _ in part]
        vocabulary = sorted({w for t in texts for w in t})
        if not vocabulary:
            continue
        index = {w: i for i, w in enumerate(vocabulary)}
        # The rows are stored: statistics need all of them before the search can begin.
        rows = written(term_rows(docs, vocabulary, id_col, text_col), "term-rows")
        documents, total = rows.agg(F.expr("count_if(n > 0)"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        holding = np.zeros(len(vocabulary), dtype=np.int64)
        for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # no more than the vocabulary of the part
            holding[term] = n
        weights = np.array([weight(documents, int(n)) for n in holding], dtype=np.int64)
        vectors = Items([i for i, _, _ in part], [k for _, _, k in part], [[index[w] for w in t] for t in texts], weights)
        found.append(best_of_tasks(rows, vectors, documents, total, top, block, leaf).withColumn("part", F.lit(len(found))))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # First among the rows of some tasks, so that no task merges those of all.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("lane", F.expr(f"pmod(spark_partition_id(), {LANES})"))
    for keys in (["part", "item_no", "lane"], ["part", "item_no"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return rows.select("item_id", "rank", "doc_id", "score", F.explode(F.expr("sequence(1L, times)")).alias("copy")).drop("copy")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
    b AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS ws FROM benchmark),
    s AS (SELECT count(*) AS all_docs, CAST(sum(len(ws)) AS BIGINT) AS all_terms FROM d WHERE len(ws) > 0),
    i AS (SELECT q, item_id, unnest(ws) AS w FROM b),
    t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM i) GROUP BY r, w),
    f AS (SELECT w, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY w, all_docs),
    v AS (SELECT r, doc_id, w, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ws) * all_docs) // all_terms)) AS value
      FROM t JOIN d USING (r), s),
    p AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * value) AS BIGINT) AS score FROM i JOIN f USING (w) JOIN v USING (w) GROUP BY q, item_id, r, doc_id),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM p WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM n WHERE rank <= 50"""


@query("op11_ball_tree_search", _SQL)
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
