"""Packing of documents into fixed sequences by first-fit decreasing.

A document's ids are cut at multiples of the sequence length; full pieces are
sequences of their own, and only the last piece has to be packed. Documents
are put into random groups by a hash of id and seed, and each group is packed
on its own by first-fit decreasing: a tournament tree over bin capacities
gives the leftmost bin with room in a logarithmic number of steps. Groups are
many, all alike, and their number follows the number of documents, so neither
a hot source nor a growing table makes a group large.

Null or empty text: one piece with the end id only. Rows repeated with one id
are packed as separate documents; the group also depends on a row's place in
its task, so any number of equal rows is spread. Lengths and checksums are a
written table, so a lost task finds the same places again. Null ids are packed like others. An empty table gives no rows.
Other columns are unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import bounded_batches, giving_back, records, slices, written
from sluice.llm.registry import query
from sluice.llm.tokens import default_tokenizer, encoder

LENGTH = 2048
GROUP_DOCUMENTS = 4096
PIECES = "doc_id long, doc_tokens long, crcs array<long>, row_key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Winner tree over bins: each node holds the largest room below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item into the leftmost bin with room and return the bin."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_no


def first_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items taken from the largest down, ties as given."""
    tree, used = CapacityTree(len(sizes), length), {}
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
        offsets[i] = used.get(bins[i], 0)
        used[bins[i]] = offsets[i] + sizes[i]
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, length: int) -> DataFrame:
    """Per document its number of ids, the checksum of each piece and its place in the task."""
    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), 0
        for batch in slices(batches, text_column=1):
            found, counts = coder.batch(batch.column(1).to_pylist())
            raw, totals = memoryview(np.insert(found, np.cumsum(counts), end_id).astype("<u4")).cast("B"), (counts + 1).tolist()
            ends = (4 * np.cumsum(counts + 1)).tolist()
            crcs = [[zlib.crc32(raw[at:min(at + 4 * length, end)]) for at in range(end - 4 * n, end, 4 * length)] for n, end in zip(totals, ends)]
            yield records({"doc_id": (batch.column(0).to_pylist(), pa.int64()), "doc_tokens": (totals, pa.int64()),
                           "crcs": (crcs, pa.list_(pa.int64())), "row_key": (range(row, row + len(totals)), pa.int64())})
            row += len(totals)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS, seed: int = 11) -> DataFrame:
    """A row per piece: document, place in it, and sequence and place there.

    Only ids, lengths and checksums are shuffled, never texts or token ids.
    """
    bounded_batches(docs.sparkSession)
    pieces = written(cut(docs, tokenizer, id_col, text_col, end_id, length), "pieces")
    groups = max(1, -(-pieces.count() // group_documents))
    grouped = pieces.withColumn("group_no", F.expr(f"pmod(xxhash64(doc_id, doc_tokens, row_key, {seed}), {groups})"))

    def place(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["crcs"]))
        rest = [r["doc_tokens"] % length for r in rows]
        partial = [i for i, n in enumerate(rest) if n]
        bins, offsets = first_fit_decreasing([rest[i] for i in partial], length)
        where = {i: (b, o) for i, b, o in zip(partial, bins, offsets)}
        first, out = rows[0]["group_no"] << 32, {c.split()[0]: [] for c in PACKED.split(", ")}
        full = max(bins, default=-1) + 1
        for i, r in enumerate(rows):
            for k, crc in enumerate(r["crcs"]):
                whole = (k + 1) * length <= r["doc_tokens"]
                bin_no, offset = (full, 0) if whole else where[i]
                full += whole
                values = (r["doc_id"], k * length, length if whole else rest[i], crc, r["doc_tokens"], first + bin_no, offset)
                for column, value in zip(out.values(), values):
                    column.append(value)
        return pa.table({c: pa.array(v, type=pa.int64()) for c, v in out.items()})

    return grouped.groupBy("group_no").applyInArrow(place, PACKED)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
