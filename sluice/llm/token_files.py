"""Binary token files: one id array per file with Elias-Fano document boundaries.

Documents are dealt out in ranges of ascending id, each task writes one file,
and a written table lists the files. A file is

    magic | id array | boundary list | id list | sizes of the three parts

with ids as unsigned 16-bit integers where the vocabulary allows it, else
32-bit. Boundaries are ``documents + 1`` offsets into the id array, held as an
Elias-Fano list, as are the rising document ids; a lookup needs no table of
64-bit offsets.

Null or empty text: only the end id. Null document ids come first, ahead of
all others, and are read back as null. Repeated rows are kept, each with ids
of its own. An empty table gives no file and no row. Other columns are unused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import elias_fano
from sluice.llm.common import file_system, records, scratch, slices, task_file, written
from sluice.llm.registry import query
from sluice.llm.tokens import default_tokenizer, encoder
from sluice.session import shuffle_width

MAGIC = b"EFTOKEN1"
FOOT = "<QQQQB7x"
FILES = "file_no int, path string, documents long, tokens long, first_id long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, file_no int"


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0, id_bytes: int = 2) -> DataFrame:
    """Encode documents into files under ``folder``; the list of files, written.

    Whole texts move once, to their range of ids. A task streams ids to its
    file and keeps only one length and one id per document in memory.
    """
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    width = "<u2" if id_bytes == 2 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, ids, ends, nulls, path = TaskContext.get().partitionId(), None, [], [0], 0, ""
        coder = encoder(tokenizer)
        for batch in slices(batches, text_column=1):
            if out is None:
                store, root = file_system(folder)
                store.create_dir(root, recursive=True)
                path = task_file(root, f"tokens-{number:06d}", ".bin")
                out = store.open_output_stream(path)
                out.write(MAGIC)
            found, counts = coder.batch(batch.column(1).to_pylist())
            found = np.insert(found, np.cumsum(counts), end_id)
            if id_bytes == 2 and int(found.max()) > 0xFFFF:
                raise ValueError("the vocabulary needs id_bytes=4")
            out.write(found.astype(width).tobytes())
            ends.extend((ends[-1] + np.cumsum(counts + 1)).tolist())
            keys = batch.column(0).drop_null().to_pylist()
            nulls += batch.num_rows - len(keys)
            ids.extend(keys)
        if out is None:
            return
        bounds, keys = elias_fano.encode(np.array(ends)), elias_fano.encode(np.array(ids, dtype=np.int64))
        out.write(bounds + keys + struct.pack(FOOT, ends[-1] * id_bytes, len(bounds), len(keys), nulls, id_bytes))
        size = out.tell()
        out.close()
        yield records({"file_no": ([number], pa.int32()), "path": ([path], pa.string()), "documents": ([len(ends) - 1], pa.int64()),
                       "tokens": ([ends[-1]], pa.int64()), "first_id": (ids[:1] or [None], pa.int64()), "bytes": ([size], pa.int64())})

    return written(ranged.mapInArrow(encode, FILES), "token-files")


class TokenFile:
    """One file, opened for lookups: boundaries and ids are Elias-Fano lists, token ids are read by range."""

    def __init__(self, folder: str, path: str) -> None:
        self.file = file_system(folder)[0].open_input_file(path)
        size = self.file.size()
        self.tokens_bytes, bounds, keys, self.nulls, self.id_bytes = struct.unpack(FOOT, self.file.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
        if self.file.read_at(len(MAGIC), 0) != MAGIC or len(MAGIC) + self.tokens_bytes + bounds + keys + struct.calcsize(FOOT) != size:
            raise ValueError(f"not a whole token file: {path}")
        lists = self.file.read_at(bounds + keys, len(MAGIC) + self.tokens_bytes)
        self.bounds, self.keys = elias_fano.EliasFano(lists[:bounds]), elias_fano.EliasFano(lists[bounds:])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls)

    def key_range(self, first: int, stop: int) -> list[int | None]:
        held = max(first, self.nulls)
        return [None] * (min(stop, self.nulls) - first) + (self.keys.select_range(held - self.nulls, stop - self.nulls).tolist() if stop > held else [])

    def ids(self, i: int) -> np.ndarray:
        """Token ids of the ``i``-th document, read at the offsets that select gives."""
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def span(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.id_bytes, len(MAGIC) + start * self.id_bytes)
        return np.frombuffer(raw, dtype="<u2" if self.id_bytes == 2 else "<u4").astype("<u4")


def read(files: DataFrame, folder: str, block: int = 1 << 21, block_documents: int = 1 << 12) -> DataFrame:
    """A row per document from the files: its place, length and checksum of ids.

    ``start`` counts the ids of all documents before it: those of earlier
    files, known from the list, and the boundary that select gives. A file is
    read in blocks of documents and, in them, of about ``block`` ids, so memory
    does not grow with a file.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                opened = TokenFile(folder, path)
                for first in range(0, len(opened), block_documents):
                    stop = min(first + block_documents, len(opened))
                    bounds, keys, at = opened.bounds.select_range(first, stop + 1), opened.key_range(first, stop), 0
                    while at < stop - first:
                        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1)
                        ids, zero = opened.span(int(bounds[at]), int(bounds[to])), int(bounds[at])
                        crcs = [zlib.crc32(ids[a - zero:b - zero]) for a, b in zip(bounds[at:to].tolist(), bounds[at + 1:to + 1].tolist())]
                        yield records({"doc_id": (keys[at:to], pa.int64()), "start": (base + bounds[at:to], pa.int64()),
                                       "n_tokens": (np.diff(bounds[at:to + 1]), pa.int64()), "ids_crc32": (crcs, pa.int64()),
                                       "file_no": ([number] * (to - at), pa.int32())})
                        at = to

    # One narrow row per file.
    placed = files.selectExpr("file_no", "path", "sum(tokens) OVER (ORDER BY file_no) - tokens AS base")
    # Few narrow rows that stand for much work: the number of tasks is given, so that they are not merged.
    return placed.repartition(shuffle_width(files.sparkSession), "file_no").mapInArrow(decode, READ)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_tokenizer()), folder)
