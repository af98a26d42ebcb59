"""Text, table and file helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.session import shared_dir

#: Bytes that separate words become blanks, A-Z become a-z; digits, a-z and all of non-ASCII stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
U64 = 0xFFFFFFFFFFFFFFFF
#: Most bytes that Spark hands to a Python worker at once, and the setting for it.
BATCH_BYTES, BATCH_CONF = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Runs between ASCII white space, as written; none for null."""
    return text.split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, text_column: int | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number of rows, and of about ``size`` bytes of one column."""
    for batch in batches:
        ends = np.zeros(batch.num_rows)
        if text_column is not None and batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64) // size
        at = 0
        while at < batch.num_rows:
            stop = min(at + rows, batch.num_rows)
            if text_column is not None:
                stop = min(stop, max(at + 1, int(np.searchsorted(ends, ends[at], "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Memory that is free in this worker goes back to the system.

    Spark hands a worker on from stage to stage, and what the texts of one took
    would stay with it on top of what the next one needs.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, giving free memory back before its first and after its last one."""
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to workers by ``BATCH_BYTES`` at most, unless it names a limit of its own.

    Spark's default is 64 MB, and the executor and the worker hold a batch,
    the texts of it and what grows around them at the same time.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows, written once to the shared folder and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_parts(items: DataFrame, id_col: str, text_col: str, max_bytes: int, max_items: int) -> Iterator[list[tuple[int | None, bytes, int]]]:
    """All distinct rows of a small table, with how often each stands there, in lists of a bounded size, one at a time.

    The size is measured first and no row is left out.
    """
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.groupBy("item", "text").agg(F.count(F.lit(1)).alias("times"))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-size // max_bytes), -(-count // max_items))
    for part in range(parts):
        of_part = rows if parts == 1 else rows.filter(f"pmod(xxhash64(item, text), {parts}) = {part}")
        yield [(r["item"], bytes(r["text"] or b""), r["times"]) for r in of_part.collect()]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or as a URI."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def task_file(folder: str, stem: str, suffix: str) -> str:
    """A file name that no other attempt of the task uses.

    The table that lists files is committed by Spark and names those of the
    attempts that succeeded; files of lost attempts are never read.
    """
    return f"{folder}/{stem}-{uuid4().hex}{suffix}"


def records(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
