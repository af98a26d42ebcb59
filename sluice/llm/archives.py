"""WARC archives compressed by Zstandard with a dictionary of their own.

An archive starts with a skippable frame that holds the dictionary; then each
record is one frame. Each task writes one archive: it trains the dictionary on
the first records it sees (a bounded sample), and a written table lists the
archives. The reader loads the dictionary, decodes frame by frame and checks
every header and length.

Of pages with equal payloads the largest page id is the response and the
others are revisit records that refer to it and carry no payload. Payloads
below ``min_revisit_bytes`` are all responses.

Null html is an empty payload, also for revisits. Rows repeated with one page
id are responses if that id is the largest of their payload, else revisits.
Null page ids are never the target of a revisit; where a payload has no other
id its rows are all responses. An empty table gives no archive and no row.
Null urls are written without a target; other columns are unused.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import file_system, records, scratch, slices, task_file, written
from sluice.llm.registry import query
from sluice.session import shuffle_width

#: Fixed values of the formats: frame magic numbers and header names.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

SAMPLE_BYTES = 1 << 20
SAMPLE_RECORD = 1 << 15
DICTIONARY_BYTES = 1 << 15
FILES = "path string, n_records long, bytes long"
READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record_id: str | None) -> int | None:
    number = (record_id or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, payload_digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """One record: WARC header, HTTP header and, for a response, the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Buffers the first records for the dictionary, then writes a frame per record."""

    def __init__(self, out: IO[bytes], level: int = 3) -> None:
        self.out, self.level, self.records = out, level, 0
        self.waiting: list[bytes] | None = []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        held, self.waiting, dictionary = self.waiting or [], None, None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_RECORD] for r in held])
        except zstandard.ZstdError:
            pass  # too little to learn from: the archive goes without one
        if dictionary:
            body = dictionary.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=True)
        for record in held:
            self.out.write(self.compressor.compress(record))

    def close(self) -> None:
        if self.waiting is not None:
            self._start()


def frames(source: IO[bytes], block: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, read in blocks; the dictionary may be compressed itself."""
    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE_MAGIC:
        length = struct.unpack("<II", data)[1]
        body = source.read(length)
        if len(body) != length:
            raise ValueError("the dictionary frame is cut short")
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, data = zstandard.ZstdCompressionDict(body), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or source.read(block)
        if not data:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(block)):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Fields of one record; raises ValueError where a header or length is wrong."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0].encode() != VERSION:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header line {line!r}")
        fields[name.strip()] = value.strip()
    if missing := [n for n in REQUIRED if n not in fields]:
        raise ValueError(f"missing {missing}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [h.split(b":")[1].strip() for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(stated) != 1 or not stated[0].isdigit():
        raise ValueError("no HTTP header")
    kind, sha1 = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(stated[0]) or digest(payload) != sha1):
        raise ValueError("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError("malformed revisit")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(stated[0]),
            "payload_digest": sha1, "record_type": kind, "refers_to": page_of(fields.get("WARC-Refers-To")),
            "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages as archives under ``folder``; the list of archives, written.

    Only digests and ids are grouped. The payload moves once, to meet the
    largest id of its digest; a large group of copies is split by adaptive
    execution, as its other side is one row.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.expr("X''")).alias("payload"))
    rows = rows.selectExpr("*", "sha1(payload) AS hash")
    target = rows.filter(f"octet_length(payload) >= {min_revisit_bytes}").groupBy("hash").agg(F.max("page_id").alias("target"))
    marked = rows.join(target, "hash", "left").selectExpr(
        "page_id", "url", "payload", "CASE WHEN page_id <=> target OR target IS NULL THEN NULL ELSE target END AS refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out, path = None, None, ""
        for batch in slices(batches, 256):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    store, root = file_system(folder)
                    store.create_dir(root, recursive=True)
                    path = task_file(root, "pages", ".warc.zst")
                    out = store.open_output_stream(path)
                    writer = ArchiveWriter(out)
                writer.add(build_record(page_id, url, payload, len(payload), digest(payload), refers_to, date))
        if writer:
            writer.close()
            size = out.tell()
            out.close()
            yield records({"path": ([path], pa.string()), "n_records": ([writer.records], pa.int64()), "bytes": ([size], pa.int64())})

    return written(marked.mapInArrow(archive, FILES), "archives")


def read(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the listed archives, whose number of records is checked."""
    # Few narrow rows that stand for much work: the number of tasks is given, so that they are not merged.
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = file_system(folder)[0]
        columns = [(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in READ.split(", ")]
        for batch in batches:
            for path, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, seen = [], 0, 0
                with store.open_input_stream(path) as source:
                    for frame in frames(source):
                        held.append(parse_record(frame) | ({} if payloads else {"payload": None}))
                        seen, size = seen + 1, size + (len(frame) if payloads else 0)
                        if len(held) >= 1000 or size > 1 << 24:
                            yield records({c: ([r[c] for r in held], t) for c, t in columns})
                            held, size = [], 0
                if seen != n_records:
                    raise ValueError(f"{path}: {seen} records, {n_records} were written")
                if held:
                    yield records({c: ([r[c] for r in held], t) for c, t in columns})

    return files.select("path", "n_records").repartition(shuffle_width(files.sparkSession), "path").mapInArrow(decode, READ)


#: Base 32 of a hex digest: every five hex digits are four characters.
_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hash, CAST(i // 4 AS INT) * 5 + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '')"""

_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hash FROM pages),
    t AS (SELECT hash, max(page_id) AS target FROM p GROUP BY hash)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = target THEN NULL ELSE target END AS refers_to FROM p JOIN t USING (hash)"""


@query("op2_warc", _SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
