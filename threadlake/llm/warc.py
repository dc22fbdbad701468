"""WARC archives: written as one gzip member per record, read back record by record.

*Writing.* Pages with equal payloads (by SHA-1 and length) are stored once: the one with the
smallest page id becomes a ``response`` record, the others become ``revisit`` records that refer to
it and carry the HTTP header only. The archives are ordinary ``.warc.gz`` content in any file
system Spark writes to: each record is compressed into a gzip member of its own, and members are
laid one after another by Spark's text writer. That writer ends every line with a separator of at
least one byte; the separator is set to NUL, and each member is handed over without its last byte,
which is the high byte of the record's length and so NUL for records under 16 MiB. (A larger record
is followed by an empty member, which ends in NUL too and which readers skip.) An archive ends
before it passes ``ARCHIVE_BYTES``, unless one record alone does, so that a task can hold the archive
it reads; a record is at most one page. Files go through Spark's commit protocol, so a lost executor
leaves no half archive.

*Reading.* Each archive is read from front to back with incremental decompression: the header ends
at the first empty line, ``Content-Length`` frames the block, and block digests are compared with
the bytes. A damaged archive gives an error that names the record's place.

A null payload is empty. Empty payloads are payloads like any other (``least_bytes`` can be raised
so that small ones are always stored). Repeated rows of a response's page are responses alike. A
null id comes after all others. An empty table gives no records. Further columns of the input are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records bear one date: archives of equal input are equal.
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20  # of compressed records; the reader's file source takes files up to 2 GiB
_CHUNK = 1 << 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}')}>"


def build_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    revisit: bool, payload_bytes: int,
) -> bytes:
    """One uncompressed record; a revisit's block is the HTTP header alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else "%{:02X}".format(ord(c)) for c in url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(record: bytes) -> bytes:
    """What stands before a NUL so that both together are whole gzip members."""
    member = _member(record)
    if member[-1:] != b"\0":
        member += _member(b"")
    return member[:-1]


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return _fields(head), payload


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _members(data: memoryview) -> Iterator[bytes]:
    """The content of each gzip member, decompressed in small steps; padding is skipped."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        unpacker, parts = zlib.decompressobj(31), []
        start = at
        while not unpacker.eof:
            chunk = data[at : at + _CHUNK]
            if not chunk:
                raise ValueError(f"archive ends inside the member at byte {start}")
            parts.append(unpacker.decompress(chunk))
            at += len(chunk)
        at -= len(unpacker.unused_data)
        yield b"".join(parts)


def read_archive(data: bytes | memoryview) -> Iterator[Record]:
    """Records of one archive in order; raises ValueError where framing or a digest is wrong."""
    for number, content in enumerate(_members(memoryview(data))):
        if not content:
            continue
        head, blank, rest = content.partition(b"\r\n\r\n")
        headers = _fields(head)
        if not blank or not head.startswith(b"WARC/"):
            raise ValueError(f"record {number} has no WARC header")
        length = int(headers.get("content-length", "-1"))
        if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"record {number} is not {length} bytes long")
        block = rest[:length]
        said = headers.get("warc-block-digest", "")
        if said and said != f"sha1:{digest_of(block)}":
            raise ValueError(f"record {number} does not have the digest {said}")
        yield Record(headers, block)


def plan_records(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Per page: page_id, url, payload, revisit and refers_to.

    Equal payloads are found on (SHA-1, length); the payload is in no aggregation or window.
    """
    rows = pages.select(
        F.col(id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha1("payload").alias("_sha1"), F.length("payload").alias("_bytes"))
    keys = ["_sha1", "_bytes"]
    firsts = (
        rows.where(F.col("_bytes") >= least_bytes)
        .groupBy(*keys)
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
    )
    found = rows.join(firsts, keys, "left")
    return found.select(
        "page_id",
        "url",
        "payload",
        (F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))).alias("revisit"),
        F.col("_first").alias("refers_to"),
    )


def _lines(archive_bytes: int):
    """Compressed records, each with the number of its archive: as many as fit, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            out, archives = [], []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                page_id, url, payload, revisit, refers_to = row
                digest = digest_of(payload)
                record = build_record(page_id, url, payload, digest, refers_to, revisit, len(payload))
                line = _line(record)
                if held and held + len(line) + 1 > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(line) + 1
                out.append(line)
                archives.append(archive)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.binary()), pa.array(archives, pa.int64())], names=["line", "archive"]
            )

    return run


def write_archives(planned: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of ``plan_records`` as archives into a new folder: ``archive=<n>/<part>``."""
    lines = planned.mapInArrow(_lines(archive_bytes), "line binary, archive bigint")
    (
        lines.select(F.col("line").cast("string"), "archive")
        .write.option("lineSep", "\0")
        .partitionBy("archive")
        .text(path)
    )


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_READ_DDL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload binary"
)


def _row(record: Record, keep_payload: bool) -> tuple:
    http, payload = record.http()
    kind, said = record.headers["warc-type"], record.headers["warc-payload-digest"]
    size = int(http["content-length"])
    if kind == "response" and (len(payload) != size or said != f"sha1:{digest_of(payload)}"):
        raise ValueError(f"the payload of {record.headers['warc-record-id']} is not {said}")
    number = lambda name: int(record.headers[name]) if name in record.headers else None
    return (
        number("x-page-id"),
        record.headers.get("warc-target-uri"),
        kind,
        number("x-refers-to-page-id"),
        said.removeprefix("sha1:"),
        size,
        payload if keep_payload and kind == "response" else None,
    )


def _reader(keep_payload: bool, batch_bytes: int = 8 << 20):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)]
        return pa.RecordBatch.from_arrays(columns, schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                for record in read_archive(memoryview(content.as_buffer())):
                    rows.append(_row(record, keep_payload))
                    held += 200 + (len(record.block) if keep_payload else 0)
                    if held > batch_bytes:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(keep_payload), _READ_DDL)
