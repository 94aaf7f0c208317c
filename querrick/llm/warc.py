"""WARC archives: a writer and a sequential reader, one gzip member a record."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, checkpoint, fresh_dir

by_value(__name__)

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: A writer starts a new archive beyond this many compressed bytes.
ROLL_BYTES = 64 << 20
#: Payloads that occur more than once: up to so many are sent to every executor (some 10 MB); more are joined by digest.
SENT_DIGESTS = 100_000
#: Bytes that the reader takes from a file at once.
CHUNK = 1 << 16
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    """A record as read: named headers (lower-case), HTTP headers and the payload."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def filesystem(uri: str):  # noqa: ANN201
    """The pyarrow filesystem and path of a URI; a path without a scheme and ``file:`` are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response, or a revisit (HTTP headers only) of the record of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream one after the other, each decompressed in steps of CHUNK; one member is held at a time."""
    rest, gz, parts = b"", None, []
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            break
        if gz is None:
            gz, parts = zlib.decompressobj(31), []
        parts.append(gz.decompress(data))
        if gz.eof:
            rest, gz = gz.unused_data, None
            yield b"".join(parts)
    if gz is not None:
        raise ValueError("the archive ends within a gzip member")


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order.

    A record's block is framed by its Content-Length; block digests, and payload
    digests where the payload is there, are verified. A wrong frame or digest
    raises ValueError.
    """
    for data in members(stream):
        head, found, body = data.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"WARC/"):
            raise ValueError("a gzip member does not hold a WARC record")
        headers = _headers(head)
        length = int(headers.get("content-length", "-1"))
        block = body[:length]
        if length < 0 or len(block) != length or body[length:] != b"\r\n\r\n":
            raise ValueError(f"wrong content length in {headers.get('warc-record-id')}")
        if "warc-block-digest" in headers and _digest(block) != headers["warc-block-digest"]:
            raise ValueError(f"wrong block digest in {headers.get('warc-record-id')}")
        top, _, payload = block.partition(b"\r\n\r\n")
        if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers and _digest(payload) != headers["warc-payload-digest"]:
            raise ValueError(f"wrong payload digest in {headers.get('warc-record-id')}")
        yield Record(headers, _headers(top), payload)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """A WARC record a row of ``pages`` in archives below ``folder`` (shared by all executors); ``(path, records, bytes)`` an archive.

    Of rows with equal payloads of at least REVISIT_BYTES, those of the largest
    page_id are responses and the others revisit it; smaller payloads are all
    responses. Only digests and ids are shuffled to find them; where there are
    few, they are sent to the executors and pages stay where they are read, else
    pages are joined by digest. A null html is an
    empty payload; a null page_id is the least; a null url leaves out the target;
    repeated rows are records of their own (all of the largest page_id are
    responses); an empty table gives no archives; other columns are ignored.

    Rows are written in order of their page_id (then of digest, url and kind)
    within a partition, whatever order they come in. An archive is written under
    a name of its own attempt and then renamed to one that depends on the
    partition alone, so a repeated task replaces each of its archives by the same
    bytes, also where it rolls over to a further one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    again = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = checkpoint(again)
    few = again.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    rows = rows.join(F.broadcast(again) if few else again, "digest", "left").sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "html", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, records, size, name = None, 0, 0, ""

        def close() -> None:
            out.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            done.append((f"{folder.rstrip('/')}/{name.rpartition('/')[2]}", records, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, records, size = f"{base.rstrip('/')}/pages-{task.partitionId():06d}-{len(done):05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None)
                data = encode_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py(), date)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        path, count, length = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(count, pa.int64()), pa.array(length, pa.int64())], names=["path", "records", "bytes"])

    return checkpoint(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, one archive a task at a time.

    ``page_id``, ``url``, ``record_type``, ``refers_to`` (page_id), ``payload_bytes``
    and ``payload_digest`` (hex SHA-1), both of the full payload, and ``payload``
    (null for revisits, or if it isn't asked for).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[len(URN) + 1 : -1]) if urn and urn != f"<{URN}>" else None
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for headers, http, payload in read_records(stream):
                        revisit = headers["warc-type"] == "revisit"
                        length = int(http["content-length"]) if revisit else len(payload)
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], number(headers.get("warc-refers-to")), length, digest, None if revisit or not with_payload else payload))
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    paths = archives.select("path")
    count = max(1, paths.count())
    return paths.repartition(count, "path").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, spark: SparkSession | None = None, folder: str | None = None) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    spark = spark or pages.sparkSession
    return read_archives(write_archives(pages, folder or fresh_dir(spark, "warc")), with_payload=False)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM m
"""
