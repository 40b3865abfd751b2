"""WARC archives as a table of payload chunks.

Payloads travel as rows ``(record, chunk_no, chunk)``: oversized ones are cut in the JVM, streamed to the archive one
chunk at a time, and come back as chunks that carry the SHA-1 of all bytes so far. Neither writer nor reader holds a
record as one value. Equal payloads are stored once; later copies are revisit records without a payload.

Each task writes archives under a new name in a folder all executors share and hands the names on; only archives
named by finished tasks are read, so a lost or repeated task leaves files that nothing refers to. The folder is any
URI that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import shared_folder, text_or_empty, written

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
_FLUSH_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "path string, records bigint, payload_bytes bigint"
_CHUNKS = (
    "path string, record_id string, page_id string, url string, record_type string, refers_to string, "
    "chunk_no bigint, chunk binary, bytes_so_far bigint, digest_so_far string, is_last boolean, intact boolean, "
    "payload_bytes bigint, payload_digest string"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("record_id", pa.string()),
        ("page_id", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.binary()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("is_last", pa.bool_()),
        ("intact", pa.bool_()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _payload(pages: DataFrame, html: str) -> Column:
    return text_or_empty(F.col(html)).cast("binary")


def decide_records(pages: DataFrame, html: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row per page: ``page_id, url, digest`` (hex SHA-1), ``payload_bytes``, ``is_response``, ``refers_to``.

    Of equal payloads of at least ``min_bytes`` the record with the largest ``page_id`` is the response.
    """
    payload = _payload(pages, html)
    narrow = pages.select(
        "page_id", "url", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes")
    )
    first = narrow.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("response"))
    small = F.col("payload_bytes") < min_bytes
    is_response = small | F.col("page_id").eqNullSafe(F.col("response"))
    return narrow.join(first, ["digest", "payload_bytes"]).select(
        *narrow.columns, is_response.alias("is_response"), F.when(~is_response, F.col("response")).alias("refers_to")
    )


def record_chunks(
    pages: DataFrame, decided: DataFrame, html: str = "html", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Rows to write: the chunks of every response in order and one row without a chunk for every revisit."""
    payload = _payload(pages, html)
    wanted = decided.where("is_response").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    stored = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest")).join(
        wanted, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi"
    )
    size = F.octet_length("payload")
    count = F.greatest(F.ceil(size / chunk_bytes), F.lit(1)).cast("int")
    chunks = stored.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "digest",
        size.cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"),
        "payload",
        F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_no", "_i"),
        (count - 1).alias("last_chunk"),
    ).withColumn("chunk", F.substring("payload", F.col("_i") * chunk_bytes + 1, F.lit(chunk_bytes)))
    revisits = decided.where(~F.col("is_response")).select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "digest",
        "payload_bytes",
        F.col("refers_to").cast("string").alias("refers_to"),
        F.lit(0).alias("chunk_no"),
        F.lit(0).alias("last_chunk"),
        F.lit(None).cast("binary").alias("chunk"),
    )
    return chunks.drop("payload", "_i").unionByName(revisits)


class _Archive:
    """One archive being written, a gzip member per record."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, local = fs.FileSystem.from_uri(self.path)
        system.create_dir(local.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(local, compression=None)
        self.records, self.payload_bytes, self.member, self.digest = 0, 0, None, None

    def start(self, row: dict) -> None:
        digest = _base32(bytes.fromhex(row["digest"]))
        http = _HTTP.format(row["payload_bytes"]).encode()
        revisit = row["refers_to"] is not None
        target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", row["url"] or "") or f"urn:page:{row['page_id']}"
        head = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", _record_id(row["page_id"], digest)),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(http) + (0 if revisit else row["payload_bytes"]))),
        ]
        if row["page_id"] is not None:
            head.append(("X-Page-Id", row["page_id"]))
        if revisit:
            head += [
                ("WARC-Profile", _PROFILE),
                ("WARC-Refers-To", _record_id(row["refers_to"], digest)),
                ("X-Refers-To-Page-Id", row["refers_to"]),
            ]
        self.member = gzip.GzipFile(fileobj=self.out, mode="wb", compresslevel=3, mtime=0, filename="")
        lines = "".join(f"{name}: {value}\r\n" for name, value in head)
        self.member.write(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + http)
        self.digest = hashlib.sha1()
        self.records += 1

    def chunk(self, data: bytes) -> None:
        self.member.write(data)
        self.digest.update(data)
        self.payload_bytes += len(data)

    def end(self, row: dict) -> None:
        if row["refers_to"] is None and self.digest.hexdigest() != row["digest"]:
            raise ValueError(f"page {row['page_id']}: chunks do not make up the payload")
        self.member.write(b"\r\n\r\n")
        self.member.close()
        self.member = None

    def close(self) -> dict:
        self.out.close()
        return {"path": [self.path], "records": [self.records], "payload_bytes": [self.payload_bytes]}


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of :func:`record_chunks`; the manifest has one row per archive: ``path, records, payload_bytes``.

    Chunks of a record follow each other in their partition. A task starts a new archive after ``archive_bytes``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["chunk_no"] == 0:
                    if archive and archive.payload_bytes >= archive_bytes:
                        yield pa.RecordBatch.from_pydict(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.start(row)
                if row["chunk"]:
                    archive.chunk(row["chunk"])
                if row["chunk_no"] == row["last_chunk"]:
                    archive.end(row)
        if archive:
            yield pa.RecordBatch.from_pydict(archive.close())

    return written(chunks.mapInArrow(write, _MANIFEST))


def _lines(stream: io.BufferedReader) -> Iterator[str]:
    """Header lines up to the empty one."""
    while (line := stream.readline().rstrip(b"\r\n")):
        yield line.decode("utf-8", "replace")


def _records(path: str, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of an archive; a record without payload has one row with an empty chunk."""
    system, local = fs.FileSystem.from_uri(path)
    with system.open_input_stream(local, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
        stream = io.BufferedReader(unpacked, 1 << 16)
        while version := stream.readline():
            if not version.strip():
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record where one should start")
            head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in _lines(stream))}
            left = int(head["content-length"])
            payload_bytes = 0
            while left:
                line = stream.readline()
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    payload_bytes = int(line.split(b":")[1])
                if line == b"\r\n":
                    break
            base = {
                "path": path,
                "record_id": head["warc-record-id"],
                "page_id": head.get("x-page-id"),
                "url": head.get("warc-target-uri"),
                "record_type": head["warc-type"],
                "refers_to": head.get("x-refers-to-page-id"),
                "payload_digest": head["warc-payload-digest"].rpartition(":")[2],
                "payload_bytes": payload_bytes,
            }
            digest, size, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(left, chunk_bytes))
                if left and not data:
                    raise ValueError(f"{path}: the archive ends inside a record")
                left -= len(data)
                size += len(data)
                digest.update(data)
                so_far, last = _base32(digest.digest()), left == 0
                yield base | {
                    "chunk_no": number,
                    "chunk": data,
                    "bytes_so_far": size,
                    "digest_so_far": so_far,
                    "is_last": last,
                    "intact": last and (head["warc-type"] == "revisit" or (so_far, size) == (base["payload_digest"], payload_bytes)),
                }
                number += 1
                if last:
                    break


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all archives of a manifest, one archive per task.

    ``digest_so_far`` and ``bytes_so_far`` cover the record's payload up to and with the row's chunk; ``is_last`` marks
    its last chunk, and ``intact`` that a response's bytes have the recorded length and digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in _records(path, chunk_bytes):
                    rows.append(row)
                    held += len(row["chunk"]) + 500
                    if held >= _FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _CHUNKS_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CHUNKS_ARROW)

    paths = manifest.select("path")
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(read, _CHUNKS)


def archive_pages(
    pages: DataFrame,
    html: str = "html",
    min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write a record per page, and the manifest of the archives.

    ``pages`` has ``page_id``, ``url`` and the payload text, written in UTF-8; other columns are ignored. NULL is an
    empty payload. Empty payloads are equal payloads too. Repeated rows with the largest id are all responses. A NULL
    ``page_id`` is smaller than any other. A NULL ``url`` becomes ``urn:page:``. An empty table writes no archive.
    """
    narrow = pages.select("page_id", "url", html)
    decided = written(decide_records(narrow, html, min_bytes))
    chunks = record_chunks(narrow, decided, html, chunk_bytes)
    return write_archives(chunks, folder or f"{shared_folder(pages.sparkSession)}/warc")
