"""WARC archives written and read as tables of chunks.

A payload is never handled as one piece outside the row it comes from: before writing, Spark
cuts it into rows of record id and chunk number; the writer streams these into gzip members; the
reader inflates members block by block and gives rows of the same kind, each with the digest of
everything up to its end.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_path, rows_to_batches, shuffle_partitions, stored

CHUNK_BYTES = 1 << 18
SPAN_BYTES = 1 << 24
READ_BYTES = 1 << 17
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, start long, stop long, records long"
MANIFEST_ARROW = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("records", pa.int64())]
)
CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, target_uri string, "
    "payload_bytes long, payload_digest string, chunk_no long, chunk binary, so_far long, "
    "digest_so_far string, last boolean"
)
CHUNKS_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.binary()),
        ("so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("last", pa.bool_()),
    ]
)


def chunk_table(
    pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Rows of (page_id, url, sha1, payload_bytes, refers_to, chunk_no, data, last), the chunks
    of a page one after the other in its partition.

    ``pages`` has page_id, url and html; other columns are not looked at. Of pages with equal
    payloads of at least ``min_bytes`` bytes, the one with the smallest page_id carries the
    payload and the others refer to it. A null html counts as empty, a null page_id as larger than
    any other (it refers to null only if all are null, and is then a response). Rows that repeat
    the smallest page_id with the same payload are responses too.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    body = pages.select("page_id", "url", payload.alias("payload"))
    body = body.withColumn("sha1", F.sha1("payload"))
    narrow = body.filter(F.length("payload") >= min_bytes).select("page_id", "sha1")
    # the digests, not the payloads, are grouped; a hot digest is one row of each map task
    first = (
        narrow.groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("sha1", "first_id")
    )
    revisits = (
        narrow.join(first, "sha1")
        .filter(F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True)))
        .select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "first_id")
        .distinct()
    )
    together = body.join(
        revisits,
        body.page_id.eqNullSafe(F.col("r_id")) & (body.sha1 == F.col("r_sha1")),
        "left",
    )
    size = F.length("payload").cast("long")
    chunks = F.when(F.col("first_id").isNotNull(), F.lit(1)).otherwise(
        F.greatest(F.ceil(size / chunk_bytes), F.lit(1))
    )
    data = F.when(
        F.col("first_id").isNull(),
        F.substring(
            F.col("payload"),
            (F.col("chunk_no") * chunk_bytes + 1).cast("int"),
            F.lit(chunk_bytes),
        ),
    ).otherwise(F.lit(b""))
    return (
        together.select(
            "page_id",
            "url",
            "sha1",
            size.alias("payload_bytes"),
            F.col("first_id").alias("refers_to"),
            "payload",
            "first_id",
            chunks.alias("chunks"),
        )
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
        .select(
            "page_id",
            "url",
            "sha1",
            "payload_bytes",
            "refers_to",
            "chunk_no",
            data.alias("data"),
            (F.col("chunk_no") == F.col("chunks") - 1).alias("last"),
        )
    )


def write_archives(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the chunk table as gzipped WARC files, one for each task that has rows, and return
    the manifest: (path, start, stop, records) for each span of members.

    Only files that the manifest names count. A task that runs twice leaves a file that nothing
    names. ``folder`` is a URI that all executors reach, by default one below the shared folder.
    """
    spark = chunks.sparkSession
    folder, names = folder or fresh_path(spark, "warc"), chunks.columns

    def write(batches):
        sink = None
        try:
            for batch in batches:
                for row in zip(*(column(batch, n) for n in names)):
                    if sink is None:
                        sink = _Sink(folder)
                    sink.add(*row)
                    if sink.span >= SPAN_BYTES and sink.member is None:
                        yield _manifest(sink.cut())
            if sink is not None:
                yield _manifest(sink.cut())
        finally:
            if sink is not None:
                sink.file.close()

    return stored(chunks.mapInArrow(write, MANIFEST), "manifest")


def _manifest(span: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x], f.type) for x, f in zip(span, MANIFEST_ARROW)], schema=MANIFEST_ARROW
    )


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:  # a plain path, or Hadoop's file:/path
        return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}"


def _page_of(record: str) -> int | None:
    number = record.split(":")[2] if record.startswith("urn:x-page:") else ""
    return int(number) if number else None


class _Sink:
    """One archive file; records are added chunk by chunk."""

    def __init__(self, folder: str):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.path, self.file = f"{folder}/{name}", system.open_output_stream(
            f"{path}/{name}", compression=None
        )
        self.start = self.at = self.records = 0
        self.member = None

    @property
    def span(self) -> int:
        return self.at - self.start

    def put(self, data: bytes) -> None:
        if data:
            self.file.write(data)
            self.at += len(data)

    def add(self, page_id, url, sha1, payload_bytes, refers_to, chunk_no, data, last) -> None:
        if chunk_no == 0:
            self.member = zlib.compressobj(4, zlib.DEFLATED, 31)
            self.put(self.member.compress(_head(page_id, url, sha1, payload_bytes, refers_to)))
        self.put(self.member.compress(data))
        if last:
            self.put(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None
            self.records += 1

    def cut(self) -> tuple:
        span = (self.path, self.start, self.at, self.records)
        self.start, self.records = self.at, 0
        return span


def _line(text: str) -> str:
    return "".join(c for c in text if c >= " ")


def _head(page_id, url, sha1, payload_bytes, refers_to) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    name = record_id(page_id, digest)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url) if url else name}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    held = payload_bytes if refers_to is None else 0
    fields.append(f"Content-Length: {len(http) + held}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def read_archives(
    manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The records of the spans in ``manifest`` as chunk rows: header fields on each, the chunk
    (null unless ``with_data``), the bytes and the digest so far, and whether it is the last.

    A record without payload gives one empty chunk. What a damaged archive gives is an error of
    the task that reads it. A task holds one block of a file and one chunk at a time.
    """
    spans = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path", "start")

    def read(batches):
        def rows():
            for batch in batches:
                for path, start, stop in zip(*(column(batch, n) for n in ("path", "start", "stop"))):
                    system, inner = _open(path)
                    with system.open_input_file(inner) as file:
                        file.seek(start)
                        for row in _records(file, stop - start, chunk_bytes):
                            if with_data:
                                yield len(row[8]), row
                            else:
                                yield 0, (*row[:8], None, *row[9:])

        yield from rows_to_batches(rows(), CHUNKS_ARROW)

    return spans.select("path", "start", "stop").mapInArrow(read, CHUNKS)


class _Stream:
    """Inflated bytes of a run of gzip members."""

    def __init__(self, file, size: int):
        self.file, self.left, self.raw, self.held = file, size, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                if not self.raw and not self.left:
                    return False
                self.inflate = zlib.decompressobj(31)
            elif self.inflate.unconsumed_tail:
                self.raw = self.inflate.unconsumed_tail
            if not self.raw:
                if not self.left:
                    return False
                self.raw = self.file.read(min(READ_BYTES, self.left))
                if not self.raw:
                    raise EOFError("archive is shorter than its manifest says")
                self.left -= len(self.raw)
            out = self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = b""
            self.held += out
            if out:
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return found

    def take(self, most: int) -> bytes:
        while len(self.held) < most:
            if not self.more():
                raise EOFError("a record ends too early")
        found = bytes(self.held[:most])
        del self.held[:most]
        return found


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _records(file, size: int, chunk_bytes: int) -> Iterator[tuple]:
    stream = _Stream(file, size)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http_head = stream.until(b"\r\n\r\n")
        held = int(warc["content-length"]) - len(http_head) - 4
        name, kind = warc["warc-record-id"].strip("<>"), warc["warc-type"]
        refers = warc.get("warc-refers-to")
        full = int(_fields(http_head).get("content-length", held))
        sha, so_far, number = hashlib.sha1(), 0, 0
        fixed = (
            name,
            _page_of(name),
            kind,
            _page_of(refers.strip("<>")) if refers else None,
            warc.get("warc-target-uri"),
            full,
            warc["warc-payload-digest"].removeprefix("sha1:"),
        )
        while True:
            data = stream.take(min(chunk_bytes, held - so_far))
            sha.update(data)
            so_far += len(data)
            now = base64.b32encode(sha.digest()).decode()
            yield (*fixed, number, data, so_far, now, so_far == held)
            if so_far == held:
                break
            number += 1
        stream.take(4)


def pages_of(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunk rows that :func:`read_archives` gives. For responses,
    size and digest are those of the bytes read; a revisit has those its header states."""
    own = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id",
        F.when(own, F.col("so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far"))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type",
        "refers_to",
        (~own | (F.col("digest_so_far") == F.col("payload_digest"))).alias("intact"),
    )
