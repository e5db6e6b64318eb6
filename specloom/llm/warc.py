"""WARC archives as a chunked record table (operator 9).

Writing: each task streams its pages into archives in the shared folder, a gzip member for each record, a payload in
chunks of CHUNK bytes. Reading: archives come back as rows (record, chunk number) that carry the digest of the payload up
to and including the chunk. The row marked last so holds the digest and size of the whole payload; no step joins chunks,
holds a whole record, or groups by record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit

CHUNK, ARCHIVE_BYTES, BROADCAST_BYTES, LEAST = 1 << 20, 256 << 20, 32 << 20, 1000
DATE = "2020-01-01T00:00:00Z"
_ID = "urn:page:"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a URI, or of a local path."""
    path = re.sub(r"^(\w+):/(?=[^/])", r"\1:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest (hex SHA-1), record_type and refers_to.

    Of payloads that are equal (digest and size) and of at least least bytes, the largest page_id is the response. Rows
    without a page_id revisit it; where no row of a payload has one, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    several = made.filter(F.col("payload_bytes") >= least).groupBy("payload_bytes", "payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    several = kit.cut(several.filter("n > 1").drop("n"))
    if several.count() * 80 <= BROADCAST_BYTES:
        several = F.broadcast(several)
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    joined = made.join(several, ["payload_bytes", "payload_digest"], "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to"))


def _name(page_id) -> str:
    return f"<{_ID}{'none' if page_id is None else page_id}>"


def _number(name: str | None):
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _heads(page_id, url, size, digest, kind, refers_to) -> tuple[bytes, int]:
    """The record's and the HTTP response's header, and the bytes of payload that follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    follow = size if kind == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + follow}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, follow


def write(records: DataFrame, folder: str) -> DataFrame:
    """Archives of classify's rows in folder, which driver and executors share: archive, records, bytes.

    A task writes under a name of its attempt and renames at the end, so a task that is run again leaves one result.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        task, number, out, part = TaskContext.get(), 0, None, ""
        records = size = 0

        def close():
            out.close()
            final = f"part-{task.partitionId():06d}-{number:04d}.warc.gz"
            store.move(part, f"{base}/{final}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{final}"]), pa.array([records]), pa.array([size])], schema=schema)

        for batch in batches:
            url, html = batch.column("url"), batch.column("html").cast(pa.large_binary())
            rest = [batch.column(c).to_pylist() for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for r, (page_id, length, digest, kind, refers) in enumerate(zip(*rest, strict=True)):
                if out is None:
                    part = f"{base}/.part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
                    out, records, size = store.open_output_stream(part, compression=None), 0, 0
                head, follow = _heads(page_id, url[r].as_py(), length, digest, kind, refers)
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                pieces = [member.compress(head)]
                if follow:
                    payload = html[r].as_buffer()
                    for a in range(0, follow, CHUNK):
                        pieces.append(member.compress(payload.slice(a, min(CHUNK, follow - a))))
                        size += out.write(b"".join(pieces))
                        pieces = []
                size += out.write(b"".join(pieces) + member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, out = number + 1, None
        if out is not None:
            yield close()

    return kit.cut(records.mapInArrow(run, "archive string, records long, bytes long"))


class _Members:
    """Bytes of a file of gzip members, as far as asked for."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.source.read(CHUNK // 4)
            if not self.raw:
                return False
        self.held += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        return True

    def head(self) -> list[str] | None:
        """Lines up to the next empty one; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return None
        out, self.held = self.held[:end].decode(), self.held[end + 4 :]
        return out.split("\r\n")

    def take(self, n: int):
        """The next n bytes in pieces of at most CHUNK."""
        while n:
            while len(self.held) < min(n, CHUNK):
                if not self.more():
                    raise ValueError("the archive ends within a record")
            piece = self.held[: min(n, CHUNK)]
            self.held, n = self.held[len(piece) :], n - len(piece)
            yield piece


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def _rows(source):
    """Rows of the chunk table; the last of a response is held against the digest in its header."""
    stream = _Members(source)
    while (lines := stream.head()) is not None:
        record = _fields(lines)
        http_lines = stream.head()
        http = _fields(http_lines)
        left = int(record["content-length"]) - len("\r\n".join(http_lines).encode()) - 4
        declared = base64.b32decode(record["warc-payload-digest"].removeprefix("sha1:")).hex()
        known = (_number(record["warc-record-id"]), record.get("warc-target-uri"), record["warc-type"], _number(record.get("warc-refers-to")))
        if record["warc-type"] == "revisit":
            yield (*known, 0, True, int(http["content-length"]), declared, b"")
        else:
            digest, done, number = hashlib.sha1(usedforsecurity=False), 0, 0
            for piece in stream.take(left) if left else [b""]:
                digest.update(piece)
                done += len(piece)
                if done == left and digest.hexdigest() != declared:
                    raise ValueError(f"record {record['warc-record-id']} doesn't have its digest")
                yield (*known, number, done == left, done, digest.hexdigest(), piece)
                number += 1
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its header says")


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The chunk table of archives (a column archive of paths): page_id, uri, record_type, refers_to, chunk, last,
    bytes_so_far, digest_so_far and, if payload, data. Joined in the order of chunk, data is the payload. A revisit is
    one row without data, with the size and digest of what it refers to."""
    names = ["page_id", "uri", "record_type", "refers_to", "chunk", "last", "bytes_so_far", "digest_so_far", "data"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
    ddl = "page_id long, uri string, record_type string, refers_to long, chunk int, last boolean, bytes_so_far long, digest_so_far string, data binary"
    width = len(names) if payload else len(names) - 1
    schema = pa.schema(list(zip(names, types, strict=True))[:width])

    def run(batches):
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                store, base = store_of(path)
                held, size = [], 0
                with store.open_input_stream(base, compression=None) as source:
                    for row in _rows(source):
                        held.append(row[:width])
                        size += len(row[-1]) if payload else 0
                        if size >= 4 * CHUNK or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=False)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=False)], schema=schema)

    one_each = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return one_each.mapInArrow(run, ddl if payload else ddl.rpartition(", ")[0])


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = False) -> DataFrame:
    """The chunk table read back from archives of pages, written to a new folder in the shared one.

    A null html is an empty payload, a null url no target, a null page_id a record named none, which
    revisits the largest page_id of its payload. Rows that repeat a page_id are records of their own, and responses if that page_id is the largest of their payload. An empty table gives none;
    other columns are ignored.
    """
    kit.small_batches(pages.sparkSession)
    folder = folder or f"{kit.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(classify(pages), folder), payload)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    table = round_trip(kit.table(spark, sf_dir, "pages"))
    return table.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_bytes, payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN m USING (payload_bytes, payload_digest)
"""
