"""WARC files: a sequential reader and the writer that its round trip needs.

One gzip member holds one record. The reader asks a stream for a chunk at a time, inflates it piece by piece, frames the block by
Content-Length and verifies block and payload digests (SHA-1, SHA-256 or MD5, in base 32 or hexadecimal, of any letter case) as the bytes
come. Of a record only the payload is held: neither its compressed bytes nor a second copy.
A damaged member is reported and skipped: the stream is set back behind its start and reading goes on at the next member's magic.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
#: Bytes that are inflated at a time.
STEP_BYTES = 1 << 22
#: A file is closed when it has so many bytes.
FILE_BYTES = 1 << 28
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "file string, record_offset bigint, record_id string, record_type string, url string, date string, content_length bigint, status string, payload binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


_ALGORITHMS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def _equal(value: str, own: bytes) -> bool:
    """Whether a digest written in base 32 or hexadecimal, in any letter case, is ``own``."""
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _field(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_id: str, url: str | None, payload: bytes | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """One gzip member: a response record with the payload behind an HTTP head, or a metadata record without payload."""
    block = b"" if payload is None else _HTTP + payload
    head = ["WARC/1.0", f"WARC-Type: {'metadata' if payload is None else 'response'}", f"WARC-Record-ID: <{_field(record_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head.append(f"WARC-Block-Digest: {digest(block)}")
    if payload is not None:
        head += [f"WARC-Payload-Digest: {digest(payload)}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class Record:
    """A record that comes in pieces: header fields, then a block framed by its length, then the two empty lines."""

    def __init__(self) -> None:
        self.head: bytearray | None = bytearray()
        self.fields: dict[str, str] = {}
        self.bad: str | None = None
        self.size = self.got = 0
        self.payload, self.tail = bytearray(), bytearray()
        self.http: bytearray | None = None  # the head of a response, until its empty line
        self.digests: list[tuple[str, str, object]] = []

    def feed(self, data: bytes) -> None:
        if self.head is None:
            return self._block(data)
        seen = max(0, len(self.head) - 3)
        self.head += data
        end = self.head.find(b"\r\n\r\n", seen)
        if end >= 0:
            rest = bytes(self.head[end + 4 :])
            self._header(bytes(self.head[:end]))
            self.head = None
            self._block(rest)

    def _header(self, head: bytes) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = self.fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdecimal():
            self.bad = "bad header"
            return
        self.size = int(length)
        if self.fields.get("content-type", "").startswith("application/http"):
            self.http = bytearray()
        revisit = self.fields.get("warc-type", "").lower() == "revisit"
        for name in ("warc-block-digest", "warc-payload-digest"):
            # A revisit's payload digest is that of the record it points to.
            if (told := self.fields.get(name)) and not (revisit and name == "warc-payload-digest"):
                kind, _, value = told.partition(":")
                make = _ALGORITHMS.get(kind.strip().lower().replace("-", ""))
                self.digests.append((name, value.strip(), make and make()))

    def _hash(self, name: str, data: bytes) -> None:
        for told, _, engine in self.digests:
            if told == name and engine:
                engine.update(data)

    def _block(self, data: bytes) -> None:
        if self.bad:
            return
        body, rest = data[: self.size - self.got], data[self.size - self.got :]
        self.got += len(body)
        self.tail += rest[: 5 - len(self.tail)] if len(self.tail) < 5 else b""
        self._hash("warc-block-digest", body)
        if self.http is not None:
            seen = max(0, len(self.http) - 3)
            self.http += body
            end = self.http.find(b"\r\n\r\n", seen)
            if end < 0:
                return
            body, self.http = bytes(self.http[end + 4 :]), None
        self._hash("warc-payload-digest", body)
        self.payload += body

    def result(self) -> dict:
        f = self.fields
        out = {
            "record_id": f.get("warc-record-id", "").strip("<>") or None, "record_type": f.get("warc-type"), "url": f.get("warc-target-uri"),
            "date": f.get("warc-date"), "content_length": None, "status": "ok", "payload": None,
        }
        if self.head is not None or self.bad:
            return out | {"status": "bad header"}
        out["content_length"] = self.size
        if self.got < self.size:
            return out | {"status": "truncated"}
        if self.tail != b"\r\n\r\n":
            return out | {"status": "bad framing"}
        out["payload"] = None if out["record_type"] == "metadata" and not self.size else bytes(self.payload)
        for _, value, engine in self.digests:
            if engine is None:
                out["status"] = "unverified"
            elif not _equal(value, engine.digest()):
                return out | {"status": "bad digest"}
        return out


def read_records(stream: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """The records of a seekable stream in order, one in memory at a time, with the offset of each one's member."""
    at = 0  # the member's offset
    data = stream.read(read_bytes)
    while data:
        inflate, record, used, failed = zlib.decompressobj(31), Record(), 0, False
        piece = data
        try:
            while True:
                used += len(piece)
                out = inflate.decompress(piece, STEP_BYTES)
                while out or inflate.unconsumed_tail:
                    record.feed(out)
                    out = inflate.decompress(inflate.unconsumed_tail, STEP_BYTES) if inflate.unconsumed_tail else b""
                if inflate.eof or not (piece := stream.read(read_bytes)):
                    break
        except zlib.error:
            failed = True
        if not failed and inflate.eof:
            yield {"offset": at} | record.result()
            at += used - len(inflate.unused_data)
            data = inflate.unused_data or stream.read(read_bytes)
            continue
        if not failed and used >= 3:
            yield {"offset": at, "status": "truncated"}
            return
        yield {"offset": at, "status": "bad member"}
        stream.seek(at + 1)
        at, data = at + 1, b""
        while True:
            more = stream.read(read_bytes)
            data += more
            if (k := data.find(MAGIC)) >= 0 or not more:
                break
            at, data = at + max(0, len(data) - 2), data[-2:]
        if k < 0:
            return
        at, data = at + k, data[k:]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system that tasks can reach and a path in it, from a Hadoop URI."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_warc(records: DataFrame, path: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> int:
    """Write rows of ``(record_id, url, payload)`` as ``*.warc.gz`` files and return how many records were written.

    Files are named by partition and written under another name first, so a task that is repeated replaces its own files.
    Null ids become ``null``, null urls no field, null payloads metadata records. A header field has one line without blanks at its
    ends: line ends in an address are written as ``%0D`` and ``%0A`` and come back so, and blanks at its ends are lost.
    """
    data = records.select(F.col("record_id").cast("string"), F.col("url").cast("string"), F.col("payload").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for r in zip(*(b[c] for c in ("record_id", "url", "payload"))))
        n, part, row = 0, 0, next(rows, None)
        while row is not None:
            name = f"{base}/part-{context.partitionId():05d}-{part:03d}.warc.gz"
            hidden = f"{base}/_{context.taskAttemptId()}-{part}"
            size = 0
            with fs.open_output_stream(hidden, compression=None) as out:
                while row is not None and size < file_bytes:
                    ident, url, payload = (x.as_py() for x in row)
                    member = encode_record("null" if ident is None else ident, url, payload, level=level)
                    out.write(member)
                    size += len(member)
                    n += 1
                    row = next(rows, None)
            fs.move(hidden, name)
            part += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return data.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ``*.warc.gz`` files under ``path``, each file read by one task (small files may share one); ``status`` is ``ok``, ``unverified`` (a digest of an unknown algorithm) or what is wrong with the record.

    Damaged members have a row with an offset and a status only; a folder without files gives an empty table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u.as_py() for b in batches for u in b["path"]):
            fs, at = _open(uri)
            with fs.open_input_file(at) as stream:
                rows, size = [], 0
                for r in read_records(stream):
                    rows.append((uri, r["offset"], *[r.get(c) for c in names[2:]]))
                    size += len(r.get("payload") or b"")
                    if size > 1 << 22 or len(rows) >= 5000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, SCHEMA)
