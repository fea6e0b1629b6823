"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Archives are files in the shared folder, reached through ``pyarrow.fs`` (local paths, HDFS and object
stores alike).  A task writes its own files under names of their attempt and moves them into place;
the table of finished archives is stored, so a repeated task cannot leave a second reading.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_batches, written

VERSION = b"WARC/1.1"
#: A payload of this size or more is stored once; an archive is closed at this size.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: Bytes read, and bytes inflated, at a time.
CHUNK = 1 << 16
#: The fixed date of the records: the tables carry none.
DATE = b"2026-01-01T00:00:00Z"

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "verified boolean, archive string, position long"
)


def classed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, bytes, refers_to``: which records revisit which.

    Of equal payloads of ``REVISIT_BYTES`` or more all rows of the largest page_id are responses, the
    others refer to it.  A null html is an empty payload; if all ids of a payload are null, all are
    responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    owners = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 and owner is not null").select("digest", "owner")
    joined = rows.join(owners, "digest", "left")
    other = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.select("page_id", "url", "html", "digest", "bytes", F.when(other, F.col("owner")).alias("refers_to"))


def _name(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else str(page_id).encode())


def _line(value: str | None) -> bytes:
    """A header value on one line: control characters and percent signs are percent-encoded."""
    return b"".join(b"%%%02X" % b if b < 0x20 or b in (0x7F, 0x25) else bytes([b]) for b in (value or "").encode("utf-8", "replace"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header alone."""
    digest = hashlib.sha1(payload).hexdigest().encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = b"revisit"
    head = []
    if refers_to is None:
        kind, block = b"response", block + payload
    else:
        head = [b"WARC-Refers-To: " + _name(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = [
        VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: " + _name(page_id), b"WARC-Date: " + DATE,
        *([b"WARC-Target-URI: " + _line(url)] if url is not None else []), *head,
        b"WARC-Payload-Digest: sha1:" + digest, b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``classed`` pages to archives below ``folder``; returns ``path, records, bytes``."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root)
        out, path, records, size = None, "", 0, 0

        def close():
            out.close()
            store.move(f"{root}/{path}.open", f"{root}/{path}")
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                names=["path", "records", "bytes"],
            )

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*cols, strict=True):
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}.open", compression=None)
                data = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers_to.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select("page_id", "url", "html", "refers_to")
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


#: How a gzip member begins.
GZIP = b"\x1f\x8b\x08"


class Damaged(ValueError):
    """A record that breaks its framing."""


class Member:
    """One gzip member of a stream, inflated piece by piece."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.inflate, self.ready = stream, rest, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            self.rest = b"" if data is self.rest else self.rest
            if not data:
                raise Damaged("the member ends early")
            try:
                got = self.inflate.decompress(data, CHUNK)
            except zlib.error as error:
                raise Damaged(str(error)) from error
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``: a header is as long as its url, at most the whole member."""
        parts, tail = [], b""
        while (at := (tail + self.ready).find(mark)) < 0:
            # what may hold the start of the mark is looked at again
            whole = tail + self.ready
            keep = min(len(whole), len(mark) - 1)
            parts.append(whole[: len(whole) - keep])
            tail, self.ready = whole[len(whole) - keep :], b""
            if not self._more():
                raise Damaged("a header without an end")
        whole = tail + self.ready
        self.ready = whole[at + len(mark) :]
        return b"".join([*parts, whole[:at]])

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.ready and not self._more():
                raise Damaged("the block is shorter than its length")
            part, self.ready = self.ready[:count], self.ready[count:]
            count -= len(part)
            yield part

    def finish(self) -> bytes:
        """Read to the member's end; returns the bytes of the stream that follow it."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or self.ready or self._more():
            raise Damaged("no end of record where its length says")
        return self.inflate.unused_data + self.rest


def _header(data: bytes) -> dict[bytes, bytes]:
    pairs = (line.partition(b":") for line in data.split(b"\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _id(value: bytes | None) -> int | None:
    body = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(body) if body.lstrip(b"-").isdigit() else None


def _record(stream, rest: bytes) -> tuple[dict, bytes]:
    """One record and the bytes that follow its member, with memory for one piece of a payload at a time."""
    member = Member(stream, rest)
    version, _, lines = member.until(b"\r\n\r\n").partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise Damaged("not a WARC record")
    head = _header(lines)
    left = int(head[b"content-length"])
    block, payload, http, seen = hashlib.sha1(), hashlib.sha1(), b"", 0
    inside = False
    for part in member.take(left):
        block.update(part)
        if not inside:
            http += part
            at = http.find(b"\r\n\r\n")
            if at < 0:
                continue
            part, http, inside = http[at + 4 :], http[:at], True
        payload.update(part)
        seen += len(part)
    rest = member.finish()
    kind = head[b"warc-type"].decode()
    told = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    size = int(_header(http.partition(b"\r\n")[2]).get(b"content-length", b"-1"))
    good = head.get(b"warc-block-digest", b"").removeprefix(b"sha1:").decode() == block.hexdigest()
    if kind == "response":
        good = good and told == payload.hexdigest() and size == seen
    url = head.get(b"warc-target-uri")
    found = {
        "page_id": _id(head.get(b"warc-record-id")), "url": None if url is None else url.decode("utf-8", "replace"),
        "record_type": kind, "refers_to": _id(head.get(b"warc-refers-to")), "payload_bytes": size,
        "payload_digest": told, "verified": good,
    }
    return found, rest


def _next_member(stream, at: int) -> int | None:
    """Where the next gzip member that holds a record begins, from ``at`` on."""
    tail = b""
    stream.seek(at)
    while data := stream.read(CHUNK):
        window, base = tail + data, at - len(tail)
        found = window.find(GZIP)
        while found >= 0:
            stream.seek(base + found)
            try:
                if zlib.decompressobj(31).decompress(stream.read(4096), 5).startswith(b"WARC/"):
                    return base + found
            except zlib.error:
                pass
            found = window.find(GZIP, found + 1)
        at += len(data)
        tail = window[-(len(GZIP) - 1) :]
        stream.seek(at)
    return None


def read_records(stream) -> Iterator[dict]:
    """Records of one archive (a stream that can seek) in order.

    Members are independent: a damaged one gives a record of type ``damaged``, and reading goes on at the next member
    that holds a record.
    """
    rest = stream.read(CHUNK)
    while rest:
        start = stream.tell() - len(rest)
        try:
            found, rest = _record(stream, rest)
            rest = rest or stream.read(CHUNK)
            yield found
        except (Damaged, KeyError, ValueError):
            yield {"record_type": "damaged", "verified": False}
            after = _next_member(stream, start + 1)
            if after is None:
                return
            stream.seek(after)
            rest = stream.read(CHUNK)


def read(archives: DataFrame) -> DataFrame:
    """All records of the archives in the column ``path``; see ``RECORD``.

    A record whose digests or lengths differ has ``verified`` false.  A member whose framing breaks gives one row of type
    ``damaged``; the records after it are read.  Other columns are ignored, a null path gives nothing.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()),
        ("archive", pa.string()), ("position", pa.int64()),
    ])

    def rows(path: str) -> Iterator[dict]:
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with store.open_input_file(name) as stream:
            for position, found in enumerate(read_records(stream)):
                yield found | {"archive": path, "position": position}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for found in rows(path):
                    held.append(found)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    paths = archives.where("path is not null").select("path")
    # one archive is the unit of sequential reading
    spread = max(1, min(archives.sparkSession.sparkContext.defaultParallelism * 4, 4096))
    return paths.repartition(spread, "path").mapInArrow(run, RECORD)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back."""
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))
    return read(write(classed(pages), scratch(pages.sparkSession, "warc")))
