"""WARC archives: writing one gzip member per record, and a splittable reader.

A reading task scans a byte range for the gzip magic, takes a place for a member only if the header and the
start of the WARC record decode, and owns the records that start inside its range; the last one may end
beyond it. So a file is read by as many tasks as it has ranges, whatever its size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import lean_batches, need
from cargolens.session import cut, num_shuffle_partitions, shared_dir

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES, RANGE_BYTES, READ_BYTES = 128 << 20, 8 << 20, 1 << 18
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper half of record ids; the lower half is the page's id, so that a reference leads back to it.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "cargolens:page").int >> 64 << 64


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | (page & (1 << 64) - 1))}>"


def page_of(name: str) -> int:
    low = uuid.UUID(name.strip("<>").rsplit(":", 1)[1]).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def member(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of an equal payload that is not stored again."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = record_id(page) if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest(payload))}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
             "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", LEVEL, mtime=0)


def _writer(folder: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, size, made = None, "", 0, []
        # A file counts only if its task reports it, so what a lost attempt left behind is never read.
        for batch in batches:
            for page, url, text, to in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "to"))):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(page, url, (text or "").encode("utf-8"), to)
                out.write(data)
                size += len(data)
                if size >= limit:
                    out.close()
                    made.append((name, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in made]), pa.array([s for _, s in made], pa.int64())], names=["path", "bytes"])

    return write


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row into new files in ``folder``; returns (path, bytes) of the files.

    Of rows with equal payloads the one with the largest key is a response and the others refer to it. Rows
    with a null key are always responses; rows that share key and payload are responses together. A null
    page is an empty payload. Payloads are told apart by their SHA-1, as WARC does.
    """
    need(pages, key, url, html)
    lean_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
                        F.sha1(F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")).alias("sum"))
    first = rows.groupBy("sum").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    # Only repeated payloads meet in the join, and only by their digests: the pages themselves are not shuffled by them.
    first = cut(first.select("sum", "first"))
    marked = rows.join(first, "sum", "left").withColumn("to", F.when(F.col("page") < F.col("first"), F.col("first")))
    base = fs.FileSystem.from_uri(folder)
    base[0].create_dir(base[1], recursive=True)
    return cut(marked.select("page", "url", "html", "to").mapInArrow(_writer(folder, file_bytes), "path string, bytes bigint"))


class _Source:
    """Bytes of a file from ``start`` on, read in pieces as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, at: int) -> bool:
        """Hold the bytes before ``at`` if the file has them."""
        at = min(at, self.size)
        while self.start + len(self.data) < at:
            self.file.seek(self.start + len(self.data))
            got = self.file.read(max(READ_BYTES, at - self.start - len(self.data)))
            if not got:
                return False
            self.data += got
        return True

    def drop(self, at: int) -> None:
        self.data = self.data[at - self.start:]
        self.start = at


def _starts_record(piece: bytes) -> bool:
    """Whether a member begins here: its header decodes, and so does the first line of a record."""
    try:
        return zlib.decompressobj(31).decompress(piece, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(source: _Source, at: int) -> tuple[bytes, int]:
    """Content of the member at ``at``, however long, and the place after it."""
    engine, out, here = zlib.decompressobj(31), [], at
    while not engine.eof:
        if not source.upto(here + READ_BYTES) or here >= source.size:
            raise EOFError(f"the file ends inside the member at {at}")
        piece = source.data[here - source.start:here - source.start + READ_BYTES]
        out.append(engine.decompress(piece))
        here += len(piece) - len(engine.unused_data)
    return b"".join(out), here


def records(path: str, begin: int, end: int) -> Iterator[bytes]:
    """Contents of the records that start in [begin, end)."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        source = _Source(file, begin, file.size())
        at = begin
        while at < min(end, source.size):
            source.upto(at + READ_BYTES)
            found = source.data.find(MAGIC, at - source.start)
            if found < 0:  # the magic may lie across the end of what is held
                at = max(at + 1, source.start + len(source.data) - len(MAGIC) + 1)
                source.drop(at)
                continue
            at = source.start + found
            if at >= end:
                return
            source.upto(at + 4096)
            if not _starts_record(source.data[at - source.start:at - source.start + 4096]):
                at += 1
                continue
            content, after = _member(source, at)
            yield content
            at = after
            source.drop(at)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "kind", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end"))):
            rows, held = [], 0
            for content in records(path, begin, end):
                head, rest = content.split(b"\r\n\r\n", 1)
                f = _fields(head)
                block = rest[:int(f["content-length"])]
                http, payload = block.split(b"\r\n\r\n", 1)
                size, named = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                if f["warc-type"] == "response" and (len(payload) != size or digest(payload) != named):
                    raise ValueError(f"payload of {f['warc-record-id']} in {path} is damaged")
                page = f.get("warc-page-id")
                to = f.get("warc-refers-to")
                rows.append((int(page) if page else None, f["warc-type"], size, named, page_of(to) if to else None, f.get("warc-target-uri"),
                             payload if f["warc-type"] == "response" else None))
                held += len(payload)
                if held > RANGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page, kind, payload_bytes, payload_digest, refers_to, url, payload) of all records of ``files`` (path, bytes).

    Payloads of responses are held against their length and digest; revisits have none. A range without a
    record start gives nothing, a damaged or cut-off record ends the job. Without files the result is empty.
    """
    need(files, "path", "bytes")
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = files.select("path", F.explode(begins).alias("begin")).withColumn("end", F.col("begin") + range_bytes)
    dealt = ranges.repartition(num_shuffle_partitions(files.sparkSession) * 4, "path", "begin")
    return dealt.mapInArrow(_parsed, "page bigint, kind string, payload_bytes bigint, payload_digest string, refers_to bigint, url string, payload binary")


def archive_folder(spark) -> str:
    """A new folder for archives in the shared one, as an address."""
    base = shared_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base}/warc-{uuid.uuid4().hex}"
