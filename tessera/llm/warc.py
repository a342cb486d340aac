"""WARC archives: a writer and a sequential reader.

The writer makes one gzip member per record, as the format asks. The reader
goes through an archive once, from the first byte on: zlib inflates
incrementally, the record's Content-Length says where its block ends, the end
of the member must come where the record ends, and block and payload digests
are computed as the bytes pass. Files are reached through ``pyarrow.fs``, by
the URI of the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, saved

REVISIT_LEAST = 1000
CHUNK = 1 << 16
ROLL_BYTES = 256 << 20
_ID = "urn:tessera:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"^\w+:/", uri) else f"file://{uri}")


# -- writing ----------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, as one gzip member."""
    sha = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = open_fs(folder)
    files.create_dir(root, recursive=True)
    task = TaskContext.get()
    stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
    out, done, n, size = None, [], 0, 0
    for b in batches:
        cols = [b.column(c) for c in ("_id", "_url", "_html", "_to", "_revisit")]
        for i in range(b.num_rows):
            if out is None:
                name = f"{stem}-{len(done):04d}.warc.gz"
                out, n, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
            page_id, url, html, to, revisit = (c[i].as_py() for c in cols)
            data = record(page_id, url, html.encode(), to, revisit)
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= ROLL_BYTES:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder}/{name}", n, size))
    if done:
        path, n, size = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                                         names=["path", "records", "bytes"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = REVISIT_LEAST) -> DataFrame:
    """Write every page as a WARC record and return the manifest (path,
    records, bytes) of the archives of committed tasks; files of lost attempts
    are in no manifest. Of records with equal payloads of at least ``least``
    bytes, that with the largest id is the response and the others revisit it.
    Null html is an empty payload; a record without an id is written as such
    and never refers to or is referred to unless another row has an id. Rows
    that repeat an id are records of their own, none of which revisits another
    of that id. A payload of any length is one record. An empty table gives an
    empty manifest; other columns are not read."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    raw = F.encode("_html", "UTF-8")
    rows = rows.withColumn("_n", F.octet_length("_html")).withColumn(
        "_k", F.when(F.col("_n") >= least, F.sha2(raw, 256)))
    twice = rows.where(F.col("_k").isNotNull()).groupBy("_k").agg(
        F.max("_id").alias("_to"), F.count(F.lit(1)).alias("_c")).where("_c > 1 and _to is not null").select("_k", "_to")
    rows = rows.join(twice, "_k", "left").withColumn(
        "_revisit", F.col("_to").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_to")))
    folder = new_dir(pages.sparkSession, "warc")
    manifest = rows.select("_id", "_url", "_html", "_to", "_revisit").mapInArrow(
        lambda b: _write(b, folder), "path string, records long, bytes long")
    return saved(manifest, "warc-manifest")


# -- reading ----------------------------------------------------------------

class Member:
    """One gzip member, inflated on demand. ``rest`` is what was read past
    its end."""

    def __init__(self, file, ahead: bytes) -> None:
        self.file, self.z, self.out, self.ahead = file, zlib.decompressobj(31), b"", ahead

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.ahead or self.file.read(CHUNK)
        if not self.z.unconsumed_tail:
            self.ahead = b""
        if not data:
            raise ValueError("archive ends within a gzip member")
        self.out += self.z.decompress(data, CHUNK)
        return True

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("record header without an end")
        got, self.out = self.out[:at], self.out[at + 2:]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ValueError("block is shorter than its Content-Length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            if got:
                yield got

    def end(self) -> bytes:
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("block is longer than its Content-Length")
        while not self.out and self._more():
            pass
        if self.out:
            raise ValueError("gzip member goes on after its record")
        return self.z.unused_data or self.ahead


def _headers(m: Member) -> dict[str, str]:
    out = {}
    while line := m.line():
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(value: str) -> int | None:
    got = value.strip("<>").removeprefix(_ID)
    return None if got == "none" else int(got)


def read_records(file) -> Iterator[dict]:
    """The records of one archive, in order. Raises on a frame that is off, a
    digest that does not match or a truncated member."""
    ahead = b""
    while True:
        ahead = ahead or file.read(CHUNK)
        if not ahead:
            return
        m = Member(file, ahead)
        if not m.line().startswith(b"WARC/1."):
            raise ValueError("no WARC record where one should begin")
        head = _headers(m)
        block, payload, parts, http = hashlib.sha1(), hashlib.sha1(), [], b""
        for part in m.take(int(head["content-length"])):
            block.update(part)
            if http is not None:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                head["http"], part, http = http[:at].decode(), http[at + 4:], None
            payload.update(part)
            parts.append(part)
        ahead = m.end()
        if head["warc-block-digest"] != f"sha1:{block.hexdigest()}":
            raise ValueError("block digest differs")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        size = int(re.search(r"(?im)^content-length:\s*(\d+)", head["http"])[1])
        body = b"".join(parts)
        if not revisit and (payload.hexdigest() != digest or len(body) != size):
            raise ValueError("payload digest or length differs")
        yield {"page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"),
               "record_type": head["warc-type"], "payload_bytes": size, "payload_digest": digest,
               "refers_to": _page(head["warc-refers-to"]) if revisit else None,
               "payload": None if revisit else body}


READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
               "refers_to long, payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                    ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            files, at = open_fs(path)
            part, size = [], 0
            with files.open_input_stream(at, compression=None) as f:
                for r in read_records(f):
                    if not payloads:
                        r["payload"] = None
                    part.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(part, _ARROW)
                        part, size = [], 0
            if part:
                yield pa.RecordBatch.from_pylist(part, _ARROW)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives that ``manifest`` lists in ``path``, each file
    read by one task from front to back; archives are dealt out over tasks."""
    paths = manifest.select("path")
    return paths.repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(
        lambda b: _read(b, payloads), READ_SCHEMA)
