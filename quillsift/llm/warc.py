"""WARC: a normaliser of monolithic gzip.

A WARC file that was compressed as one gzip stream can't be read from the middle. The normaliser inflates each file once,
as a stream, writes every record as a gzip member of its own, and beside the new file a sidecar index of offset, length and
identity of each record, so that any record is one range read away. Files are the unit of work: one task holds no more than
a buffer of one, and output appears under its final name only when complete, so a task that is repeated does no harm.

Defined cases: a file that is already one member a record comes out alike, blanks of zero bytes behind members are passed over; an
empty file gives an empty file and no record. Where a stream breaks off or can't be inflated, in a record or between two, a row of
status ``truncated`` says so and what was whole before it is kept; nothing of it can be read beyond. A record whose header or end
isn't that of a record gives one row of status ``malformed`` and is not written, and reading goes on at the next header. A page
id that is no number of 64 bits is null; headers and records of any length and with null or empty content are whole records; repeated records are each
kept. ``from_pages`` turns a table of pages into such monolithic files: null url and null html are empty, other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .common import delete_at_exit, shared_dir, stored

CHUNK = 1 << 20
LEVEL = 6
INDEX = "file string, record long, page_id long, record_id string, uri string, offset long, length long, size long, digest string, status string"


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class _Final:
    """A file that gets its name when closed without error."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0
        return self

    def write(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def back_to(self, size: int):
        """Forgets what was written beyond ``size``."""
        if self.size == size:
            return
        self.out.close()
        old, self.part, self.size = self.part, f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}.part", size
        self.out = self.fs.open_output_stream(self.part, compression=None)
        with self.fs.open_input_stream(old, compression=None) as f:
            while size and (data := f.read(min(size, CHUNK))):
                self.out.write(data)
                size -= len(data)
        self.fs.delete_file(old)

    def __exit__(self, kind, *_):
        self.out.close()
        if kind:
            self.fs.delete_file(self.part)
        else:
            self.fs.move(self.part, self.path)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    name = hashlib.sha1(f"{page_id} {url}".encode()).hexdigest()
    uid = f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}"
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def from_pages(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """(path): monolithic files with a record for each row of (page_id, url, html), one file for each partition."""

    def write(batches):
        from pyspark import TaskContext

        path, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        with _Final(path) as out:
            for b in batches:
                for page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    out.write(deflate.compress(record(*page)))
                    n += 1
            out.write(deflate.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(write, "path string, records long")


def inflated(stream):
    """Chunks of what a gzip file of one or more members holds."""
    z, fed = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        if not fed:
            data = data.lstrip(b"\0")
        while data:
            yield z.decompress(data, 4 * CHUNK)
            fed = True
            if z.eof:
                data = z.unused_data.lstrip(b"\0")
                z, fed = zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if fed:
        raise EOFError


class _Reader:
    """Bytes from chunks: a header, or a number of them piece by piece. ``broken`` once the stream has failed or broken off."""

    def __init__(self, chunks):
        self.chunks, self.held, self.ended, self.broken = chunks, bytearray(), False, False

    def more(self) -> bool:
        try:
            while not self.ended:
                if piece := next(self.chunks):
                    self.held += piece
                    return True
        except StopIteration:
            self.ended = True
        except (EOFError, zlib.error):
            self.ended = self.broken = True
        return False

    def header(self) -> bytes | None:
        """A header with the blank line behind it; None if what follows isn't one."""
        while len(self.held) < 5 and self.more():
            pass
        if not self.held.startswith(b"WARC/"):
            return None
        looked = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(self.held)
            if not self.more():
                return None
        head = bytes(self.held[: end + 4])
        del self.held[: end + 4]
        return head

    def to_next(self):
        """Passes over all up to the next header behind a blank line."""
        mark, looked = b"\r\n\r\nWARC/", 0
        while (at := self.held.find(mark, looked)) < 0:
            del self.held[: max(0, len(self.held) - len(mark) + 1)]
            if not self.more():
                self.held.clear()
                return
        del self.held[: at + 4]

    def pieces(self, n: int):
        while n:
            if not self.held and not self.more():
                return
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"-?[0-9]{1,19}", x) and -(1 << 63) <= int(x) < 1 << 63 else None


def normalised(path: str, to: str, level: int = LEVEL):
    """Rewrites one file as ``to`` and ``to``.idx; yields a row of INDEX for each record."""
    where, name = _open(path)
    file, n = to.rpartition("/")[2], 0
    with where.open_input_stream(name, compression=None) as stream, _Final(to) as out, _Final(f"{to}.idx") as index:
        reader = _Reader(inflated(stream))
        while reader.held or reader.more():
            head, offset, bad = reader.header(), out.size, None
            fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in (head or b"").decode("utf-8", "replace").split("\r\n")[1:] if x))
            length = fields.get("content-length", "")
            if head is None:
                bad = "truncated" if reader.ended and reader.held.startswith(b"WARC/") else "malformed"
            elif not (length.isascii() and length.isdigit()):
                bad = "malformed"
            else:
                gz, digest, whole, got = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), int(length), 0
                held = gz.compress(head)
                for piece in reader.pieces(whole):
                    digest.update(piece)
                    got += len(piece)
                    held += gz.compress(piece)
                    if len(held) > CHUNK:  # taken back if the record turns out to be bad
                        out.write(held)
                        held = b""
                tail = b"".join(reader.pieces(4)) if got == whole else b""
                if tail == b"\r\n\r\n":
                    out.write(held + gz.compress(tail) + gz.flush())
                else:
                    bad = "malformed" if len(tail) == 4 else "truncated"
                    reader.held[:0] = tail
            if bad:
                out.back_to(offset)
                yield (file, n, None, None, None, None, None, None, None, bad)
                n += 1
                if bad == "truncated":
                    return
                reader.to_next()
                continue
            rid, uri = fields.get("warc-record-id"), fields.get("warc-target-uri")
            index.write(f"{offset} {out.size - offset} {rid} {uri}\n".encode())
            yield (file, n, _number(fields.get("x-page-id")), rid, uri, offset, out.size - offset, whole, digest.hexdigest(), "ok")
            n += 1
        if reader.broken:
            yield (file, n, None, None, None, None, None, None, None, "truncated")


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rows of INDEX for the records of all files in column ``path``; the new files and their sidecars go to ``folder``."""
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64()}[t]) for c, t in (x.split() for x in INDEX.split(", "))])

    def each(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for row in normalised(path, f"{folder}/{path.rpartition('/')[2]}", level):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(each, INDEX)


def read(path: str, offset: int, length: int) -> bytes:
    """A record of a normalised file, by a range read."""
    where, name = _open(path)
    with where.open_input_file(name) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def pages_index(pages: DataFrame) -> DataFrame:
    """The index of the normalised files of all pages: written as monolithic files first, then normalised."""
    spark = pages.sparkSession
    folder = delete_at_exit(spark, shared_dir(spark))
    files = stored(from_pages(pages, f"{folder}/monolithic"))
    return stored(normalise(files, f"{folder}/normalised"))
