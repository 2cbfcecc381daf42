"""WARC archives as a Spark data source: spark.read.format("textlake_warc") and df.write.format("textlake_warc").

An archive is a row of gzip members with a record each. A file is read in ranges of `range_bytes`; a member belongs to the range that its
first byte lies in, so ranges need no plan beforehand: a reader looks for the first member from its range's start on and stops at the
first one past its end. What looks like a member is one if it inflates to a record's head. Members are inflated as streams and records come
one at a time, in Arrow batches of `batch_bytes`; memory is one record that is kept, a batch, and buffers of STEP bytes. A record longer
than `max_record_bytes` is passed over without being held, as its row would not fit a task: its row has a null http and its length.

A broken member loses only itself: the next one is looked for. Plain archives are one range each. Files are opened by pyarrow.fs from
tasks, so paths are of any file system that it knows (local, hdfs, s3, gs).

Options of reading: path (file, folder or pattern), range_bytes, batch_bytes, max_record_bytes, kind (only records of this WARC-Type), html (true: only those whose
HTTP head says text/html). Rows: path, member (offset of the member), pos (record in it), kind, url, date, length, http.
Writing takes url, http and optionally kind and date, a member for each row, a file for each task, which appears when the job commits.
"""

from __future__ import annotations

import fnmatch
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, member long, pos int, kind string, url string, date string, length long, http binary"
MAGIC = b"\x1f\x8b\x08"
#: Bytes read or inflated at a time.
STEP = 1 << 18
RANGE_BYTES, BATCH_BYTES, MAX_RECORD_BYTES = 64 << 20, 8 << 20, 256 << 20
_FIELDS = ("path", "member", "pos", "kind", "url", "date", "length", "http")
_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Broken(ValueError):
    """Bytes that are no member or no record."""


class Window:
    """A file read forwards from a place, STEP bytes at a time."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(STEP)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def find(self, what: bytes) -> bool:
        """Move to the next place of some bytes; False at the end of the file."""
        while (k := self.held.find(what)) < 0:
            self.drop(max(0, len(self.held) - len(what) + 1))
            if not self.more():
                return False
        self.drop(k)
        return True


def inflated(window: Window) -> Iterator[bytes]:
    """The bytes of the member at the window's place, at most STEP at a time; the window then stands behind it."""
    stream = zlib.decompressobj(31)
    while not stream.eof:
        if not window.held and not window.more():
            raise Broken("a member ends with the file")
        try:
            out = stream.decompress(window.held, STEP)
        except zlib.error as e:
            raise Broken(str(e)) from None
        rest = stream.unused_data if stream.eof else stream.unconsumed_tail
        window.drop(len(window.held) - len(rest))
        if out:
            yield out


class Reader:
    """Lines and blocks from pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        got = next(self.pieces, b"")
        self.held += got
        return bool(got)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to a mark, which is taken too; None at the end."""
        while (k := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise Broken("a record's head is too long")
            if not self.more():
                return None
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def seek(self, mark: bytes) -> bool:
        """Drop everything before the next mark; False at the end."""
        while (k := self.held.find(mark)) < 0:
            self.held = self.held[max(0, len(self.held) - len(mark) + 1) :]
            if not self.more():
                return False
        self.held = self.held[k:]
        return True

    def take(self, n: int, keep: bool) -> bytes | None:
        """n bytes, joined if they are to be kept; fewer at the end."""
        parts, left = [], n
        while left and (self.held or self.more()):
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts) if keep else None


def records(pieces: Iterator[bytes], kind: str | None = None, html: bool = False, most: int = MAX_RECORD_BYTES) -> Iterator[tuple[str, str, str, int, bytes | None]]:
    """(kind, url, date, length, http) of the records in a stream; http is null where it is longer than `most`. Records that are not asked for are passed over.

    A stream that does not begin with a record is broken; after a later broken one, the next head is looked for.
    """
    reader, begun = Reader(pieces), False
    while True:
        head = reader.until(b"\r\n\r\n", 1 << 20)
        if head is None:
            return
        first, _, rest = head.lstrip(b"\r\n").partition(b"\r\n")
        if not first.startswith(b"WARC/"):
            if not begun:
                raise Broken("no record")
            reader.held = head + b"\r\n\r\n" + reader.held
            if not reader.seek(b"WARC/"):
                return
            begun = False
            continue
        begun = True
        fields = dict(x.split(":", 1) for x in rest.decode("utf-8", "replace").split("\r\n") if ":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        of, length = fields.get("warc-type", ""), fields.get("content-length", "0") or "0"
        if not (length.isascii() and length.isdigit()):
            if not reader.seek(b"WARC/"):
                return
            continue
        n = int(length)
        wanted = kind is None or of == kind
        if wanted and html:  # the HTTP head tells, if it is near
            while len(reader.held) < min(n, 1 << 16) and b"\r\n\r\n" not in reader.held and reader.more():
                pass
            wanted = b"text/html" in reader.held[:n].partition(b"\r\n\r\n")[0].lower()
        http = reader.take(n, wanted and n <= most)
        if wanted:
            yield of, fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date", ""), n, http


def read_range(file, path: str, low: int, high: int, kind: str | None = None, html: bool = False, most: int = MAX_RECORD_BYTES) -> Iterator[tuple]:
    """Rows of the members that begin in [low, high)."""
    window = Window(file, low)
    while window.find(MAGIC) and window.at < high:
        at, rows = window.at, []
        try:
            for pos, record in enumerate(records(inflated(window), kind, html, most)):
                if rows:  # a member of many records is given out as it goes
                    yield rows.pop()
                rows.append((path, at, pos, *record))
            yield from rows
        except Broken:
            yield from rows
            file_at = at + 1
            window = Window(file, file_at)
            continue


def read_plain(file, path: str, kind: str | None = None, html: bool = False, most: int = MAX_RECORD_BYTES) -> Iterator[tuple]:
    def pieces() -> Iterator[bytes]:
        while got := file.read(STEP):
            yield got

    try:
        for pos, record in enumerate(records(pieces(), kind, html, most)):
            yield (path, 0, pos, *record)
    except Broken:
        return


def batches(rows: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], list(_FIELDS))

    for row in rows:
        held.append(row)
        n += len(row[-1] or b"") + 64
        if n >= size:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    plain: bool


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.number = lambda name, default: int(options.get(name, default))

    def __getstate__(self) -> dict:
        return {"options": self.options}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["options"])

    def partitions(self) -> list[InputPartition]:
        path, size = self.options["path"], self.number("range_bytes", RANGE_BYTES)
        system, at = _opened(path)
        found = system.get_file_info(at)
        if found.type == fs.FileType.File:
            files = [found]
        elif set("*?[") & set(at):
            fixed = at[: min(at.index(c) for c in "*?[" if c in at)].rsplit("/", 1)[0]
            files = [f for f in system.get_file_info(fs.FileSelector(fixed, recursive=True)) if fnmatch.fnmatchcase(f.path, at)]
        else:
            files = system.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", ".")) and f.size), key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                plain = file.read(2) != MAGIC[:2]
            name = f.path if "://" not in path else f"{path.split('://')[0]}://{f.path}"
            ranges = [(0, f.size)] if plain else [(k, min(k + size, f.size)) for k in range(0, f.size, size)]
            out += [Range(name, low, high, plain) for low, high in ranges]
        return out or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        how = self.options.get("kind"), self.options.get("html", "false").lower() == "true", self.number("max_record_bytes", MAX_RECORD_BYTES)
        system, at = _opened(partition.path)
        with system.open_input_file(at) as file:
            rows = read_plain(file, partition.path, *how) if partition.plain else read_range(file, partition.path, partition.low, partition.high, *how)
            yield from batches(rows, self.number("batch_bytes", BATCH_BYTES))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows) -> Written:
        system, at = _opened(self.path)
        system.create_dir(f"{at}/_parts", recursive=True)
        name, n = f"{at}/_parts/part-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(name, compression=None) as out:
            for row in rows:
                got = row.asDict()
                out.write(member(got.get("url") or "", bytes(got.get("http") or b""), got.get("kind") or "response", got.get("date") or ""))
                n += 1
        if not n:
            system.delete_file(name)
        return Written(name if n else None)

    def commit(self, messages: list) -> None:
        system, at = _opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{at}/{m.path.rsplit('/', 1)[1]}")
        system.delete_dir(f"{at}/_parts")

    def abort(self, messages: list) -> None:
        system, at = _opened(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


def member(url: str, http: bytes, kind: str = "response", date: str = "") -> bytes:
    """A record as a gzip member of its own."""
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n" + (f"WARC-Target-URI: {url}\r\n" if url else "") + (f"WARC-Date: {date}\r\n" if date else "")
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + http + b"\r\n\r\n") + packer.flush()


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textlake_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
