"""FASTQ as a Spark data source, plain files in byte ranges and gzip files as streams.

``spark.read.format("fastq")`` plans a partition for every :data:`SPLIT` bytes of a
plain file, and of a block-compressed one (gzip members that tell their size); any
other gzip file is one partition, member after member. No task holds more than a
few megabytes of a file.

A range owns the records that begin behind a line feed of its own, and reads on
beyond its end to finish the last one. Its first record is found by the four-line rule:
a line that begins with ``@`` while the next but one begins with ``+``. A quality
line may begin with ``@`` too, but two lines after it stands a sequence, which
never begins with ``+``.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a read, and most bytes that one step of inflating makes.
SPLIT, CHUNK, INFLATED = 64 << 20, 1 << 20, 4 << 20
#: Bytes of the first read beyond a range's end, for its last record; each further one is twice as long.
BEYOND = 1 << 14

SCHEMA = "file string, start long, place long, header string, seq string, qual string"

_MEMBER = b"\x1f\x8b\x08\x04"
#: Largest size of a member that tells its size.
_MEMBER_BYTES = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``kind`` is plain, gzip or members."""

    path: str
    start: int
    end: int
    kind: str


def files(path: str) -> Iterator[tuple[str, int]]:
    """(name, bytes) of a file, of the data files below a folder, or of those that a pattern names, in the order of their names."""
    if any(c in path for c in "*?["):
        folder = path[: path.rindex("/", 0, min(path.find(c) for c in "*?[" if c in path))]
        yield from ((f, size) for f, size in files(folder) if fnmatch.fnmatchcase(f, path))
        return
    system, name = fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(name.rstrip("/"))] if path.rstrip("/").endswith(name.rstrip("/")) else ""
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
            yield prefix + f.path, f.size


def opened(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def member_size(head: bytes) -> int:
    """Bytes of the gzip member that begins here, if it tells them in its extra field; else 0."""
    if len(head) < 18 or head[:4] != _MEMBER:
        return 0
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        kind, size = extra[:2], struct.unpack_from("<H", extra, 2)[0]
        if kind == b"BC" and size == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + size :]
    return 0


def ranges(path: str, size: int, split: int) -> Iterator[Range]:
    kind = "plain"
    if path.endswith((".gz", ".bgz")):
        kind = "gzip"
        if size > split:
            with opened(path) as f:
                kind = "members" if member_size(f.read(256)) else "gzip"
    step = size if kind == "gzip" else split
    for start in range(0, size, max(step, 1)):
        yield Range(path, start, min(start + step, size), kind)


def _plain(f: pa.NativeFile, part: Range) -> Iterator[tuple[bytes, bool]]:
    f.seek(part.start)
    at, more = part.start, min(CHUNK, BEYOND)
    while data := f.read(min(CHUNK, part.end - at) if at < part.end else more):
        yield data, at < part.end
        more = min(CHUNK, 2 * more) if at >= part.end else more
        at += len(data)


def _inflated(f: pa.NativeFile, part: Range) -> Iterator[tuple[bytes, bool]]:
    member = zlib.decompressobj(31)
    while data := f.read(CHUNK):
        while data:
            out = member.decompress(data, INFLATED)
            if out:
                yield out, True
            data = member.unconsumed_tail
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
    if rest := member.flush():
        yield rest, True


def _members(f: pa.NativeFile, part: Range) -> Iterator[tuple[bytes, bool]]:
    """Members from the first one that begins in the range on; a member counts as one if another, or the end, follows it."""
    size = f.size()

    def head(at: int) -> int:
        f.seek(at)
        return member_size(f.read(256))

    at = part.start
    if at:
        f.seek(at)
        window = f.read(2 * _MEMBER_BYTES)
        place = window.find(_MEMBER)
        while place >= 0:
            length = member_size(window[place : place + 256])
            if length and (at + place + length == size or head(at + place + length)):
                break
            place = window.find(_MEMBER, place + 1)
        if place < 0:
            return
        at += place
    while at < size:
        length = head(at)
        if not length:
            raise ValueError(f"no member of a known size at byte {at} of {part.path}")
        f.seek(at)
        yield zlib.decompress(f.read(length), 31), at < part.end
        at += length


_STREAMS = {"plain": _plain, "gzip": _inflated, "members": _members}


def first_record(data: bytes, final: bool) -> int | None:
    """Where the first record behind a line feed begins; None if that can't be told yet, the length if there is none."""
    at = data.find(b"\n") + 1
    starts = []
    while at and len(starts) < 8:
        starts.append(at)
        at = data.find(b"\n", at) + 1
    for i, s in enumerate(starts):
        if i + 2 < len(starts) and data[s : s + 1] == b"@" and data[starts[i + 2] : starts[i + 2] + 1] == b"+":
            return s
    return len(data) if final else None


def _column(lines: list[bytes]) -> pa.Array:
    return pc.utf8_rtrim(pa.array(lines, pa.binary()).cast(pa.string()), "\r")


def records(part: Range) -> Iterator[pa.RecordBatch]:
    """The records that a range owns; an unfinished record at the end of the file is left out."""
    with opened(part.path) as f:
        stream = _STREAMS[part.kind](f, part)
        rest, at, limit, seen, place = b"", 0, None, 0, 0
        begun = part.start == 0
        while True:
            data, own = next(stream, (b"", False))
            final = not data
            if limit is None and not own and not final:
                limit = seen  # where the bytes of the next range begin
            seen += len(data)
            rest += data
            if final and rest and not rest.endswith(b"\n"):
                rest += b"\n"
            if not begun:
                skip = first_record(rest, final)
                if skip is None:
                    continue
                rest, at, begun = rest[skip:], at + skip, True
            feeds = np.flatnonzero(np.frombuffer(rest, np.uint8) == 10)
            starts = np.concatenate([[0], feeds[3::4] + 1])  # of the records, and of what is left
            n = len(feeds) // 4
            if limit is not None:
                n = min(n, int(np.searchsorted(starts + at, limit, "right")))
            if n:
                lines = rest[: starts[n]].split(b"\n")
                header = pc.utf8_slice_codeunits(_column(lines[0:-1:4]), 1)
                columns = [pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(np.arange(place, place + n)), header, pc.utf8_upper(_column(lines[1::4])), _column(lines[3::4])]
                yield pa.RecordBatch.from_arrays(columns, ["file", "start", "place", "header", "seq", "qual"])
                place += n
            done = int(starts[n])
            rest, at = rest[done:], at + done
            if final or limit is not None and at > limit:
                return


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return [r for p in self.paths for f, size in files(p) for r in ranges(f, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from records(partition)


class FastqSource(DataSource):
    """``spark.read.format("fastq")``: rows of :data:`SCHEMA`.

    ``path`` or ``paths`` (separated by line feeds) name files or folders, ``split`` the
    bytes of a range. ``start`` and ``place`` give a record's range and its place there.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))
