"""ZIP and tar archives as tables, read by byte ranges, and a ZIP sink with a commit. No archive, and no member, need fit in memory.

spark.read.format("archive").load(path): archive, member, bytes, sha256 of regular members. spark.read.format("archive_blocks").load(path): archive, member, at, content,
in blocks of at most blockBytes. The driver reads only where a ZIP's directory lies and walks it, or a tar's headers, in pieces, to cut it into ranges of about
partitionBytes of members; each range is one task, which reads its part of the directory and its members' bytes. A compressed tar can't be entered in the middle: one task, as a stream.

Members that could leave a folder (absolute names, .. in a path), links and devices are an error; so are encrypted members, unknown compression, and content that isn't as long, or hasn't the
checksum, that the archive says. Folders are left out. Option suffix: only members of this suffix. `members` also refuses two members of one name.

df.write.format("zip").mode(...).save(path): member string, content binary; each task's rows in archives of at most about archiveBytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .committed import CommittedWriter, place, published

PIECE = 1 << 20
SUFFIXES = (".zip", ".tar", ".tar.gz", ".tgz")


@dataclass
class Range(InputPartition):
    """Part of an archive: of a ZIP's directory from first to last, with so many members, of a tar's headers and members; kind is zip, tar or stream."""

    path: str
    kind: str
    first: int
    last: int
    members: int


@dataclass(frozen=True)
class Member:
    name: str
    regular: bool
    link: bool
    bytes: int
    packed: int
    method: int
    locked: bool
    crc: int
    header: int


def zip_directory(f, size: int) -> tuple[int, int, int]:
    """Where a ZIP's directory starts, its length, and the number of its members, from the records at the end; those for large archives are followed."""
    tail = min(size, 22 + (1 << 16))
    f.seek(size - tail)
    raw = f.read(tail)
    k = raw.rfind(b"PK\x05\x06")
    if k < 0 or len(raw) - k < 22:
        raise ValueError("not a ZIP archive")
    members, length, start = struct.unpack("<HII", raw[k + 10 : k + 20])
    if members == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        at = size - tail + k - 20
        f.seek(at)
        sign, _, where, _ = struct.unpack("<4sIQI", f.read(20))
        if sign != b"PK\x06\x07":
            raise ValueError("the record of a large archive is missing")
        f.seek(where)
        big = f.read(56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the record of a large archive is missing")
        members, length, start = struct.unpack("<QQQ", big[32:56])
    if start + length > size:
        raise ValueError("the directory lies beyond the archive")
    return start, length, members


def directory_entries(f, first: int, last: int) -> Iterator[tuple[int, Member]]:
    """Offset and member of each entry of a ZIP's directory between two entries, read in pieces."""
    at, held = first, b""
    f.seek(first)
    read = first
    while at < last:
        need = 46
        while True:
            if len(held) >= 46:
                need = 46 + sum(struct.unpack("<HHH", held[28:34]))
            if len(held) >= need:
                break
            more = f.read(min(PIECE, last - read))
            if not more:
                raise ValueError("the directory ends early")
            held, read = held + more, read + len(more)
        if held[:4] != b"PK\x01\x02":
            raise ValueError("not an entry of a directory")
        system, flags, method = held[5], *struct.unpack("<HH", held[8:12])
        crc, packed, size, n, extra, comment = struct.unpack("<IIIHHH", held[16:34])
        mode, header = struct.unpack("<II", held[38:46])
        name = held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more = held[46 + n : 46 + n + extra]
        while len(more) >= 4:  # the numbers that didn't fit, in this order
            kind, length = struct.unpack("<HH", more[:4])
            if kind == 1:
                large = list(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                size = large.pop(0) if size == 0xFFFFFFFF else size
                packed = large.pop(0) if packed == 0xFFFFFFFF else packed
                header = large.pop(0) if header == 0xFFFFFFFF else header
            more = more[4 + length :]
        unix = (mode >> 28) if system == 3 else 0  # the kind of file, where the archive was made on such a system
        yield at, Member(name, not name.endswith("/") and unix in (0, 8), unix not in (0, 4, 8), size, packed, method, bool(flags & 1), crc, header)
        held = held[46 + n + extra + comment :]
        at += 46 + n + extra + comment


def checked(name: str, link: bool) -> None:
    path = PurePosixPath(name.replace("\\", "/"))
    if link or path.is_absolute() or ".." in path.parts or "\0" in name or (len(name) > 1 and name[1] == ":"):
        raise ValueError(f"unsafe member: {name!r}")


def zip_content(f, m: Member) -> Iterator[bytes]:
    """The content of a member, in pieces; as long and with the checksum that the directory says."""
    if m.locked or m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{m.name}: encrypted, or compressed in an unknown way")
    f.seek(m.header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{m.name}: its header is missing")
    f.seek(m.header + 30 + sum(struct.unpack("<HH", local[26:30])))
    unpack = zlib.decompressobj(-15) if m.method == zipfile.ZIP_DEFLATED else None

    def plain() -> Iterator[bytes]:
        for raw in stream_content(f, m.packed, m.name):
            if not unpack:
                yield raw
            while unpack and raw:
                yield unpack.decompress(raw, PIECE)
                raw = unpack.unconsumed_tail
        if unpack:
            yield unpack.flush()

    size, crc = 0, 0
    for piece in plain():
        size, crc = size + len(piece), zlib.crc32(piece, crc)
        if size > m.bytes:
            break
        if piece:
            yield piece
    if size != m.bytes or crc != m.crc:
        raise ValueError(f"{m.name}: other content than the archive says")


def stream_content(f, size: int, name: str) -> Iterator[bytes]:
    while size:
        piece = f.read(min(PIECE, size))
        if not piece:
            raise ValueError(f"{name} ends early")
        size -= len(piece)
        yield piece


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, blocks: bool):
        self.path, self.suffix, self.blocks = options["path"], options.get("suffix", ""), blocks
        self.bytes, self.block = int(options.get("partitionBytes", 1 << 27)), int(options.get("blockBytes", 1 << 23))

    def partitions(self) -> list[Range]:
        at, _ = place(self.path)
        out: list[Range] = []
        for path, size in published(self.path, ""):
            if not path.endswith(SUFFIXES):
                continue
            if path.endswith((".gz", ".tgz")):
                out.append(Range(path, "stream", 0, size, 0))
                continue
            with at.open_input_file(path) as f:
                out += self._zip(path, f, size) if path.endswith(".zip") else self._tar(path, f, size)
        return out or [Range("", "", 0, 0, 0)]

    def _zip(self, path: str, f, size: int) -> Iterator[Range]:
        start, length, told = zip_directory(f, size)
        first, held, n, seen = start, 0, 0, 0
        for at, m in directory_entries(f, start, start + length):
            if n and held + m.packed > self.bytes:
                yield Range(path, "zip", first, at, n)
                first, held, n = at, 0, 0
            held, n, seen = held + m.packed + 4_096, n + 1, seen + 1
        if seen != told:
            raise ValueError(f"{path}: {seen} members where {told} are told")
        if n:
            yield Range(path, "zip", first, start + length, n)

    def _tar(self, path: str, f, size: int) -> Iterator[Range]:
        first, n = 0, 0
        with tarfile.open(fileobj=f, mode="r:") as tar:
            for item in tar:
                tar.members = []  # tarfile would keep them all
                if n and item.offset_data + item.size - first > self.bytes:
                    yield Range(path, "tar", first, item.offset, n)
                    first, n = item.offset, 0
                n += 1
        if n:
            yield Range(path, "tar", first, size, n)

    def _members(self, p: Range, f) -> Iterator[tuple[str, int, Iterator[bytes]]]:
        if p.kind == "zip":
            for _, m in list(directory_entries(f, p.first, p.last)):
                checked(m.name, m.link)
                if m.regular and m.name.endswith(self.suffix):
                    yield m.name, m.bytes, zip_content(f, m)
            return
        if p.kind == "tar":
            f.seek(p.first)
        with tarfile.open(fileobj=f, mode="r:" if p.kind == "tar" else "r|gz") as tar:
            for n, item in enumerate(tar):
                if p.kind == "tar" and n == p.members:
                    return
                tar.members = []
                checked(item.name, item.issym() or item.islnk() or not (item.isfile() or item.isdir()))
                if item.isfile() and item.name.endswith(self.suffix):
                    yield item.name, item.size, stream_content(tar.extractfile(item), item.size, item.name)

    def read(self, p: Range) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if not p.path:
            return
        at, _ = place(self.path)
        with at.open_input_stream(p.path, compression=None) if p.kind == "stream" else at.open_input_file(p.path) as f:
            for name, size, content in self._members(p, f):
                yield from self._blocks(p.path, name, content) if self.blocks else self._digest(p.path, name, size, content)

    def _digest(self, path: str, name: str, size: int, content: Iterator[bytes]) -> Iterator[tuple]:
        h = hashlib.sha256()
        for piece in content:
            h.update(piece)
        yield path, name, size, h.hexdigest()

    def _blocks(self, path: str, name: str, content: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        row = lambda at, x: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([at], pa.int64()), pa.array([bytes(x)])], ["archive", "member", "at", "content"])
        held, at = bytearray(), 0
        for piece in content:
            held += piece
            while len(held) >= self.block:
                yield row(at, held[: self.block])
                at += self.block
                del held[: self.block]
        if held or not at:
            yield row(at, held)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, bytes long, sha256 string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, False)


class ArchiveBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_blocks"

    def schema(self) -> str:
        return "archive string, member string, at long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, True)


class ZipWriter(CommittedWriter):
    suffix = ".zip"

    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.bytes = int(options.get("archiveBytes", 1 << 26))

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[None, int, bytes]]:
        out = io.BytesIO()
        z, n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0
        for b in batches:
            for row in zip(b.column("member"), b.column("content"), strict=True):
                name, content = row[0].as_py(), row[1].as_py()
                checked(name, False)
                if n and out.tell() + len(content or b"") > self.bytes:
                    z.close()
                    yield None, n, out.getvalue()
                    out = io.BytesIO()
                    z, n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0
                z.writestr(zipfile.ZipInfo(name), content or b"", zipfile.ZIP_DEFLATED)
                n += 1
        z.close()
        if n:
            yield None, n, out.getvalue()


class ZipSource(ArchiveSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options, schema, overwrite)


def members(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """archive, member, bytes, sha256; two members of one name in an archive are an error when it runs."""
    found = spark.read.format("archive").options(**options).load(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("archive", "member"))
    return found.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two members named "), "member")).cast("boolean")).otherwise(True)).drop("_n")
