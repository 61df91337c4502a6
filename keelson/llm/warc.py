"""WARC archives compressed by a dictionary of their own, written and read through Spark's file sources.

An archive (.warc.zst) is a leading skippable frame (magic 0x184D2A5D) that embeds a Zstandard dictionary, then one frame
for each record. The dictionary is trained on records of that archive. Spark's text writer
puts the frames down as raw bytes and, as its line separator, an empty skippable frame (magic 0x184D2A50, size 0), which
any reader passes over; so archives reach any file system that Spark writes to, under its commit protocol, and a task that
is lost is simply run again. A partition makes archives of FRAMES frames each, which is where the writer opens the next file; one that has
ARCHIVE_BYTES sooner is filled up with empty frames, so no archive, read back as one value, is larger than that and a record.
Payload digests elect responses before writing; a revisit holds no payload. Copies meet their response in SALTS groups, as one page may be a third of all.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<page_id>; a null page_id takes part (it
revisits the smallest page_id with its payload; if that has none either, it is a response); rows that repeat the elected page_id
are responses too; an empty table gives archives without records and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table

DICT_MAGIC = 0x184D2A5D
#: an empty skippable frame
GAP = struct.pack("<II", 0x184D2A50, 0)
#: records at the head of an archive that its dictionary is trained on, and their bytes; all records are archived
TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES = 1000, 8 << 20, 64 << 10
FRAMES, ARCHIVE_BYTES, SALTS = 20_000, 256 << 20, 16
DATE = "2026-01-01T00:00:00Z"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def _quoted(url: str) -> str:
    return _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {_quoted(url) if url else f'urn:page:{name}'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; of too few or too small ones, their plain content."""
    if sum(map(len, samples)) > 16 * DICT_BYTES // 8:
        try:
            return zstd.train_dictionary(DICT_BYTES, samples, k=512, d=8).as_bytes()
        except zstd.ZstdError:
            pass
    return b"".join(samples)[: DICT_BYTES // 8]


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def archived(records: Iterator[bytes], frames: int = FRAMES, most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """The frames of archives, so many in each but the last: a dictionary, the records, and empty frames where an archive has its bytes sooner."""
    while True:
        head, size = [], 0
        for rec in records:
            head.append(rec)
            size += len(rec)
            if len(head) >= min(TRAIN_RECORDS, frames - 1) or size >= min(TRAIN_BYTES, most):
                break
        if not head:
            return
        raw = train(head)
        packer = zstd.ZstdCompressor(level=3, dict_data=_dictionary(raw), write_checksum=True)
        yield struct.pack("<II", DICT_MAGIC, len(raw)) + raw
        n, size = 1, len(raw)
        for rec in itertools.chain(head, itertools.islice(records, frames - 1 - len(head)) if len(head) < frames - 1 else ()):
            frame = packer.compress(rec)
            yield frame
            n, size = n + 1, size + len(frame)
            if size >= most and n > len(head):
                yield from (GAP for _ in range(frames - n))
                break
        else:
            if n < frames:
                return


def write_partition(batches: Iterator[pa.RecordBatch], frames: int = FRAMES, most: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, payload, refers_to, revisit) to the frames of archives, as a column value."""

    def records() -> Iterator[bytes]:
        for b in batches:
            ids, urls, refs, revisits = (b.column(k).to_pylist() for k in ("page_id", "url", "refers_to", "revisit"))
            for i, payload in enumerate(b.column("payload")):
                raw = payload.as_py() or b""
                yield record(ids[i], urls[i], raw, digest(raw), refs[i], revisits[i])

    out, held = [], 0
    for frame in archived(records(), frames, most):
        out.append(frame)
        held += len(frame)
        if held > 1 << 22 or len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def records_of(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, by its own dictionary."""
    at, unpacker = 0, zstd.ZstdDecompressor()
    view = memoryview(raw)
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICT_MAGIC:
            unpacker = zstd.ZstdDecompressor(dict_data=_dictionary(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == 0xFD2FB528:
            one = unpacker.decompressobj()
            got = [one.decompress(view[at : at + (1 << 20)])]
            fed = min(len(view), at + (1 << 20))
            while not one.eof and fed < len(view):
                got.append(one.decompress(view[fed : fed + (1 << 20)]))
                fed = min(len(view), fed + (1 << 20))
            if not one.eof:
                raise ValueError("archive ends within a record")
            at = fed - len(one.unused_data)
            yield b"".join(got)
        elif view[at : at + 1] == b"\n":
            at += 1
        else:
            raise ValueError(f"not a Zstandard frame at byte {at}")


def parse(rec: bytes) -> dict:
    head, _, rest = rec.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in fields)
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1 = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != sha1):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload_bytes": size, "payload_digest": sha1, "refers_to": number(h["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
READ_DDL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read_partition(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            rows, held = [], 0
            for rec in records_of(content.as_buffer()):
                rows.append(parse(rec))
                held += len(rec)
                if not payloads:
                    rows[-1]["payload"] = None
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, READ)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, READ)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, frames: int = FRAMES, most: int = ARCHIVE_BYTES) -> None:
    """Archives of pages (page_id, url, html) below path, of at most so many frames and about so many bytes each.

    Of equal payloads of min_bytes or more, the one with the smallest page_id is the response, others revisit it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = rows.where(F.length("payload") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select("_sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    elected = rows.join(again, (rows["sha"] == again["_sha"]) & (rows["salt"] == again["_salt"]), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = elected.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    written = ready.mapInArrow(lambda bs: write_partition(bs, frames, most), "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", GAP.decode("latin-1")).option("maxRecordsPerFile", frames).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lambda bs: _read_partition(bs, payloads), READ_DDL)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).new("warc")
    write_archives(alone(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d GROUP BY s)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d JOIN f USING (s)
"""
QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {"op1_warc": SQL}
