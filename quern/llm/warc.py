"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of whole records, followed by two
skippable frames: the record index (record id, frame, offset in the frame, length) and the
seek table of the seekable format (sizes of all frames, then the number of frames, flags and
the magic number).  Any record is read by its frame alone.

Bundles are written through Spark's own commit protocol, so a lost executor leaves no half
bundle and any file system that Spark knows will do: each bundle is one row of a text file of
its own, and the line separator that ends a row is the seek table's closing magic number.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.spread import BROADCAST_BYTES, Spread
from quern.llm.vectext import as_bytes
from quern.scratch import materialize, new_path

# Fixed values of the seekable and skippable frame formats.
SEEK_FRAME, INDEX_FRAME, SEEK_END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_END = struct.pack("<I", SEEK_END)
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "1970-01-01T00:00:00Z"
#: What would end a header line, or be trimmed from it.
_CONTROL = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def uri(url: str) -> str:
    """``url`` with white space and control characters percent-encoded."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_id(url: str, page_id: object, copy: int) -> str:
    """A name-based id, so that a task that runs again writes the same record."""
    return uuid.uuid5(_NAMES, f"{url}#{page_id}#{copy}").hex


def record(kind: str, rid: str, url: str, page_id: object, digest: str, payload: bytes, full: int, first: tuple[object, str, str] | None = None) -> bytes:
    """One record; a revisit has the full payload's size and digest but no payload, and names the
    page id, record id and url of the ``first``."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(rid)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {full}",
    ]
    if first:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.UUID(first[1])}>",
            f"WARC-Refers-To-Target-URI: {uri(first[2])}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {'' if first[0] is None else first[0]}",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names, the version under "") and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {"": lines[0]} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Collects records; ``close`` gives the bundle's bytes."""

    def __init__(self, frame_bytes: int, zlevel: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=zlevel)
        self.out, self.frames, self.index = bytearray(), [], []
        self.frame = bytearray()

    def add(self, rid: str, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self._end_frame()
        self.index.append(bytes.fromhex(rid) + struct.pack("<IQQ", len(self.frames), len(self.frame), len(data)))
        self.frame += data

    def _end_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.frame))
        self.frames.append((len(packed), len(self.frame)))
        self.out += packed
        self.frame = bytearray()

    def __len__(self) -> int:
        return len(self.out) + len(self.frame)

    def close(self) -> bytes:
        if self.frame:
            self._end_frame()
        index = _skippable(INDEX_FRAME, b"".join(self.index))
        entries = [*self.frames, (len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IB", len(entries), 0) + _END
        return bytes(self.out) + index + _skippable(SEEK_FRAME, table)


class Reader:
    """Random access to a bundle's records through its footer."""

    def __init__(self, data: bytes):
        if data[-4:] != _END:
            raise ValueError("no seek table")
        count, flags = struct.unpack("<IB", data[-9:-4])
        if flags:
            raise ValueError("seek tables with checksums are not written here")
        entries = list(struct.iter_unpack("<II", data[len(data) - 9 - 8 * count : -9]))
        self.data, self.frames, at = data, [], 0
        for packed, size in entries:
            self.frames.append((at, packed, size))
            at += packed
        start, packed, _ = self.frames.pop()
        if struct.unpack("<II", data[start : start + 8]) != (INDEX_FRAME, packed - 8):
            raise ValueError("no record index")
        self.index = {bytes(r[:16]).hex(): struct.unpack("<IQQ", r[16:]) for r in (data[i : i + 36] for i in range(start + 8, start + packed, 36))}
        self._open: tuple[int, bytes] = (-1, b"")

    def get(self, rid: str) -> bytes:
        frame, offset, size = self.index[rid]
        if self._open[0] != frame:
            at, packed, full = self.frames[frame]
            self._open = frame, zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=full)
        return self._open[1][offset : offset + size]


def write(
    pages: DataFrame, path: str, least: int = 0, bundle_bytes: int = 8 << 20, frame_bytes: int = 256 << 10, part_rows: int = 20_000, broadcast_bytes: int = BROADCAST_BYTES
) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into bundles at ``path``.

    Payloads are the html in UTF-8, null as empty.  Of the rows with equal payloads of at least
    ``least`` bytes that with the largest page_id is a response and the others revisit it;
    smaller ones are all responses.  Ties (repeated page_ids) go to one of the rows; a null
    page_id is the smallest.  A null url is written as empty, white space and control characters
    of one percent-encoded.  A payload of any length is one record in a frame of its own.  An
    empty table writes no bundle; other columns are ignored.

    Rows are written once with their ids, so that these are the same wherever they are read.
    Only digests and ids meet by digest.  What is found of repeated payloads goes to the rows by
    broadcast if it is small in all (measured), otherwise payloads meet it by digest, those of
    more than ``part_rows`` copies in parts.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = materialize(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.coalesce("url", F.lit("")).alias("url"),
            F.monotonically_increasing_id().alias("copy"),
            payload.alias("payload"),
            F.unhex(F.sha1(payload)).alias("sha1"),
        ),
        "payloads",
    )
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max(F.struct("page_id", "copy", "url")).alias("first"), F.count("*").alias("weight"))
    repeated = materialize(repeated.where("weight > 1"), "repeated")
    beside = Spread(repeated.select("sha1", "weight"), "sha1", part_rows, broadcast_bytes)
    marked = beside.join(rows, repeated.select("sha1", "first"), "copy", F.octet_length("first.url") + 32)
    marked = marked.select("page_id", "url", "copy", "payload", "sha1", "first.page_id", "first.copy", "first.url").toDF(
        "page_id", "url", "copy", "payload", "sha1", "first_page", "first_copy", "first_url"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.close()], pa.binary())], ["value"])
        for batch in batches:
            columns = (as_bytes(c) if i == 3 else c.to_pylist() for i, c in enumerate(batch.columns))
            for page_id, url, copy, data, sha1, first_page, first_copy, first_url in zip(*columns, strict=True):
                rid, digest = record_id(url, page_id, copy), base64.b32encode(sha1).decode()
                if first_copy is None or first_copy == copy:
                    bundle.add(rid, record("response", rid, url, page_id, digest, data, len(data)))
                else:
                    first = first_page, record_id(first_url, first_page, first_copy), first_url
                    bundle.add(rid, record("revisit", rid, url, page_id, digest, b"", len(data), first))
                if len(bundle) >= bundle_bytes:
                    yield give()
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield give()

    bundles = marked.mapInArrow(run, T.StructType([T.StructField("value", T.BinaryType())]))
    (
        bundles.select(F.expr("cast(substring(value, 1, length(value) - 4) as string)").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _END.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


_READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all bundles at ``path``: every one is found by its id through the
    footer, parsed, and a response's payload checked against its size and digest."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                reader, rows = Reader(data), []
                for rid in reader.index:
                    fields, payload = parse(reader.get(rid))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size, kind = int(fields["x-payload-length"]), fields["warc-type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record {rid} is damaged")
                    number = lambda k: int(fields[k]) if fields.get(k) else None
                    rows.append((number("x-page-id"), fields["warc-target-uri"], rid, kind, size, digest, number("x-refers-to-page-id"), _plain_id(fields.get("warc-refers-to")), payload))
                    if len(rows) == 1024:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, _READ)


def _plain_id(urn: str | None) -> str | None:
    return urn and uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).hex


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _READ.names)


def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write(pages, path)
    rows = read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return materialize(rows, "records")


#: DuckDB has SHA-1 as hexadecimal; four base32 digits come from each five of its digits.
OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
