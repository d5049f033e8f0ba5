"""WARC in seekable Zstandard bundles (operator 3).

Records are grouped into independent frames of about `FRAME_BYTES`; a bundle is a run of frames and a
footer in a skippable frame that lists the sizes of all frames, so any decoder reads the bundle as
one WARC file and a seeking reader goes straight to a frame. An index maps record identifiers to bundle, frame and
the offset in the decompressed frame.

Bundles travel as binary rows of a Parquet table in shared storage, which the job's commit protocol keeps whole when
executors are lost; `export` writes them as files. A row is at most about `BUNDLE_BYTES`, or one record.

Equal payloads of at least `least_payload` bytes are stored once: the row with the smallest id is a
response, the others are revisits that refer to it. Defined results: a null payload is empty; a null id
stays null, and revisits the smallest id with its payload, or is a response where no row with it has an
id; rows that repeat the smallest id are all responses; a null url has no target line, control characters
in one are percent-encoded; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import os
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, scratch, table

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 4 << 20
BROADCAST_ROWS = 50_000

# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_INDEX = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
BUNDLE = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("records", T.ArrayType(_INDEX))])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class BundleWriter:
    """Collects records into frames; `close` gives the bundle's bytes and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[dict] = []

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        frame = self.packer.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.bytes += len(frame)
        self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[dict]]:
        if self.open:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries)) + entries, self.index


class BundleReader:
    """Random access to the frames of a bundle by its footer."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        at = len(data) - 9 - count * width
        self.data, self.places, start = data, [], 0
        for k in range(count):
            packed, size = struct.unpack_from("<II", data, at + k * width)
            self.places.append((start, packed, size))
            start += packed

    def frame(self, k: int) -> bytes:
        start, packed, size = self.places[k]
        return zstandard.ZstdDecompressor().decompress(self.data[start : start + packed], max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _line(text: str) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def make_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the payload's length and digest, not its bytes."""
    block = _HTTP % len(payload) + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """Yields (headers, block) of the records of a decompressed frame or file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, block
        at = end + 8 + size


def _write(batches, date: str):
    task, made, seen = TaskContext.get().partitionId(), 0, 0
    schema = to_arrow_schema(BUNDLE)
    writer = BundleWriter()

    def flush() -> pa.RecordBatch:
        data, index = writer.close()
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([data], pa.binary()), pa.array([index], schema.field("records").type)], schema=schema)

    for batch in batches:
        ids, urls, payloads, digests, firsts = batch.columns
        for k in range(batch.num_rows):
            page, first = ids[k].as_py(), firsts[k].as_py()
            payload = payloads[k].as_py()
            record_id = f"urn:weftlink:{task}:{seen}"
            seen += 1
            refers = None if first is None or first == page else first
            writer.add(record_id, make_record(record_id, page, urls[k].as_py(), payload, digests[k].as_py(), refers, date))
            if writer.bytes >= BUNDLE_BYTES:
                yield flush()
                made += 1
                writer = BundleWriter()
    if writer.index:
        yield flush()


def write_bundles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_payload: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(bundle, data, records) of the archive, read back from shared storage."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    twice = rows.where(F.length("_payload") >= least_payload).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    twice = cut(twice.where((F.col("_n") > 1) & F.col("_first").isNotNull()).select(F.col("_digest").alias("_twin"), "_first"))
    # about 80 bytes a row: small lists go to every task, longer ones are joined by digest
    side = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    ready = rows.join(side, F.col("_digest") == F.col("_twin"), "left").select("_id", "_url", "_payload", "_digest", "_first")
    path = scratch(pages.sparkSession, "warc")
    ready.mapInArrow(lambda b: _write(b, date), BUNDLE).write.parquet(path)
    return pages.sparkSession.read.schema(BUNDLE).parquet(path)


_READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def _read(batches, with_payload: bool):
    schema = to_arrow_schema(_READ)
    for batch in batches:
        for item in batch.column(0):
            reader = BundleReader(item.as_py())
            for k in range(len(reader.places)):
                rows = []
                for headers, block in parse_records(reader.frame(k)):
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                    payload = None
                    if headers["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload differs from its digest")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                    rows.append((page and int(page), size, digest, headers["WARC-Type"], refers and int(refers), headers.get("WARC-Target-URI"), payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record, its payload checked against its digest."""
    return bundles.select("data").mapInArrow(lambda b: _read(b, with_payload), _READ)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset and length of every record."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as `<bundle>.warc.zst` below a folder that all executors mount; returns the paths."""

    def write(batches):
        for batch in batches:
            paths = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                paths.append(os.path.join(folder, f"{k:016x}.warc.zst"))
                with open(paths[-1] + ".part", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(paths[-1] + ".part", paths[-1])
            yield pa.RecordBatch.from_pydict({"path": paths})

    return bundles.select("bundle", "data").mapInArrow(write, "path string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
