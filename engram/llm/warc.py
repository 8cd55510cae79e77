"""Operator 10: WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC
records up to ``frame_bytes``, then two skippable frames: a record index (record
id, frame, offset within the frame, length) and, last, a seek table of frame
sizes with a fixed footer.  A reader finds the table from the file's end, and a
record from its frame alone; any Zstandard tool can also expand the bundle as
one WARC stream.

Payload duplicates of at least ``least`` bytes become ``revisit`` records that
refer to the response with the smallest id.  The digests are grouped with
partial aggregation and only ids of revisits are joined back, on the unique id,
so a payload that a third of the rows share is never gathered.

A null payload is empty; a null URL is written as an empty target.  Rows without
a page_id have no record id and are left out; rows that repeat a page_id are each
written, those of a duplicated payload as its response.  An empty table writes
no bundle.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, parts_of, slices, written
from .token_store import open_file, write_bytes

# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
INDEX = 0x184D2A5D
HEAD = struct.Struct("<II")
FRAME = struct.Struct("<II")
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("record", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])


def warc_record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no block, but the digest and length of what it stands for."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview | bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    data = bytes(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """Collects records in memory, frame by frame, up to a bundle."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.codec = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.entries: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, record_id: int, record: bytes) -> None:
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.close_frame()
        self.entries.append((record_id, len(self.frames), self.filled, len(record)))
        self.open.append(record)
        self.filled += len(record)

    def close_frame(self) -> None:
        if self.open:
            packed = self.codec.compress(b"".join(self.open))
            self.out.append(packed)
            self.size += len(packed)
            self.frames.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        index = np.array(sorted(self.entries), ENTRY).tobytes()
        table = b"".join(FRAME.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE)
        return b"".join([*self.out, HEAD.pack(INDEX, len(index)), index, HEAD.pack(SKIPPABLE, len(table)), table])


class Bundle:
    """Reads an open, seekable bundle by ranges: its seek table and index from the end, then single frames."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        n, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        table = self._read(size - FOOTER.size - n * FRAME.size, n * FRAME.size)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 2)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        kind, length = HEAD.unpack(self._read(int(self.starts[-1]), HEAD.size))
        if kind != INDEX:
            raise ValueError("no record index after the frames")
        self.index = np.frombuffer(self._read(int(self.starts[-1]) + HEAD.size, length), ENTRY)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        raw = self._read(int(self.starts[k]), int(self.frames[k, 0]))
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(self.frames[k, 1]))

    def record(self, record_id: int) -> list[tuple[dict[str, str], bytes]]:
        """All records of an id: one frame is read and expanded for each."""
        lo, hi = np.searchsorted(self.index["record"], [record_id, record_id + 1])
        return [parse_record(self.frame(int(e["frame"]))[e["offset"] : e["offset"] + e["length"]]) for e in self.index[lo:hi]]

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        order = np.lexsort((self.index["offset"], self.index["frame"]))
        last, data = -1, b""
        for e in self.index[order]:
            if e["frame"] != last:
                last, data = e["frame"], self.frame(int(e["frame"]))
            yield int(e["record"]), *parse_record(memoryview(data)[e["offset"] : e["offset"] + e["length"]])


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id and refers_to of the rows that become revisits."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.where("page_id is not null").select("page_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.length(body).alias("n")).where(F.col("n") >= least)
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    return digests.join(firsts, "digest").where("page_id > refers_to").select("page_id", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str, least: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the table of bundles
    (file, n_records, n_frames, first_page, last_page) written beside them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        made = BundleWriter(frame_bytes)

        def close():
            name = f"{folder}/bundles/part-{part:06d}-{seq:05d}.warc.zst"
            data = made.finish()
            ids = [e[0] for e in made.entries]
            write_bytes(name, data)
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(ids)], pa.int64()), "n_frames": pa.array([len(made.frames)], pa.int64()), "first_page": pa.array([min(ids)], pa.int64()), "last_page": pa.array([max(ids)], pa.int64())})

        for batch in slices(batches, "html"):
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (row[2] or "").encode()
                made.add(row[0], warc_record(row[0], row[1] or "", payload, hashlib.sha256(payload).hexdigest(), row[3]))
                if made.size >= bundle_bytes:
                    yield close()
                    made, seq = BundleWriter(frame_bytes), seq + 1
        if made.entries:
            yield close()

    marked = pages.select("page_id", "url", "html").where("page_id is not null").join(revisits(pages, least), "page_id", "left")
    dealt = marked.repartition(parts_of(pages.sparkSession), "page_id").sortWithinPartitions("page_id")
    bundles = dealt.mapInArrow(write, "file string, n_records long, n_frames long, first_page long, last_page long")
    return written(bundles, f"{folder}/index")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload
    (null for a revisit).  A response's digest and size are taken from its block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows, held, file = [], 0, open_file(name)
                for page_id, head, block in Bundle(file).records():
                    if head["WARC-Type"] == "response":
                        rows.append((page_id, head["WARC-Target-URI"], "response", len(block), hashlib.sha256(block).hexdigest(), None, block))
                    else:
                        rows.append((page_id, head["WARC-Target-URI"], "revisit", int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Refers-To"][10:-1]), None))
                    held += len(block)
                    if held >= 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                file.close()

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return bundles.select("file").repartition(parts_of(bundles.sparkSession), "file").mapInArrow(read, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bundles = write_bundles(pages, new_folder(spark, "warc"))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d
  FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT d, min(page_id) AS first_page FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id > f.first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id > f.first_page THEN f.first_page END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
