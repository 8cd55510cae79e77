"""Operator 3: token ids in directly addressable code (DAC) files.

Each id is cut into ``CHUNK``-bit chunks, lowest first.  Level ``k`` holds the
``k``-th chunk of every id that has one, packed, with a bitmap that says for
which of them a chunk follows at level ``k + 1``.  The rank of a set bit in that
bitmap is the id's place at the next level; a directory of cumulative set bits
for each 512-bit block makes rank a table look-up and popcounts within a block.  ``DacReader``
reads any token, or the ids of any document, by ranged reads at computed places.

File layout (little endian)::

    magic 'EDAC' | version u8 | chunk bits u8 | levels u16 | tokens u64 | documents u64
    per level: entries u64, bytes of chunks u64
    doc ids i64[documents] | doc ends u64[documents]
    per level: chunks (u8 or u16 each) | bitmap u64[] | directory u32[]
    version 2 only: documents without a doc_id u64 (the last ones; 0 stands in doc ids)

Writing is one range exchange by ``doc_id`` so that files hold ascending ids and
follow each other in order; a small table of files carries the running total
from which every document's global start is read.

Null texts are empty: such a document holds just the end id.  Repeated doc_ids
are kept as separate rows.  A null doc_id is kept and ranks last.  An empty table makes no files and an empty result.
Extra columns are not carried.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, parts_of, slices, written
from .tokens import Encoder

MAGIC = b"EDAC"
CHUNK = 8
BLOCK = 512
HEAD = struct.Struct("<4sBBHQQ")
LEVEL = struct.Struct("<QQ")
NULLS = struct.Struct("<Q")


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path, spaced)


def dac_encode(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, nulls: int = 0) -> bytes:
    """One file's bytes: ``ids`` of all documents, where each document ends in them, and how many of the last have no doc_id."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = (rest >> CHUNK) != 0
        bits = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, bool)
        bits[: len(rest)] = more
        ones = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(((rest & ((1 << CHUNK) - 1)).astype("u1"), np.packbits(bits, bitorder="little").view("<u8"), directory))
        rest = rest[more] >> CHUNK
        if not len(rest):
            break
    out = [HEAD.pack(MAGIC, 2 if nulls else 1, CHUNK, len(levels), len(ids), len(doc_ids))]
    out += [LEVEL.pack(len(c), c.nbytes) for c, _, _ in levels]
    out += [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(ends, "<u8").tobytes()]
    for chunks, bitmap, directory in levels:
        out += [chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
    if nulls:
        out.append(NULLS.pack(nulls))
    return b"".join(out)


class DacFile:
    """Random access to a file's ids; ``data`` is its bytes or a memory map of them."""

    def __init__(self, data):
        magic, version, self.chunk, n, self.tokens, docs = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a DAC file")
        at = HEAD.size
        sizes = [LEVEL.unpack_from(data, at + LEVEL.size * k) for k in range(n)]
        at += LEVEL.size * n
        view = lambda kind, count: np.frombuffer(data, kind, count, at)
        self.doc_ids = view("<i8", docs)
        at += 8 * docs
        self.ends = view("<u8", docs).astype(np.int64)
        at += 8 * docs
        self.levels = []
        for entries, size in sizes:
            chunks = view("u1", entries)
            at += size
            blocks = -(-max(entries, 1) // BLOCK)
            bitmap = view("<u8", blocks * BLOCK // 64)
            at += bitmap.nbytes
            directory = view("<u4", blocks + 1)
            at += directory.nbytes
            self.levels.append((chunks, bitmap, directory))
        self.nulls = NULLS.unpack_from(data, at)[0] if version == 2 else 0

    def get(self, places) -> np.ndarray:
        """Ids at any places, each found by ranks alone."""
        places = np.asarray(places, np.int64)
        out, live, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for chunks, bitmap, directory in self.levels:
            out[live] |= chunks[places].astype(np.uint32) << np.uint32(shift)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            on = (bitmap[word] >> bit) & np.uint64(1) == 1
            live, places, word, bit = live[on], places[on], word[on], bit[on]
            if not len(live):
                break
            below = np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            per = BLOCK // 64
            inside = word % per
            for back in range(1, per):
                near = inside >= back
                below[near] += np.bitwise_count(bitmap[word[near] - back])
            places = directory[places // BLOCK].astype(np.int64) + below
            shift += self.chunk
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's ``k``-th document."""
        return self.get(np.arange(self.ends[k - 1] if k else 0, self.ends[k]))


class DacReader:
    """Ids of a file by ranged reads of an open, seekable one: the header once, then for each level a byte for each id, the
    bitmap's words there and in the rest of their block before, and one directory entry."""

    def __init__(self, file):
        self.file = file
        magic, _, self.chunk, n, self.tokens, self.docs = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a DAC file")
        sizes = self._read(HEAD.size, LEVEL.size * n)
        self.ends_at = HEAD.size + LEVEL.size * n + 8 * self.docs
        at, self.levels = self.ends_at + 8 * self.docs, []
        for k in range(n):
            entries, size = LEVEL.unpack_from(sizes, LEVEL.size * k)
            blocks = -(-max(entries, 1) // BLOCK)
            self.levels.append((at, at + size, at + size + blocks * BLOCK // 8))  # chunks, bitmap, directory
            at += size + blocks * BLOCK // 8 + 4 * (blocks + 1)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at the places from ``start`` up to ``end``; at each level they stand side by side."""
        if not 0 <= start <= end <= self.tokens:
            raise IndexError((start, end))
        out, live, shift = np.zeros(end - start, np.uint32), np.arange(end - start), 0
        for chunks, bitmap, directory in self.levels:
            out[live] |= np.frombuffer(self._read(chunks + start, end - start), "u1").astype(np.uint32) << np.uint32(shift)
            block = start // BLOCK
            words = np.frombuffer(self._read(bitmap + block * BLOCK // 8, 8 * (-(-end // 64)) - block * BLOCK // 8), "u1")
            bits = np.unpackbits(words, bitorder="little")
            more = bits[start - block * BLOCK : end - block * BLOCK] == 1
            if not more.any():
                break
            before = int.from_bytes(self._read(directory + 4 * block, 4), "little") + int(bits[: start - block * BLOCK].sum())
            live, start, end, shift = live[more], before, before + int(more.sum()), shift + self.chunk
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's ``k``-th document."""
        first = max(k - 1, 0)
        ends = np.frombuffer(self._read(self.ends_at + 8 * first, 8 * (k - first + 1)), "<u8").astype(np.int64)
        return self.ids(int(ends[0]) if k else 0, int(ends[-1]))


def write_bytes(uri: str, data: bytes) -> None:
    """Write through a temporary name, so that a file under its own name is whole; a task run again replaces it."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    attempt = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with store.open_output_stream(attempt) as f:
        f.write(data)
    store.move(attempt, path)


def read_bytes(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def open_file(uri: str):
    """A file open for reading at any place."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, spaced: bool = False, file_tokens: int = 8_000_000) -> DataFrame:
    """Write ``docs`` (doc_id, text) as DAC files under ``folder``; returns the table of files
    (file, part, seq, first_doc, n_docs, n_tokens), written beside them.

    Files close at ``file_tokens`` ids, which bounds a task's memory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0
        enc = encoder(tokenizer, spaced)

        def close():
            ids = np.concatenate([x[0] for x in held])
            doc_ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            nulls = sum(x[3] for x in held)
            name = f"{folder}/files/part-{part:06d}-{seq:05d}.dac"
            write_bytes(name, dac_encode(ids, doc_ids, ends, nulls))
            row = {"file": [name], "part": [part], "seq": [seq], "first_doc": [int(doc_ids[0]) if nulls < len(doc_ids) else None], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in slices(batches, "text"):
            ids, offsets = enc.batch(batch["text"])
            ended = np.insert(ids, offsets[1:], np.uint32(end_id))
            named = pc.fill_null(batch["doc_id"].cast(pa.int64()), 0).to_numpy()
            held.append((ended, named, np.diff(offsets) + 1, batch["doc_id"].null_count))
            count += len(ended)
            if count >= file_tokens:
                yield close()
                seq, held, count = seq + 1, [], 0
        if held:
            yield close()

    # rows without a doc_id are dealt by their texts, as they may be many
    order = [F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts_of(docs.sparkSession), *order).sortWithinPartitions(*order)
    files = ordered.mapInArrow(write, "file string, part int, seq int, first_doc long, n_docs long, n_tokens long")
    return written(files, f"{folder}/index")


def read_store(files: DataFrame, buffer: int = 500_000) -> DataFrame:
    """Read documents back: doc_id, start (ids before it in the whole store), n_tokens, tokens_le (ids as
    little-endian u32 bytes).  The running total is taken over the table of files, one row a file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                dac = DacFile(read_bytes(name))
                none = np.arange(len(dac.doc_ids)) >= len(dac.doc_ids) - dac.nulls
                starts = np.concatenate([[0], dac.ends[:-1]]).astype(np.int64)
                lo = 0
                while lo < len(starts):
                    hi = max(lo + 1, int(np.searchsorted(dac.ends, starts[lo] + buffer, "right")))
                    ids = dac.get(np.arange(starts[lo], dac.ends[hi - 1])).astype("<u4")
                    cuts = np.concatenate([starts[lo:hi], dac.ends[hi - 1 : hi]]) - starts[lo]
                    raw = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(dac.doc_ids[lo:hi], mask=none[lo:hi]), pa.array(starts[lo:hi] + base), pa.array(np.diff(cuts)), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "tokens_le"])
                    lo = hi

    return placed.repartition(parts_of(files.sparkSession), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, tokens_le binary")


def token(files: DataFrame, place: int) -> int:
    """The id at a global place: the table of files names the file, of which some bytes at computed places are read."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq"))  # one row a file
    held = files.select("file", "n_tokens", before.alias("until")).where((F.col("until") > place) & (F.col("until") - F.col("n_tokens") <= place)).first()
    if held is None or place < 0:
        raise IndexError(place)
    with open_file(held.file) as f:
        at = place - (held.until - held.n_tokens)
        return int(DacReader(f).ids(at, at + 1)[0])


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: encode ``documents``, write DAC files, read them back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "dac"))
    return read_store(files).select("doc_id", "start", "n_tokens", F.crc32("tokens_le").alias("ids_crc32"))
