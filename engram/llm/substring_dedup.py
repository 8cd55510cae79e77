"""Operator 1: repeated byte strings removed by bucket-pointer refinement.

Every ``LENGTH``-byte string of a document that also starts in a document with a
smaller doc_id is removed.  The suffixes' buckets are made and refined as far as
it takes to tell ``LENGTH`` bytes apart:

1. *Buckets.*  A window of ``LENGTH`` bytes is put in the bucket of the smallest
   hash among its ``GRAM``-byte grams, which depends on the window alone.
   Neighbouring windows mostly share it, so a document has a row for each run of
   windows in one bucket, with a hash of the run's windows.  Runs equal to one of a
   smaller document in the same task are settled there, so that a bucket of very
   many documents is a few rows of each task.  Buckets of a single
   document are done.  In a bucket, runs equal to one of a smaller document are
   covered whole; only the first run of each kind, where there are several kinds,
   needs refinement.
2. *Refinement.*  The bytes of those runs are gathered by bucket.  Initial bucket
   ids are the ranks of 8-byte grams; ids of 16, 32 and then ``LENGTH`` bytes come
   from sorting pairs of an id and the id at a later offset, each level reusing the
   ids just made.  Equal final ids are equal strings, exactly.  Buckets with more
   than ``HOT`` runs go in single windows, keyed by the window's hash, so that no
   task holds a bucket that grows with the corpus.
3. *Removal.*  Covered spans are united for each document and cut out.

Documents are UTF-8 bytes; null is empty.  A document's own repeats stay.  Rows
that share a doc_id don't affect one another.  Documents without a doc_id are left
as they are and matter to none.  An empty table gives no rows.  Other columns are
carried unchanged by ``dedup_substrings``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, Earliest, finish, fresh, parts_of, slices, staged

LENGTH = 50
GRAM = 20
#: Runs in a bucket beyond which it is refined by single windows.
HOT = 4096
#: Windows of a run at most; repetitive text would make longer ones.
LONGEST = 256
#: Bytes hashed at once; the hashes take about a hundred times as much.
SLICE = 1 << 19


def contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each in them)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over each ``width`` neighbours, by doubling."""
    n = 1
    while n * 2 <= width:
        x = least(x[:-n], x[n:])
        n *= 2
    return least(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def gram_hashes(raw: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all grams of each size, from shared powers of two."""
    powers, mult, n = {1: finish(raw.astype(np.uint64) + np.uint64(1))}, {1: np.uint64(0x9E3779B97F4A7C15)}, 1
    while n * 2 <= max(sizes):
        h = powers[n]
        powers[2 * n], mult[2 * n] = h[:-n] * mult[n] + h[n:], mult[n] * mult[n]
        n *= 2
    out = []
    for size in sizes:
        count, h, done = len(raw) - size + 1, None, 0
        for n in sorted(powers, reverse=True):
            if done + n <= size:
                part = powers[n][done : done + count]
                h, done = part if h is None else h * mult[n] + part, done + n
        out.append(finish(h))
    return out


def bucket_runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, bucket, start, windows, hash of the windows) of each run, and the window hashes."""
    if len(raw) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    grams, windows = gram_hashes(raw, (GRAM, LENGTH))
    bucket = slide(grams, LENGTH - GRAM + 1, np.minimum)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = doc[: len(windows)]
    whole = first == doc[LENGTH - 1 :]
    begins = np.ones(len(windows), bool)
    begins[1:] = (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | ~whole[:-1]
    at = np.arange(len(windows))
    begins |= (at - np.maximum.accumulate(np.where(begins, at, 0))) % LONGEST == 0
    start = np.flatnonzero(begins & whole)
    breaks = np.flatnonzero(begins | ~whole)
    end = np.append(breaks, len(windows))[np.searchsorted(breaks, start, "right")]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(windows)])
    kind = finish(total[end] - total[start] + (end - start).astype(np.uint64))
    return first[start], (bucket[start] >> np.uint64(1)).view(np.int64), start, end - start, kind.view(np.int64), windows.view(np.int64)


def run_ids(texts: pa.Array, raw: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names of runs that also tell texts under one doc_id apart: crc32 of the text, then the run's number."""
    view = memoryview(np.ascontiguousarray(raw))
    crc = np.array([zlib.crc32(view[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.int64)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return (crc[doc] << 29) | number


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, kind, run.  A run that equals one of a smaller document of the same task has a negative number as bucket."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Earliest()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", SLICE):
                raw, bounds = contents(batch["text"])
                doc, bucket, _, _, kind, _ = bucket_runs(raw, bounds)
                ids, run = batch["doc_id"].cast(pa.int64()).to_numpy()[doc], run_ids(batch["text"], raw, bounds, doc)
                own = finish(ids.view(np.uint64) * MIX + run.view(np.uint64)) | np.uint64(1 << 63)
                bucket = np.where(met.of(bucket, kind, ids) < ids, own.view(np.int64), bucket)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bucket), pa.array(kind), pa.array(run)], ["doc_id", "bucket", "kind", "run"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(find, "doc_id long, bucket long, kind long, run long")


def judged_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the codes of its runs that are covered (0), to refine (1), or to refine by windows (2): run * 4 + what."""
    bucket, kind = Window.partitionBy("bucket"), Window.partitionBy("bucket", "kind")
    rows = runs(docs).select(
        "*",
        *(f(c).over(bucket).alias(n) for f, c, n in ((F.min, "doc_id", "d0"), (F.max, "doc_id", "d1"), (F.min, "kind", "k0"), (F.max, "kind", "k1"), (F.count, "run", "size"))),
    )
    shared = rows.where("bucket < 0 or d0 < d1").withColumn("covered", (F.col("bucket") < 0) | (F.col("doc_id") > F.min("doc_id").over(kind)))
    what = F.when(F.col("covered"), 0).when(F.col("size") <= HOT, 1).otherwise(2)
    return shared.where("covered or k0 < k1").select("doc_id", (F.shiftleft("run", 2) + what).alias("code")).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))


def spread(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows (key, doc_id, crc, start, data): without a key, ``data`` holds spans covered; else bytes to refine."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", SLICE):
                raw, bounds = contents(batch["text"])
                doc, bucket, start, count, _, windows = bucket_runs(raw, bounds)
                names = run_ids(batch["text"], raw, bounds, doc)
                lists = batch["codes"]
                offsets = lists.offsets.to_numpy().astype(np.int64)
                codes = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
                place = {}
                for d in np.unique(owner):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    own = codes[offsets[d] - offsets[0] : offsets[d + 1] - offsets[0]]
                    at = lo + np.searchsorted(names[lo:hi], own >> 2)
                    good = at < hi
                    good[good] = names[at[good]] == own[good] >> 2
                    place[d] = (at[good], own[good] & 3)
                keys, ids, crcs, starts, data = [], [], [], [], []
                doc_ids, whole = batch["doc_id"].to_pylist(), raw.tobytes()
                for d, (at, what) in place.items():
                    if not len(at):
                        continue
                    crc, base = int(names[at[0]] >> 29), int(bounds[d])
                    done = at[what == 0]
                    if len(done):
                        done = np.unique(done)
                        spans = np.stack([start[done] - base, start[done] - base + count[done] + LENGTH - 1], axis=1).astype("<i8")
                        keys.append(None), ids.append(doc_ids[d]), crcs.append(crc), starts.append(0), data.append(spans.tobytes())
                    for r in np.unique(at[what == 1]).tolist():
                        a, n = int(start[r]), int(count[r])
                        keys.append(int(bucket[r])), ids.append(doc_ids[d]), crcs.append(crc), starts.append(a - base), data.append(whole[a : a + n + LENGTH - 1])
                    for r in np.unique(at[what == 2]).tolist():
                        for a in range(int(start[r]), int(start[r] + count[r])):
                            keys.append(int(windows[a])), ids.append(doc_ids[d]), crcs.append(crc), starts.append(a - base), data.append(whole[a : a + LENGTH])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(crcs, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["key", "doc_id", "crc", "start", "data"])

    return docs.select("doc_id", "text").join(judged, "doc_id").mapInArrow(cut, "key long, doc_id long, crc long, start long, data binary")


def refine(doc: np.ndarray, start: np.ndarray, data: list[bytes]) -> np.ndarray:
    """(row, window) pairs whose LENGTH bytes also stand in a row of a smaller document, by refined bucket ids."""
    sizes = np.array([len(x) for x in data])
    raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    n = len(raw) - 8
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams = (grams << np.uint64(8)) | raw[k : k + n]
    ids, width = np.unique(grams, return_inverse=True)[1], 8
    while width < LENGTH:
        step = min(width, LENGTH - width)
        later = np.zeros(n, np.int64)
        later[: n - step] = ids[step:]
        ids = np.unique(ids.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64), return_inverse=True)[1]
        width += step
    row = np.repeat(np.arange(len(data)), sizes)
    within = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = within <= sizes[row] - LENGTH
    row, within, ids = row[real], within[real], ids[real]
    least = np.full(ids.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, ids, doc[row])
    hit = doc[row] > least[ids]
    return np.stack([row[hit], within[hit]], axis=1)


def refined(rows: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, crc, data (spans) from the rows with bytes to refine."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, seen, size = None, {}, 0

        def done():
            doc, start = np.array([h[0] for h in held]), np.array([h[2] for h in held])
            found = refine(doc, start, [h[3] for h in held])
            out: dict[tuple, list] = {}
            for r, w in found.tolist():
                out.setdefault((held[r][0], held[r][1]), []).append((start[r] + w, start[r] + w + LENGTH))
            return out

        def batch_of(out):
            return pa.RecordBatch.from_pydict({"doc_id": pa.array([k[0] for k in out], pa.int64()), "crc": pa.array([k[1] for k in out], pa.int64()), "data": pa.array([united(np.array(v)).astype("<i8").tobytes() for v in out.values()], pa.binary())})

        for batch in batches:
            streamed: dict[tuple, list] = {}
            for key, doc, crc, start, data in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "crc", "start", "data")), strict=True):
                if key != last:
                    if size >= batch_bytes:
                        yield batch_of(done())
                        held, size = [], 0
                    last, seen = key, {}
                if len(data) == LENGTH:  # a window by itself: rows come by doc_id, so the first seen is the smallest
                    first = seen.setdefault(data, doc)
                    if first < doc:
                        streamed.setdefault((doc, crc), []).append((start, start + LENGTH))
                    if first < doc or len(seen) > HOT:
                        continue
                held.append((doc, crc, start, data))
                size += len(data)
            if streamed:
                yield batch_of(streamed)
        if held:
            yield batch_of(done())

    keyed = rows.where("key is not null")
    dealt = keyed.repartition(parts_of(rows.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(compare, "doc_id long, crc long, data binary")


def united(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begins = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(begins)
    return np.stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, crc (of the text's bytes) and the spans to remove, as little-endian pairs of 64-bit numbers."""
    rows = staged(spread(docs, staged(judged_runs(docs), "runs")), "buckets")
    found = rows.where("key is null").select("doc_id", "crc", "data").unionByName(refined(rows))
    return staged(found.groupBy("doc_id", "crc").agg(F.collect_list("data").alias("data")), "spans")


def added(columns: list[str]) -> list[str]:
    """Names of the columns that ``dedup_substrings`` adds to ``columns``: kept, n_bytes, n_removed, n_spans, where they are free."""
    return fresh(columns, "kept", "n_bytes", "n_removed", "n_spans")


def dedup_substrings(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with kept, n_bytes, n_removed and n_spans added, under the names of ``added``.

    kept is the remaining bytes, or with ``as_text`` a string of them, without what is left of a character cut through.
    """
    names, new = docs.columns, added(docs.columns)
    crcs, spans = fresh([*names, *new], "crcs", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, counts = [], []
            for t, cs, ds in zip(*(batch[c].to_pylist() for c in ("text", crcs, spans)), strict=True):
                raw = (t or "").encode()
                own = [np.frombuffer(x, "<i8").reshape(-1, 2) for c, d in zip(cs or (), ds or (), strict=True) if c == zlib.crc32(raw) for x in d]
                gone = united(np.concatenate(own)) if own else np.zeros((0, 2), np.int64)
                parts, at = [], 0
                for a, b in gone.tolist():
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                counts.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone)))
            numbers = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(kept, pa.string() if as_text else pa.binary()), *map(pa.array, numbers.T)], [*names, *new])

    by_doc = removed_spans(docs).groupBy("doc_id").agg(F.collect_list("crc").alias("c"), F.collect_list("data").alias("s"))
    by_doc = by_doc.select(F.col("doc_id").alias("found_for"), "c", "s").alias("by_doc")
    both = docs.alias("docs").join(by_doc, F.col("docs.doc_id") == F.col("by_doc.found_for"), "left")
    both = both.select(*(F.col(f"docs.`{c}`") for c in names), F.col("by_doc.c").alias(crcs), F.col("by_doc.s").alias(spans))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    kinds = ("string" if as_text else "binary", "long", "long", "long")
    return both.mapInArrow(cut, ", ".join([schema, *(f"`{c}` {t}" for c, t in zip(new, kinds, strict=True))]))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
