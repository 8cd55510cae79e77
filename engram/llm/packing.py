"""Operator 5: best-fit packing after Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``capacity`` ids; pieces are packed
into sequences.  How to pack depends only on how many pieces there are of each
length, so the plan is made on that histogram, of at most ``capacity`` rows
whatever the corpus' size:

* reduction: for a piece ``j`` a set of at most two others that provably
  dominates every other filling of ``j``'s sequence is fixed for good - no other
  piece fits; one fills the rest exactly; only one more fits, so the largest that
  does; two more fit at most and the chosen ones majorise all others;
* best fit decreasing over what is left, whole length classes at a time: a class
  goes to the open sequences with the least room that holds it.

A piece finds its place from its rank within its length.  Ranks are counted
within ``SALTS`` shards of a length and moved up by the shards before, so a
length that a third of the rows share is no single task's work.

Null texts are empty and give one piece, the end id.  Repeated rows are packed
as separate documents with equal (doc_id, piece).  An empty table gives no rows.
Extra columns are not carried.  A null doc_id is kept as null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged
from .token_store import encoder

#: Shards of a length for counting ranks.
SALTS = 64


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, spaced: bool = True, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece (little-endian u32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        for batch in slices(batches, "text"):
            ids, offsets = enc.batch(batch["text"])
            ended = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
            n = np.diff(offsets) + 1
            first = np.where(n > capacity, np.where(n % capacity, n % capacity, capacity), n)
            pieces = 1 + (n - first) // capacity
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            at = (np.cumsum(n) - n)[row] + start
            raw = memoryview(ended).cast("B")
            parts = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            out = {"doc_id": batch["doc_id"].cast(pa.int64()).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)
        enc.settle()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Histogram:
    """Counts by length, with the lengths in use in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """The largest length up to ``most`` of which a piece is left besides those named."""
        at = bisect_right(self.lengths, most) - 1
        while at >= 0 and self.n[self.lengths[at]] <= without.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def smallest(self, k: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(k - len(out), self.n[length] - without.get(length, 0))
            if len(out) >= k:
                break
        return out


def dominating(h: Histogram, j: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of a piece of length ``j`` that dominate all other sets with it; None if none is proved."""
    room, own = capacity - j, {j: 1}
    few = h.smallest(3, own)
    if not few or few[0] > room:
        return ()
    best = h.largest(room, own)
    if best == room or len(few) < 2 or few[0] + few[1] > room:
        return (best,)
    if len(few) < 3 or sum(few) > room:  # two more at most: (best, a) majorises any pair x <= y if a >= x
        with_best = h.largest(room - best, own | {best: 1 + own.get(best, 0)})
        inner = h.largest(room // 2, own)
        if with_best is not None and (inner is None or with_best >= inner):
            return (best, with_best)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, how many in each)]) patterns that together hold every piece."""
    h, done = Histogram(counts), []
    for j in sorted(h.n, reverse=True):
        while j in h.n:
            partners = dominating(h, j, capacity)
            if partners is None:
                break
            need: dict[int, int] = {}
            for length in (j, *partners):
                need[length] = need.get(length, 0) + 1
            times = min(h.n[length] // k for length, k in need.items())
            if len(partners) == 2:
                times = 1 if len(need) < 3 else times
            for length, k in need.items():
                h.take(length, k * times)
            done.append((times, sorted(need.items(), reverse=True)))
    open_: dict[int, list[tuple[int, list]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, items: list) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((count, items))

    for length in reversed(h.lengths):
        left = h.n[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = min(capacity // length, left)
                count = left // per
                put(capacity - per * length, count, [(length, per)])
                left -= count * per
                continue
            room = rooms[at]
            count, items = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            per = min(room // length, left)
            used = min(count, left // per)
            if used < count:
                put(room, count - used, items)
            put(room - per * length, used, [*items, (length, per)])
            left -= used * per
    return done + [group for room in rooms for group in open_[room]]


def slots(patterns: list) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length the runs of ranks (first rank, end rank, pieces a sequence, first sequence, offset)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, items in patterns:
        offset = 0
        for length, per in items:
            first = used.get(length, 0)
            used[length] = first + count * per
            out.setdefault(length, []).append((first, used[length], per, sequence, offset))
            offset += length * per
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset added.

    ``pieces`` is read twice, so give a written table.
    """
    spark = pieces.sparkSession
    # equal rows share a salt, as row_number tells them apart within it
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    cells = counts.collect()  # at most capacity x SALTS rows
    total: dict[int, int] = {}
    before = []
    for row in sorted(cells, key=lambda r: (r.length, r._salt)):
        before.append((row.length, row._salt, total.get(row.length, 0)))
        total[row.length] = total.get(row.length, 0) + row._n
    found = slots(plan(total, capacity))
    shards = spark.createDataFrame(before, "length long, _salt int, _before long")
    runs = spark.createDataFrame(list(found.items()), "length long, _runs array<struct<first:long,until:long,per:long,sequence:long,at:long>>")
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    placed = ranked.join(F.broadcast(shards), ["length", "_salt"]).join(F.broadcast(runs), "length")
    placed = placed.withColumn("_rank", F.col("_before") + F.col("_k"))
    placed = placed.withColumn("_run", F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["until"]))[0])
    within = F.col("_rank") - F.col("_run.first")
    return placed.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(within / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.at") + within % F.col("_run.per") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, spaced: bool = True) -> DataFrame:
    """Cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(token_pieces(docs, tokenizer, capacity, end_id, spaced), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, spaced: bool = True) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids, ids (little-endian u32).  doc_id must be unique."""
    ids = token_pieces(docs, tokenizer, capacity, end_id, spaced, with_ids=True).select("doc_id", "piece", "ids")
    both = placed.select("doc_id", "piece", "length", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity ids
    grouped = both.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), members.alias("m"))
    joined = F.aggregate("m", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", F.transform("m", lambda x: x["doc_id"]).alias("doc_ids"), joined.alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
