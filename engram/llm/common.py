"""What the corpus operators share: the shared folder, written stages, batch slicing."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import small_side as small_side

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session (tests) may leave it out; it gets a folder of its own."""
    named = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SHARED} is not set: name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of its own in the shared one."""
    return f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex}"


#: Spark's setting for deleting an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` and read it back.  The write's shuffle files go when it has ended, as nothing needs them then."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a later stage starts from the
    written table, so a lost executor costs no recomputation of what stands before it."""
    return written(df, new_folder(df.sparkSession, name), **options)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder``."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and share an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
    give_back()


#: Spreads a 64-bit number's bits, as a factor.
MIX = np.uint64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number's bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Earliest:
    """The smallest id that a task has met for each key that several ids share, before any shuffle.

    A key that stands in a large share of all rows then goes on with about a row a
    task.  At most ``most`` keys are remembered, those met last; a key that is not
    remembered only means that its row goes on.  A key is a pair of 64-bit numbers.
    """

    def __init__(self, most: int = 1 << 16) -> None:
        self.most, self.turn = most, 0
        self.mixed, self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The smallest id met so far with each row's key, these rows included."""
        if not len(ids):
            return ids
        self.turn += 1
        mixed = finish(one.view(np.uint64) * MIX + two.view(np.uint64))
        order = np.argsort(mixed)
        mixed, one, two, own = mixed[order], one[order], two[order], ids[order]
        starts = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        least, most = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
        known = np.zeros(len(starts), bool)
        if len(self.mixed):
            at = np.minimum(np.searchsorted(self.mixed, mixed[starts]), len(self.mixed) - 1)
            known = (self.one[at] == one[starts]) & (self.two[at] == two[starts])
            least = np.where(known, np.minimum(least, self.least[at]), least)
            self.least[at[known]], self.used[at[known]] = least[known], self.turn
        new = starts[(least < most) & ~known]
        if len(new):
            keep = np.argsort(np.append(self.used, np.full(len(new), self.turn)), kind="stable")[-self.most :]
            values = (mixed[new], one[new], two[new], least[(least < most) & ~known], np.full(len(new), self.turn))
            old = (self.mixed, self.one, self.two, self.least, self.used)
            joined = [np.append(o, v)[keep] for o, v in zip(old, values, strict=True)]
            sort = np.argsort(joined[0])
            self.mixed, self.one, self.two, self.least, self.used = (x[sort] for x in joined)
        out = np.empty(len(ids), np.int64)
        out[order] = np.repeat(least, np.diff(np.append(starts, len(ids))))
        return out


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` for columns to add to ``columns``; one that is taken, in any case of letters, gets as many ``_`` as it needs."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def parts_of(spark: SparkSession) -> int:
    """Number of partitions for a keyed repartition, as the session sets it for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
