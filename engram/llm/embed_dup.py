"""Operator 6: near-duplicate embeddings with a pivot-permutation index.

Reference points are chosen from a bounded sample; a vector is described by its
``PREFIX`` nearest of them in order.  An inverted list is kept for each set of
``SHARED`` pivots, which is where the lists of these pivots meet, so that two
vectors stand in one list exactly if they share that many near pivots.  First
only the keys of lists are moved and counted; vectors follow to the lists that
have two members or more.  There shared pivots are counted, up to the list's
largest: a pair is taken by the list of the smallest pivots that it shares and by
no other.  Taken pairs of equal label are verified by cosine in double precision.

The number of pivots is a function of the number of vectors (``pivot_count``), so
that lists don't lengthen in step with the table.

Identical vectors of a label form a class and only one stands in the lists, with
its count.  Lists are compared in blocks of at most about ``BLOCK`` vectors by one
matrix product each, lists of up to ``FEW`` many at a time.  A block emits a sum
for each vector and a spanning forest (a short list its at most ``FEW`` links a
vector), so rows grow with vectors, not with pairs.

The index may miss pairs: recall on the test tables, against brute force, is
above 0.97; every link found has the asked cosine.  More pivots in a prefix raise
both recall and work.

Vectors that are null, empty, zero or that hold null or non-finite components,
and those without a label, link with nothing; so do vectors of different length.
A null vec_id is in no link.  Rows that repeat a vec_id and vector are one vector
in every count and return one row each.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_of, staged
from .components import components

#: Reference points of a table of up to ``ROWS`` vectors, and the most of them (a pivot's number takes ten bits of a key).
PIVOTS, ROWS, MOST = 64, 1 << 17, 1 << 10
#: Vectors that reference points are chosen from.
SAMPLE = 2048
PREFIX = 7
SHARED = 4
BLOCK = 1024
#: Length of lists that are compared many at a time.
FEW = 32
LEAST = 0.98


def usable():
    """Vectors that can link."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def pivot_count(rows: int) -> int:
    """Reference points for ``rows`` vectors: twice as many for each sixteenfold of ``ROWS``."""
    return min(MOST, PIVOTS * max(1, round((rows / ROWS) ** 0.25)))


def choose_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit reference points for each vector length, far from one another, out of at most SAMPLE vectors."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for e in sample:
        v = np.asarray(e, np.float64)
        by_size.setdefault(len(v), []).append(v / np.linalg.norm(v))
    out = {}
    for size, vectors in by_size.items():
        have = np.array(vectors)
        have = have[np.isfinite(have).all(axis=1)]
        if len(have) < count:
            have = np.concatenate([have, random_points(size, count)])
        chosen, nearest = [0], have @ have[0]
        while len(chosen) < count:
            chosen.append(int(np.argmin(nearest)))
            nearest = np.maximum(nearest, have @ have[chosen[-1]])
        out[size] = have[chosen]
    return out


def random_points(size: int, count: int) -> np.ndarray:
    """Unit reference points for a vector length that has too few vectors in the sample."""
    rows = np.random.default_rng(size).normal(size=(count, size))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def components_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components of a list column as doubles, null as NaN; offsets of each list in them)."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0]).cast(pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(np.float64), bounds - bounds[0]


def vector_classes(vectors: DataFrame) -> DataFrame:
    """label, hi, lo, rep (smallest vec_id), n and embedding of each different usable vector of a label."""
    return vectors.where("usable").groupBy("label", "hi", "lo").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.any_value("embedding").alias("embedding"))


def described(classes: DataFrame) -> DataFrame:
    """``classes`` with dim, near (the PREFIX nearest pivots in order) and keys (sets of SHARED of them, ten bits a pivot)."""
    count = pivot_count(classes.count())
    shared = classes.sparkSession.sparkContext.broadcast(choose_pivots(classes, count))
    subsets = np.array(list(combinations(range(PREFIX), SHARED)))
    shift = np.arange(SHARED) * 10

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = components_of(batch["embedding"])
            dims = np.diff(bounds)
            near = np.zeros((batch.num_rows, PREFIX), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                pivots = shared.value[dim] if dim in shared.value else random_points(dim, count)
                for lo in range(0, len(rows), BLOCK):
                    some = rows[lo : lo + BLOCK]
                    v = values[bounds[some][:, None] + np.arange(dim)]
                    near[some] = np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :PREFIX]
            keys = (np.sort(near, axis=1)[:, subsets] << shift).sum(axis=2)
            lists = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (near, keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), *lists], [*batch.schema.names, "dim", "near", "keys"])

    schema = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return classes.mapInArrow(describe, f"{schema}, dim long, near array<long>, keys array<long>")


def forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) among ``size`` vectors."""
    tree, us, vs = np.arange(size), [], []
    for x in np.unique(a).tolist():
        ys = b[a == x]
        roots, first = np.unique(tree[ys], return_index=True)
        other = roots != tree[x]
        if other.any():
            us += [x] * int(other.sum())
            vs += ys[first[other]].tolist()
            tree[np.isin(tree, roots[other])] = tree[x]
    return np.array(us, np.int64), np.array(vs, np.int64)


def near_sets(near: np.ndarray, most: np.ndarray, count: int) -> np.ndarray:
    """A row of marks for each vector: its near pivots up to ``most``."""
    marks = np.zeros((len(near), count), np.float32)
    np.put_along_axis(marks, near, (near <= most[:, None]).astype(np.float32), 1)
    return marks


def list_links(key: np.ndarray, start: np.ndarray, side: np.ndarray, near: np.ndarray, unit: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links to add to each row, ends u and v of links to go on with) of whole lists that begin at ``start``.

    ``side`` says which of two blocks a row is of (0 and 1); in a list with both, only pairs across are compared.
    """
    size, total = np.diff(np.append(start, len(key))), np.zeros(len(key), np.int64)
    group = np.repeat(np.arange(len(start)), size)
    both = (np.add.reduceat(side, start) % size) != 0
    marks = near_sets(near, key >> (10 * (SHARED - 1)), int(near.max()) + 1)
    us, vs = [], []
    short = np.flatnonzero((size <= FEW)[group])
    for step in range(1, min(FEW, len(short))):
        a, b = short[:-step], short[step:]
        met = (group[a] == group[b]) & (~both[group[a]] | (side[a] != side[b]))
        a, b = a[met], b[met]
        own = (marks[a] * marks[b]).sum(axis=1) == SHARED
        a, b = a[own], b[own]
        close = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        us.append(a[close])
        vs.append(b[close])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    total += (np.bincount(a, n[b], len(key)) + np.bincount(b, n[a], len(key))).astype(np.int64)
    us, vs = [a], [b]
    for g in np.flatnonzero(size > FEW).tolist():
        rows = slice(start[g], start[g] + size[g])
        taken = np.triu((unit[rows] @ unit[rows].T >= least) & (marks[rows] @ marks[rows].T == SHARED), 1)
        if both[g]:
            taken &= side[rows][:, None] != side[rows]
        a, b = np.nonzero(taken)
        total[rows] += (np.bincount(a, n[rows][b], size[g]) + np.bincount(b, n[rows][a], size[g])).astype(np.int64)
        u, v = forest(a, b, int(size[g]))
        us.append(u + start[g])
        vs.append(v + start[g])
    return total, np.concatenate(us), np.concatenate(vs)


def compared(index: DataFrame, least: float) -> DataFrame:
    """Rows (u, v, links): a link of a spanning forest, or with v null the links to add to u."""
    lists = index.select("label", "dim", "hi", "lo", F.explode("keys").alias("key"))
    sizes = lists.groupBy("label", "dim", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = lists.join(sizes, ["label", "dim", "key"]).join(index.select("label", "hi", "lo", "rep", "n", "near", "embedding"), ["label", "hi", "lo"])
    own = F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "dim", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "near", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(table):
            key = table["key"].to_numpy()
            apart = np.zeros(len(key), bool)
            apart[0] = True
            for c in ("label", "dim", "key", "i", "j"):
                column = table[c].dictionary_encode().indices.to_numpy(zero_copy_only=False)
                apart[1:] |= column[1:] != column[:-1]
            return np.flatnonzero(apart)

        def links(table):
            if not table.num_rows:
                return
            rep, n, dims = (table[c].to_numpy() for c in ("rep", "n", "dim"))
            values, bounds = components_of(table["embedding"])
            near = components_of(table["near"])[0].astype(np.int64).reshape(-1, PREFIX)
            key, side = table["key"].to_numpy(), (table["own"].to_numpy() == table["j"].to_numpy()).astype(np.int64)
            start = found(table)
            for dim in np.unique(dims).tolist():
                whole = np.flatnonzero(dims == dim)
                unit = values[bounds[whole][:, None] + np.arange(dim)]
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                begin = np.searchsorted(whole, start[dims[start] == dim])
                add, u, v = list_links(key[whole], begin, side[whole], near[whole], unit, n[whole], least)
                some = np.flatnonzero(add)
                us, vs = rep[whole][np.concatenate([some, u])], rep[whole][v]
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(np.append(some * 0, vs), mask=np.arange(len(us)) < len(some)), pa.array(np.append(add[some], v * 0), mask=np.arange(len(us)) >= len(some))], ["u", "v", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest.to_batches(), batch] if rest is not None else [batch]).combine_chunks()
            last = int(found(table.to_batches()[0])[-1])
            whole, rest = table.slice(0, last), table.slice(last)
            yield from links(whole.combine_chunks().to_batches()[0] if last else batch.slice(0, 0))
        if rest is not None:
            yield from links(rest.combine_chunks().to_batches()[0])

    dealt = rows.repartition(parts_of(index.sparkSession), "label", "dim", "key", "i", "j").sortWithinPartitions("label", "dim", "key", "i", "j")
    return dealt.mapInArrow(compare, "u long, v long, links long")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label)."""

    @F.arrow_udf("struct<hi:long,lo:long>")
    def digest(embedding):
        values, bounds = components_of(embedding)
        values = values + 0.0  # one zero
        found = [xxhash.xxh128_intdigest(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array([(d >> 64) - (1 << 63) for d in found], pa.int64()), pa.array([(d & ((1 << 64) - 1)) - (1 << 63) for d in found], pa.int64())], ["hi", "lo"])

    rows = vectors.select("vec_id", "label", "embedding", usable().alias("usable"), digest("embedding").alias("d")).select("vec_id", "label", "embedding", "usable", "d.hi", "d.lo")
    classes = staged(vector_classes(rows), "vectors")
    found = staged(compared(staged(described(classes), "pivots"), least), "vector-links")
    sums = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    known = classes.select("label", "hi", "lo", "rep", "n").join(sums, "rep", "left").join(linked, "rep", "left")
    known = known.select("label", "hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    keyed = rows.drop("embedding").withColumn("label", F.when(F.col("usable"), F.col("label")))
    out = keyed.join(known, ["label", "hi", "lo"], "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
