"""Operator 13: vectors compressed to a byte for each of eight parts, by codebooks learned in whole numbers.

Vectors are scaled to integers once and cut into ``PARTS`` equal parts.  Each part
position has a codebook of at most ``ENTRIES`` entries, the parts of the vectors
with the smallest vec_ids at first.  A round assigns every part to its nearest
entry and moves each entry to the mean, rounded down, of its parts.  Rounds are a
pass over the written integer table each; a task leaves a sum for each entry, so
the driver receives a codebook's size of numbers.

Nearest entries are found by a vantage-point tree for each part position.  A node
keeps one entry as its vantage point and the rest in two halves, with the least and
the largest distance from it to each.  A half is visited unless the triangle
inequality says that all of it is farther than the best entry so far.  Distances
there are floating-point numbers: radii and bounds are rounded outwards by
``MARGIN`` and a bound equal to the best is visited (non-strict), so neither
rounding nor a tie can hide an entry.  What decides are squared distances in whole
numbers, and of equal ones the entry with the lower index.  All vectors of a batch
go down the tree together, those nearer to the vantage point first into the near half.

Rows whose vector is null, empty or holds null or non-finite components are
dropped, and so are those whose length is no multiple of ``PARTS`` or not that of
the kept vector with the smallest vec_id.  Scaled components beyond ``LARGEST`` either way
count as ``LARGEST``, so that all sums fit in a long.  A null vec_id is kept and
comes last in the order of vec_ids, rows that repeat one go by their vector.  With
fewer vectors than entries the codebooks are shorter.  Null labels count together.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are held to this, either way.
LARGEST = (1 << 27) - 1
#: Relative rounding outwards of distances: several times what conversion, square root and subtraction can lose.
MARGIN = 2.0**-50
#: Rows compared at once.
ROWS = 8192


class Node(NamedTuple):
    """A vantage point (an entry's index) and two halves of the other entries, each (least distance, largest distance, node)."""

    entry: int
    halves: list[tuple[float, float, "Node"]]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def build(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over ``entries`` of a codebook."""
    entries = np.arange(len(book)) if entries is None else entries
    apart = np.array([squared(book[entries], book[e]).max() for e in entries])
    vantage = int(entries[np.argmax(apart)])  # one at the rim divides best
    rest = entries[entries != vantage]
    if not len(rest):
        return Node(vantage, [])
    rest = rest[np.argsort(far := squared(book[rest], book[vantage]), kind="stable")]
    radius, half = np.sqrt(np.sort(far).astype(np.float64)), (len(rest) + 1) // 2
    cuts = [(0, half), (half, len(rest))]
    return Node(vantage, [(radius[a] * (1 - MARGIN), radius[b - 1] * (1 + MARGIN), build(book, rest[a:b])) for a, b in cuts if a < b])


def nearest(points: np.ndarray, book: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance to it, distances computed) of integer ``points``, by branch and bound."""
    best, least, seen = np.full(len(points), -1, np.int64), np.full(len(points), np.iinfo(np.int64).max), 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal seen
        seen += len(rows)
        d = squared(points[rows], book[node.entry])
        closer = (d < least[rows]) | ((d == least[rows]) & (node.entry < best[rows]))
        best[rows[closer]], least[rows[closer]] = node.entry, d[closer]
        if not node.halves:
            return
        root = np.sqrt(d.astype(np.float64))

        def into(half: int, some: np.ndarray) -> None:
            if not len(some):
                return
            low, high, child = node.halves[half]
            bound = np.maximum(root[some] * (1 - MARGIN) - high, low - root[some] * (1 + MARGIN)) * (1 - MARGIN)
            open_ = bound <= np.sqrt(least[rows[some]].astype(np.float64)) * (1 + MARGIN)
            if open_.any():
                visit(child, rows[some[open_]])

        if len(node.halves) == 1:
            into(0, np.arange(len(rows)))
            return
        near = root <= (node.halves[0][1] + node.halves[1][0]) / 2
        for first, some in ((0, np.flatnonzero(near)), (1, np.flatnonzero(~near))):
            into(first, some)
            into(1 - first, some)

    if len(points):
        visit(tree, np.arange(len(points)))
    return best, least, seen


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole (scaled integer components) of the rows that are kept."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.coalesce(e.isNotNull() & (F.size(e) > 0) & (F.size(e) % PARTS == 0) & finite, F.lit(False))
    whole = F.transform(e, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int"))
    rows = staged(vectors.where(fits).select("vec_id", "label", whole.alias("whole")), "vectors-whole")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select(F.size("whole").alias("n")).first()
    return rows.where(F.size("whole") == (first.n if first else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as (rows, parts, components of a part)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), PARTS, -1)


def first_books(rows: DataFrame) -> np.ndarray:
    """(part, entry, component): the parts of the ENTRIES smallest vec_ids."""
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    if not found:
        return np.zeros((PARTS, 0, 0), np.int64)
    return np.array([r.whole for r in found], np.int64).reshape(len(found), PARTS, -1).transpose(1, 0, 2)


def assigned(batch: pa.RecordBatch, books: np.ndarray, trees: list[Node]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, index and squared distance of each part's nearest entry) of a batch, ROWS at a time."""
    points = matrix(batch["whole"])
    for lo in range(0, len(points), ROWS):
        some = points[lo : lo + ROWS]
        found = [nearest(np.ascontiguousarray(some[:, p]), books[p], trees[p])[:2] for p in range(PARTS)]
        yield slice(lo, lo + len(some)), some, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    size = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, n = shared.value, np.zeros(shared.value.shape[:2], np.int64)
        trees, total = [build(b) for b in books], np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, points, index, _ in assigned(batch, books, trees):
                for p in range(PARTS):
                    np.add.at(total[p], index[:, p], points[:, p])
                    n[p] += np.bincount(index[:, p], minlength=len(n[p]))
        p, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(n[p, k]), *(pa.array(total[p, k, c]) for c in range(size))], ["part", "entry", "n", *(f"c{c}" for c in range(size))])

    columns = ["n", *(f"c{c}" for c in range(size))]
    each = rows.select("whole").mapInArrow(sums, "part long, entry long, " + ", ".join(f"{c} long" for c in columns))
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns)).collect():  # a row for each entry
        out[r.part, r.entry] = [int(r[c]) // int(r.n) for c in columns[1:]]
    return out


def learned(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Final codebooks (part, entry, component) of ``scaled`` rows."""
    books = first_books(rows)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index a part) and error of each of the ``scaled`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in shared.value if len(b)]
        for batch in batches:
            for some, _, index, error in assigned(batch, shared.value, trees):
                part = batch.slice(some.start, some.stop - some.start)
                code = pa.array([bytes(c) for c in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], code, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with vector: the components that each code stands for, by columns only."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x) / SCALE) for x in entry)) for entry in part)) for part in books))
    parts = F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda p: F.get(F.get(table, p - 1), F.conv(F.hex(F.substring("code", p, F.lit(1))), 16, 10).cast("int")))
    return codes.withColumn("vector", F.flatten(parts))


def compressed(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row; codebooks) of ``vectors`` (vec_id, embedding, label)."""
    rows = staged(scaled(vectors), "vectors-kept")
    books = learned(rows)
    return staged(encoded(rows, books), "vectors-codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``embeddings``."""
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error"))
    sums = small_side(staged(sums.withColumnRenamed("label", "of"), "vectors-labels"))
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""
e{k} AS MATERIALIZED (SELECT i, p, arg_min(b.e, (list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e, min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v JOIN b{k} b USING (p) GROUP BY i, p),"""


def _move(k: int) -> str:
    return f"""
m{k} AS (SELECT p, e, j, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS j FROM v JOIN e{k} USING (i, p)) GROUP BY p, e, j),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{k} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e),"""


OP13_SQL = f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(greatest(-{LARGEST}, least({LARGEST}, CAST(x AS DOUBLE) * {SCALE}))) AS BIGINT)) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, whole) AS i FROM w),
s AS MATERIALIZED (SELECT * FROM r WHERE len(whole) = (SELECT len(whole) FROM r WHERE i = 1)),
v AS MATERIALIZED (SELECT i, p, whole[p * len(whole) // {PARTS} + 1 : (p + 1) * len(whole) // {PARTS}] AS x FROM s, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS e, x FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY i) <= {ENTRIES}),
{"".join(_round(k) + _move(k) for k in range(ROUNDS))}{_round(ROUNDS)}
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM e{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN s USING (i) CROSS JOIN h
"""
