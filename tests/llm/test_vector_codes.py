"""Vector codes against plain nearest entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from engram.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """{(vec_id, vector): (code, error)} and codebooks of kept (vec_id, vector, label)."""
    kept = [(i, [math.floor(max(-vc.LARGEST, min(vc.LARGEST, 4096 * x))) for x in v]) for i, v, _ in rows if v and None not in v and all(map(math.isfinite, v)) and len(v) % 8 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // 8
    parts = [[v[p * size : (p + 1) * size] for p in range(8)] for _, v in kept]
    books = [[parts[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = {}
            for v in parts:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = {}
    for (i, v), x in zip(kept, parts, strict=True):
        best = [nearest(x[p], books[p]) for p in range(8)]
        found[i, tuple(v)] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return kept, found, books


def check(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = vc.op13_vector_codes(spark, path).collect()
    kept, found, books = brute(rows)
    labels = {}
    for i, v, label in rows:
        if v and None not in v and all(map(math.isfinite, v)) and len(v) == len(kept[0][1]):
            whole = tuple(math.floor(max(-vc.LARGEST, min(vc.LARGEST, 4096 * x))) for x in v)
            labels.setdefault(label, []).append((str(i), *found[i, whole]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((i, c, e, sum(r[2] for r in part), digest) for part in labels.values() for i, c, e in part)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want
    return got


def test_same_as_plain(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 0.1) for _ in range(16)], k % 4 or None) for k in range(150)]
    rows += [(200 + k, [round(r.random() * 3) / 4096 for _ in range(16)], 1) for k in range(60)]  # ties
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, [0.5] * 16, 2), (-1, [-1e-9] * 16, 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1), (304, [1.0, None] * 8, 1), (305, [1.0] * 8, 1), (306, [1.0] * 15, 1), (307, [1e300, -1e300] * 8, 1)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_entries(spark, tmp_path, n):
    assert all(r.error == 0 for r in check(spark, tmp_path, [(k, [float(k)] * 8, None) for k in range(n)]))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], SCHEMA).write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert vc.op13_vector_codes(spark, f"{tmp_path}/e").collect() == []


def test_codes_are_read_back(spark):
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.normal(size=16)], 1) for k in range(80)]
    codes, books = vc.compressed(spark.createDataFrame(rows, SCHEMA))
    by = dict((k, v) for k, v, _ in rows)
    for row in vc.decoded(codes, books).collect():
        whole = np.floor(np.array(by[row.vec_id]) * 4096)
        assert len(row.code) == 8 and int(((np.array(row.vector) * 4096 - whole) ** 2).sum()) == row.error


@pytest.mark.parametrize("spread", [1, 3, 1 << 12, 1 << 27])
def test_tree_finds_the_lowest_nearest(spread):
    r = np.random.default_rng(spread)
    for size in (1, 2, 3, 7, 16, 64):
        book = r.integers(-spread, spread + 1, (size, 8))
        book[r.integers(0, size, size // 3)] = book[0]  # equal entries
        points = np.concatenate([r.integers(-spread, spread + 1, (500, 8)), book, book + 1])
        index, least, _ = vc.nearest(points, book, vc.build(book))
        all_ = ((points[:, None] - book) ** 2).sum(axis=2)
        assert (index == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()


def test_tree_leaves_entries_out():
    r = np.random.default_rng(2)
    book = r.integers(-4096, 4096, (16, 2))
    points = book[r.integers(0, 16, 2000)] + r.integers(-20, 21, (2000, 2))
    assert vc.nearest(points, book, vc.build(book))[2] < 0.7 * 16 * len(points)
