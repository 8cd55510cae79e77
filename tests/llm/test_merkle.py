"""The Merkle manifest against trees built plainly."""

import hashlib

import pytest
from pyspark.sql import functions as F

from engram.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def proof(levels, k):
    out = []
    for level in levels[:-1]:
        first = k - k % 16
        out.append(("".join(level[first:k]), "".join(level[k + 1 : first + 16])))
        k //= 16
    return out


def brute(rows, changed):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in by[s]]))
    above, out = tree([t[-1][0] for t in trees]), []
    for n, (s, levels) in enumerate(zip(sources, trees, strict=True)):
        for k, r in enumerate(by[s]):
            path = proof(levels, k) + proof(above, n)
            d = leaf(changed(r))
            for before, after in path:
                d = sha(before, d, after)
            out.append((str(r[0]), leaf(r), levels[-1][0], above[-1][0], sha(*(x for p in path for x in p)), d, d == above[-1][0]))
    return sorted(out)


def changed(r):
    return (*r[:4], r[4].lower()) if r[0] is not None and r[0] % 3 == 0 and r[4] is not None else r


def found(df, **more):
    out = merkle.manifest(df, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), **more)
    return out, sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def rows(sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((k * 7919 % 10007, source, "en" if k % 3 else None, k if k % 5 else None, [None, "", "Ein Text", "é漢\U0001f600 X", "lower"][k % 5]))
            k += 1
    return out


ODD = [(None, "b", None, None, None), (None, "b", "en", 1, "x"), (5, "b", "en", 1, "A"), (5, "b", "en", 1, "A"), (5, "b", "en", 2, "A"), (-3, "b", "en", 2, "A"), (6, "", "", 0, ""), (9, None, None, None, None)]


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(deep=1, most=6), merkle.Shape(deep=2, most=3)])
def test_same_as_plain_trees(spark, shape):
    data = rows({"hot": 700, None: 17, "a": 16, "é": 33, "z": 1, "漢": 257}) + ODD
    df = spark.createDataFrame(data, SCHEMA).withColumns({"grp": F.lit(1), "place": F.lit(2), "Digest": F.lit("x")}).repartition(5)
    out, got = found(df, shape=shape)
    assert got == brute(data, changed)
    assert out.where(merkle.leads_to(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    assert {r.verified for r in out.collect()} == {True, False}


def test_very_many_sources_are_one_tree(spark):
    data = rows({f"s{k}": 1 + (k % 7 == 0) for k in range(90)})
    assert found(spark.createDataFrame(data, SCHEMA).repartition(3), shape=merkle.Shape(deep=1, most=4), proofs=False)[1] == brute(data, changed)


def test_single_row_and_no_rows(spark):
    one = [(1, "s", "en", 3, "abc")]
    (row,) = found(spark.createDataFrame(one, SCHEMA))[0].collect()
    assert row.leaf == row.subroot == row.root == leaf(one[0]) and row.proof == [] and row.proof_sha256 == sha()
    assert found(spark.createDataFrame([], SCHEMA))[1] == []


def test_large_blocks_equal_small_ones(spark):
    data = rows({"hot": 4097, "b": 5})
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    assert found(df, proofs=False)[1] == found(df, proofs=False, shape=merkle.Shape(deep=2, most=8))[1] == brute(data, changed)
