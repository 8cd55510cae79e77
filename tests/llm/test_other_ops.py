"""Embeddings, URLs, WARC bundles and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import components, embed_dup, url_filter, warc
from engram.llm.common import drop_folder, new_folder, written

from . import brute


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    want = brute.components(range(500), links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "high star", "clique", "mixed"])
def test_components_of_hard_shapes(spark, shape):
    draw = np.random.default_rng(5)
    names = draw.permutation(300).tolist()
    links = {
        "chain": [(k, k + 1) for k in range(299)],
        "star": [(0, k) for k in range(1, 300)],
        "high star": [(k, 299) for k in range(299)],
        "clique": [(a, b) for a in range(40) for b in range(a)],
        "mixed": [(names[k], names[k + 1]) for k in range(299) if k % 50] + [(7, 7), (None, 3), (3, None), (names[1], names[2]), (names[2], names[1])],
    }[shape]
    real = [(u, v) for u, v in links if u is not None and v is not None and u != v]
    want = brute.components(range(300), real)
    rows = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(rows) == len({x.node for x in rows})
    assert {x.node: x.component for x in rows} == {n: want[n] for n in {n for link in real for n in link}}


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for k in range(120):
        v = r.normal(size=16)
        rows += [(v, k % 3)]
        for _ in range(int(r.integers(0, 3))):
            rows.append((v + r.normal(size=16) * 0.03, k % 3))
    hot = r.normal(size=16)
    rows += [(hot + r.normal(size=16) * 0.02, 1) for _ in range(60)] + [(hot, 1)] * 9 + [(hot * 2, 1), (hot, None), (hot, 2)]
    odd = [(None, 1), (np.zeros(16), 1), (np.full(16, np.nan), 1), (np.full(16, np.inf), 1), (r.normal(size=5), 1), (np.zeros(0), 1)]
    return [(k, None if v is None else [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows + odd)] + [(900, [1.0, None, 2.0], 1)]


def brute_vectors(rows, least=0.98):
    usable = {}
    for k, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable[k] = (np.array(v) / np.linalg.norm(v), label)
    ids = sorted(usable)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] >= least]
    degree = dict.fromkeys((k for k, _, _ in rows), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    c = brute.components([k for k, _, _ in rows], links)
    return {k: (degree[k], c[k]) for k in degree}


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dup, "BLOCK", block)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).repartition(3)
    want = brute_vectors(vectors())
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dup.near_vectors(df).collect()}
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.98 * len(want)
    assert embed_dup.near_vectors(df.limit(0)).count() == 0


def test_vectors_without_or_with_repeated_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, v, 1), (1, v, 1), (1, w, 1), (None, v, 1), (2, v, 1), (3, w, None)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [("1", 0, 1, True), ("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("3", 0, 3, True), ("None", 0, None, True)]


def test_vectors_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    want = brute_vectors(rows)
    got = {r.vec_id: r.n_links for r in embed_dup.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values()) and all(got[k] <= want[k][0] for k in got)


URLS = [
    ("http://a.b.org/x?y", "a.b.org", "/x", "org/", "allow"), ("https://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("http://m.example.org/en/12#t", "m.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("ftp://x.com/de/a?b", "x.com", "/de/a", "com/de/", "block"),
    ("http://notexample.org", "notexample.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://É.NET/Ä#x://y", "É.net", "/Ä", None, None), ("http://com.net/fr/?", "com.net", "/fr/", None, None),
]


def test_urls(spark):
    rows = [(k, u[0], "z") for k, u in enumerate(URLS)] + [(0, URLS[0][0], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = url_filter.judge(df, url_filter.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    free = url_filter.judge(df.where("page_id > 5"), url_filter.RULES).collect()
    assert {r.verdict for r in free} == {"allow"}


def test_url_model_tells_languages_apart(spark):
    rows = [(k, f"http://h{k % 7}.{'com' if k % 2 else 'net'}/{'fr' if k % 3 else 'de'}/p{k}") for k in range(300)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.RULES).where("rule is null").collect()
    assert got and all((r.verdict == "allow") == r.path.startswith("/fr/") for r in got)


def pages():
    long = "x" * 99 + "é"
    return [(5, "http://a/\r\nX: y", long), (3, "http://b", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "z" * 300_000), (11, "u", "z" * 300_000), (12, "u", "WARC/1.1\r\n\r\n" * 20)]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", F.lit(1))
    bundles = warc.write_bundles(df, f"file://{tmp_path}/w", frame_bytes=1000, bundle_bytes=1500)
    got = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    first = {}
    for i, _, html in sorted(pages()):
        first.setdefault((html or "").encode(), i)
    for i, _, html in pages():
        body = (html or "").encode()
        twin = first[body] if len(body) >= 100 and first[body] != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), twin)
        assert r.record_type == ("response" if twin is None else "revisit") and (twin is not None or bytes(r.payload) == body)
    found = []
    for b in bundles.collect():
        with warc.open_file(b.file) as f:
            found += warc.Bundle(f).record(12)
    ((fields, body),) = found
    assert fields["WARC-Type"] == "response" and body == pages()[-1][2].encode()
    odd = warc.write_bundles(df.unionByName(df.where("page_id = 8")).unionByName(df.limit(1).withColumn("page_id", F.lit(None).cast("long"))), f"file://{tmp_path}/odd")
    again = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_bundles(odd).collect())
    assert again == sorted([*((i, r.record_type, r.refers_to) for i, r in got.items()), (8, "revisit", 7)])
    assert warc.read_bundles(warc.write_bundles(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("e"))
    odd = spark.createDataFrame([(100_000, None), (100_001, ""), (None, "no id")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    folder = new_folder(spark, "test-pipeline")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, before, sf), f"{folder}/{k}")
        rows = texts(before)
        if name == "near_dup":
            want = brute.near_duplicates(rows, 5)
            assert {i for i, _ in texts(after)} == {i for i, (_, c) in want.items() if i == c}
        elif name == "substrings":
            want = brute.substring_dedup(rows)
            assert {i for i, _ in texts(after)} == want.keys()
            for i, t in texts(after):
                whole = want[i][0] - want[i][1]
                assert whole - 6 * (want[i][2] + 1) <= len((t or "").encode()) <= whole
        elif name == "decontaminate":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = brute.contamination(rows, bench)
            assert {i for i, _ in texts(after)} == {i for i, (_, hit, _) in want.items() if not hit}
        elif name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {i for i, _ in texts(after)}
            good = [i for i, _ in rows if labels.get(i) == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
        else:
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        if name != "pack":
            assert after.columns == docs.columns
        before = after
    drop_folder(spark, folder)


CLASHES = ["_h", "_d", "_c", "_s", "_kept", "kept", "n_removed", "_score", "score", "crcs", "spans", "codes", "rep", "block", "doc"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_carry_columns_of_any_name(spark, name):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = docs.unionByName(docs.where("doc_id = 5")).select("*", *(F.lit(c).alias(c) for c in CLASHES))
    stage = dict(corpus_pipeline.STAGES)[name]
    after = stage(spark, odd, sf)
    rows = after.collect()
    assert rows and after.limit(0).count() == 0
    if name != "pack":
        assert after.columns == odd.columns and all(r[c] == c for r in rows for c in CLASHES)
    empty = stage(spark, odd.limit(0), sf)
    assert empty.count() == 0 and empty.columns == after.columns
