import numpy as np
import pyarrow.parquet as pq
import pytest

from engram.operators import retrieval
from engram.plans.queries import queries

from .test_queries import DATA


@pytest.fixture(params=[(512, 4096), (7, 90)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", request.param[0])
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", request.param[1])


def cosines():
    t = pq.read_table(f"{DATA}/embeddings.parquet").sort_by("vec_id")
    ids, m = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    return ids, {int(i): np.round(m @ m[k], 6) for k, i in enumerate(ids) if i % 20 == 0}


def test_every_twentieth_row_is_a_query(spark, blocks):
    ids, scores = cosines()
    want = {}
    for q, s in scores.items():
        best = sorted(zip(-s, ids, strict=True))[: retrieval.RECALL_K]
        want |= {(q, k + 1): (int(i), float(-s)) for k, (s, i) in enumerate(best) if s < 0}
    got = {(r.query_id, r.rank): (r.id, r.score) for r in queries()["vector_topk"](spark, DATA).collect()}
    assert len(scores) > 5 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_every_twentieth_row_has_a_novelty(spark, blocks):
    ids, scores = cosines()
    want = {q: min(1.0, max(0.0, (0.92 - s[ids != q].max()) / (0.92 - 0.75))) for q, s in scores.items()}
    got = {r.query_id: r.novelty for r in queries()["novelty"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 2e-5 for q in want)


def test_odd_vectors_have_no_score(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    got = retrieval.vector_scores(v.where("id = 0").withColumnRenamed("id", "query_id"), v, others=True)
    assert {(r.id, r.score) for r in got.collect()} == {(1, 0.0), (6, 0.6)}
    assert retrieval.vector_scores(v.where("id < 0").withColumnRenamed("id", "query_id"), v, 3).count() == 0
