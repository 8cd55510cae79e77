import random

import pytest
from pyspark.sql import functions as F

from engram.operators import retrieval


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_words_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "WORDS", most)
    texts = {1: "the cats, a dog-house", 2: "", 3: None, 4: "ünïcode \U0001f600 x" * 40, 5: "he she hers", 6: "a.b c++ %d \n tab\tq"}
    words = {1: ["cat", "zebra"], 2: ["he", "hers", "s"], 3: [""], 4: ["c++", "\U0001f600", "dog-house"], 5: ["b c"], 6: ["q", None], 7: [None], 8: ["nothing"]}
    q = spark.createDataFrame([(k, w) for k, some in words.items() for w in some], "query_id long, word string")
    d = spark.createDataFrame(list(texts.items()), "id long, content string").repartition(3)
    got = sorted((r.query_id, r.id) for r in retrieval.said(q.unionByName(q), d).collect())
    want = sorted((k, i) for k, some in words.items() for i, t in texts.items() if any(w == "" or (w is not None and t is not None and w in t) for w in some))
    assert got == want


def test_bounded_expansion_keeps_the_best(spark):
    """The best of recalled and reached nodes are those of the whole expansion, whatever groups overlap and who is visited."""
    r = random.Random(2)
    nodes = [(k, [f"p{k % 3}", f"x{r.randrange(12)}"] if k % 5 else [f"p{k % 3}"], "archived" if k % 7 == 0 else "active") for k in range(300)]
    df = spark.createDataFrame(nodes, "id long, provenance array<string>, status string")
    active = df.where("status = 'active'")
    live = [k for k, _, s in nodes if s == "active"]
    recalled = spark.createDataFrame([(q, i, round(r.choice([1.0, 0.9, 0.8, 0.5, r.random()]), 6)) for q in range(12) for i in r.sample(live, [0, 1, 3, 10, 60, 200][q % 6])], "query_id long, id long, score double")
    members = retrieval.memberships(df)

    def best(graph):
        both = recalled.withColumns({"seed": F.lit(None).cast("long"), "hop": F.lit(0)}).unionByName(graph.select("query_id", "id", "score", "seed", "hop"))
        return sorted((x.query_id, x.rank, x.id, x.score, str(x.seed), x.hop) for x in retrieval.top_k(both, 15, positive=False).collect())

    few = retrieval.best_reached(retrieval.worth_expanding(recalled, 15), recalled, members, active, 15)
    assert best(few) == best(retrieval.expand(recalled, members, 1, active=active))
    per = few.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per <= 15 * 15 and few.count() < retrieval.expand(recalled, members, 1, active=active).count()
