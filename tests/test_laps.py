"""Routes drawn in laps and the law of draws."""

import math
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from engram.operators import datasets, graph, laps

NODES = "case_id long, id string, type string, status string, memory string, key string, tags array<string>, chat_time timestamp"
EDGES = "case_id long, source string, target string, type string"


def close(got: Counter, weights: dict, n: int) -> bool:
    """Each share within five standard deviations of its weight's."""
    whole = sum(weights.values())
    return sum(got.values()) == n and all(abs(got[k] / n - w / whole) < 5 * math.sqrt(w / whole / n) for k, w in weights.items())


def test_weighted_samples_follow_the_law(spark):
    """First and second of three by weights 1, 1/2, 1/4; sizes evenly."""
    n = 4000
    rows = spark.range(n).select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(v).alias("v")) for f, v in (("a", 0), ("b", 1), ("c", 3))))).alias("x")).select("id", "x.*")
    drawn = datasets.weighted_sample(rows, ["id"], "f", 2, 5, datasets.visit_weight(F.col("v"))).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("draw", "f"))), lambda x: x["f"]), "").alias("pair"))
    w = {"a": 1, "b": 0.5, "c": 0.25}
    law = {x + y: w[x] / 1.75 * w[y] / (1.75 - w[x]) for x in w for y in w if x != y}
    assert close(Counter(r.pair for r in drawn.collect()), law, n)
    sizes = spark.range(n).select(datasets.draw_size(3, 2, F.lit(4), "id").alias("k"))
    assert close(Counter(r.k for r in sizes.collect()), {2: 1, 3: 1, 4: 1}, n)
    even = datasets.weighted_sample(rows, ["id"], "f", 1, 9)
    assert close(Counter(r.f for r in even.collect()), {"a": 1, "b": 1, "c": 1}, n)


def test_places_are_pairs(spark):
    for n, m, same in ((2, 2, True), (7, 7, True), (60, 60, True), (3, 5, False), (1, 9, False)):
        total = n * (n - 1) // 2 if same else n * m
        i, j = laps.unranked(F.col("id"), F.lit(n), F.lit(m), F.lit(same))
        got = {(r.i, r.j) for r in spark.range(total).select(i.alias("i"), j.alias("j")).collect()}
        assert got == (set(combinations(range(n), 2)) if same else {(a, b) for a in range(n) for b in range(m)})
    large = 1 << 30  # around places where a root rounds
    rows = spark.createDataFrame([(b * (b - 1) // 2 + d,) for b in (large, large - 1, 94906267) for d in (-1, 0, 1)], "p long")
    i, j = laps.unranked(F.col("p"), F.lit(large * 2), F.lit(large * 2), F.lit(True))
    for r in rows.select("p", i.alias("i"), j.alias("j")).collect():
        assert 0 <= r.i < r.j and r.j * (r.j - 1) // 2 + r.i == r.p


def test_pairs_are_drawn_by_weight(spark):
    n = 3000
    members = spark.range(n).select(F.col("id").alias("case_id"), F.lit("t").alias("topic"), F.lit("cost").alias("dimension"), F.explode(F.array(*map(F.lit, "abcd"))).alias("fact"))
    visits = spark.range(n).select(F.col("id").alias("case_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("node_id"), F.lit(v).alias("visits")) for f, v in (("b", 1), ("c", 1), ("d", 3))))).alias("x")).select("case_id", "x.*")
    cands = laps.Candidates(None, None, None, members, None)
    drawn = laps._pair_draws(cands, spark.range(n).select(F.col("id").alias("case_id"), F.lit(1).alias("attempt")), visits, 8).collect()
    v = {"a": 0, "b": 1, "c": 1, "d": 3}
    assert close(Counter("".join(r.evidence) for r in drawn), {x + y: 1 / (1 + v[x] + v[y]) for x, y in combinations("abcd", 2)}, n)


def test_many_facts_make_few_classes(spark):
    """Ten times the facts of a topic: as many rows of classes, a hundred times the pairs."""
    sizes = {}
    for n in (100, 1000):
        members = spark.range(n).select(F.lit(1).cast("long").alias("case_id"), F.lit("t").alias("topic"), F.lit("cost").alias("dimension"), F.col("id").cast("string").alias("fact"))
        visits = members.select("case_id", F.col("fact").alias("node_id"), (F.col("fact").cast("int") % 4).alias("visits"))
        rows = laps.pair_classes(members, visits).collect()
        assert sum(r.pairs for r in rows) == n * (n - 1) // 2
        sizes[n] = len(rows)
    assert sizes == {100: 10, 1000: 10}


def graph_of(spark):
    """Case 1 has one fact, case 2 two topics of facts, case 3 a changed fact only, case 4 no fact."""
    fact = lambda case, k, status, memory, time: (case, k, "fact", status, memory, "", ["x"], time)
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    nodes = [(c, t, "topic", "activated", "topic", "", ["x"], None) for c, t in ((1, "t1"), (2, "t2"), (2, "t3"), (3, "t4"), (4, "t5"))]
    nodes += [fact(1, "f", "activated", "plain", None), fact(3, "old", "archived", "old plan", day(1)), fact(3, "new", "activated", "changed the plan now", day(2))]
    nodes += [fact(2, f"a{k}", "activated", "price", None) for k in range(3)] + [fact(2, f"b{k}", "activated", "city", None) for k in range(2)]
    edges = [(1, "t1", "f", "PARENT"), *((2, "t2", f"a{k}", "PARENT") for k in range(3)), *((2, f"b{k}", "t3", "PARENT") for k in range(2)), (3, "t4", "new", "PARENT"), (3, "old", "new", "MERGED_TO")]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)


def test_laps_end_with_their_routes(spark):
    edges, nodes = graph_of(spark)
    rows = laps.lap_routes(edges, nodes, 40, seed=1).collect()
    assert len({r.signature for r in rows}) == len(rows)
    counts = Counter((r.case_id, r.mode) for r in rows)
    # 3 * 2 + 3 * 2 * 1 and 2 * 1 ordered samples of topics; 3 + 1 pairs
    assert counts == {(1, "single_fact"): 1, (2, "single_fact"): 5, (2, "same_topic"): 14, (2, "comparison"): 4, (3, "single_fact"): 1, (3, "temporal_evolution"): 1}
    for key in counts:
        assert sorted(r.lap for r in rows if (r.case_id, r.mode) == key) == list(range(1, counts[key] + 1))
    assert all(set(r.evidence) <= set(r.walk) and len(set(r.evidence)) == len(r.evidence) for r in rows)


def test_laps_stop_at_the_count_and_know_earlier_routes(spark):
    edges, nodes = graph_of(spark)
    first = laps.lap_routes(edges, nodes, 3, seed=2)
    had = first.collect()
    assert [(r.lap, r.mode) for r in sorted(had, key=lambda r: (r.lap, datasets.MODES.index(r.mode))) if r.case_id == 2] == [(1, "single_fact"), (1, "same_topic"), (1, "comparison")]
    again = laps.lap_routes(edges, nodes, 3, seed=2, seen=first.select("case_id", "signature"), visits=datasets.visit_counts(first)).collect()
    assert not {r.signature for r in again} & {r.signature for r in had} and {r.case_id for r in again} == {2}


def test_a_visited_fact_is_drawn_less(spark):
    n = 1500
    cases = spark.range(n).withColumnRenamed("id", "case_id")
    facts = cases.select("case_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("f")).select("case_id", F.lit(None).cast("string").alias("dimension"), F.array("f").alias("walk"), F.array("f").alias("evidence"), F.concat("case_id", "f").alias("signature"))
    past = spark.createDataFrame([], "case_id long, signature string")
    drawn = laps._listed(facts, cases, past, cases.select("case_id", F.lit("a").alias("node_id"), F.lit(3).alias("visits")), 4)
    assert close(Counter(r.walk[0] for r in drawn.collect()), {"a": 0.25, "b": 1}, n)


def test_laps_read_no_nodes_again(spark):
    """Facts and topics are read for the candidates, whatever the number of laps and modes."""
    edges, nodes = graph_of(spark)
    calls = spark.sparkContext.accumulator(0)

    def counted(case):
        calls.add(1)
        return case

    laps.lap_routes(edges, nodes.repartition(2).withColumn("case_id", F.udf(counted, "long")("case_id")), 1, seed=1).collect()
    assert 0 < calls.value <= 2 * nodes.count()


def test_topics_hold_each_fact_once(spark):
    """Whichever way edges point, and however often."""
    edges, nodes = graph_of(spark)
    both = edges.unionByName(edges.select("case_id", F.col("target").alias("source"), F.col("source").alias("target"), "type")).unionByName(edges)
    rows = graph.filled_topics(both, nodes, graph.read_facts(nodes)).collect()
    assert {(r.case_id, r.topic): [f.fact for f in r.facts] for r in rows} == {(1, "t1"): ["f"], (2, "t2"): ["a0", "a1", "a2"], (2, "t3"): ["b0", "b1"], (3, "t4"): ["new"]}
    assert {f.fact: f.dimensions for r in rows for f in r.facts if r.case_id == 2} == {**{f"a{k}": ["cost"] for k in range(3)}, **{f"b{k}": ["location"] for k in range(2)}}


def test_classes_of_unvisited_topics_are_counted_before(spark):
    members = spark.range(60).select(F.lit(1).cast("long").alias("case_id"), (F.col("id") % 6).cast("string").alias("topic"), F.lit("cost").alias("dimension"), F.col("id").cast("string").alias("fact"))
    visits = spark.createDataFrame([(1, "7", 2), (1, "13", 1), (1, "9", 1)], "case_id long, node_id string, visits long")
    counts = members.groupBy("case_id", "topic", "dimension").agg(F.count("*").alias("n"))
    cands = laps.Candidates(None, None, None, members, None, None, counts)
    got = laps._classes(cands, members.select("case_id").distinct(), visits, F.broadcast)
    want = laps.pair_classes(members, visits)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
