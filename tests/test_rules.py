"""Worked cases of single rules."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from engram.functions import jsonx, templates, text
from engram.operators import checks, convergence, datasets, graph, memory, retrieval, rewards, store
from engram.session import checkpointed
from engram.sources import providers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


def cases():
    return [
        (text.normal_question(lit("Foo   BAR ?")), "foo bar"),
        (text.question_error(lit("A? B?"), F.array()), "multiple_questions"),
        (text.question_error(lit("Which memory is it?"), F.array()), "metadata_leak"),
        (text.question_error(lit("What memorial?"), F.array()), None),
        (text.question_error(lit("what of N1:0?"), F.array(lit("n1:0"))), "id_leak"),
        (text.question_error(lit(""), F.array()), "question_invalid"),
        (text.with_question_mark(lit("Where.")), "Where?"),
        (text.with_question_mark(lit("哪里？")), "哪里？"),
        (text.is_abstention(lit(" insufficient_information. ")), True),
        (text.is_abstention(lit(None).cast("string")), False),
        (text.leaks_answer(lit("Is it Blue-ish?"), lit("blue")), True),
        (text.leaks_answer(lit("Is it Blue-ish?"), lit("!!")), False),
        (text.without_think(lit("<think>\n</think>\n a ")), "a"),
        (text.parsed_question(lit("a\nb")), None),
        (text.fold(lit("Straße")), "strasse"),
        (text.token_count(lit("a b-c 价格")), 5),
        (text.comparison_dimensions(lit("the budget of a city, 价格age")), ["cost", "location"]),
        (text.temporal_dimension(lit("i quit my job"), F.array(lit("Ab"), lit("a")), F.array(lit("ab"))), "ab"),
        (text.temporal_dimension(lit("i quit my job"), F.array(), F.array()), "state"),
        (text.short_hash(lit("u"), lit("m"), lit(None).cast("string"), lit("w")), "c2893fa0f634f423d767"),
        (rewards.novelty(lit(0.835)), 0.5),
        (rewards.novelty(lit(None).cast("double")), 1.0),
        (datasets.val_size(lit(10), 0.1), 1),
        (datasets.val_size(lit(25), 0.1), 2),
        (datasets.val_size(lit(1), 0.1), 0),
        (graph.topic_walk(lit("t"), F.array(*map(lit, "abc"))), ["a", "t", "b", "t", "c"]),
        (jsonx.is_object(lit('{"a":1}')), True),
        (jsonx.is_object(lit("[1]")), False),
        (retrieval.cosine(F.array(lit(0.0)), F.array(lit(1.0))), 0.0),
    ]


def test_columns(spark):
    for k, (column, want) in enumerate(cases()):
        got = one(spark, column)
        assert got == (pytest.approx(want) if isinstance(want, float) else want), k


def test_sources_encoded_repeatedly(spark):
    inner = json.dumps({"role": "user", "chat_time": None, "content": "hi"})
    df = spark.createDataFrame([("n", [inner, json.dumps(inner), json.dumps(json.dumps(inner)), "{}"])], "id string, sources array<string>")
    rows = graph.exploded_sources(df).orderBy("ordinal").collect()
    assert [r.content for r in rows] == ["hi", "hi", "hi", ""] and rows[1].source_id == "n:1"


def test_first_object(spark):
    df = spark.createDataFrame([("x {bad} {\"a\":1} {\"a\":2,\"b\":3}",), (None,), ("none",)], "t string")
    got = [r.x for r in df.select(jsonx.first_object(("a", "b"))("t").alias("x")).collect()]
    assert got == ['{"a": 2, "b": 3}', None, None]


def test_advantage(spark):
    df = spark.createDataFrame([("u", 1.0, True), ("u", 3.0, True), ("u", 9.0, False), ("v", 5.0, True)], "uid string, score double, available boolean")
    got = {r.score: r.advantage for r in rewards.advantages(df).collect()}
    assert got[1.0] == pytest.approx(-0.7071, abs=1e-4) and got[3.0] == pytest.approx(0.7071, abs=1e-4) and got[9.0] == 0 and got[5.0] == 0


def test_streak(spark):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate([True, True, False, True, True])], "case_id int, round int, saturated boolean")
    assert [r.streak for r in convergence.streaks(df).orderBy("round").collect()] == [1, 2, 0, 1, 2]


def test_fold_and_version(spark):
    rows = [
        (1, 1, "add", [], "one", "q1", ["p1"], ["s1"], []),
        (1, 2, "noop", [], "", None, [], [], []),
        (1, 3, "add", [], "two words", "q2", ["p2"], ["s2"], ["t"]),
    ]
    schema = "case_id long, seq long, op string, targets array<string>, content string, question_id string, provenance array<string>, source_ids array<string>, tags array<string>"
    e = spark.createDataFrame(rows, schema)
    assert [r.version for r in memory.running_version(e).orderBy("seq").collect()] == [1, 1, 2]
    nodes = memory.fold_edits(e)
    ids = [r.id for r in nodes.orderBy("created_version").collect()]
    merged = spark.createDataFrame([(1, 4, "merge", ids, "both", "q3", ["p3"], ["s1"], []), (1, 5, "delete", ids[:1], "", None, [], [], [])], schema)
    after = {r.content: r for r in memory.fold_edits(merged, nodes).collect()}
    assert after["both"].linked_questions == ["q1", "q2", "q3"] and after["both"].provenance == ["p3", "p1", "p2"]
    assert after["one"].status == "archived" and after["one"].updated_version == 4 and after["both"].created_version == 3
    assert memory.active_tokens(memory.fold_edits(merged, nodes)).first().active_tokens == 1


def eliminated(nodes, judge):
    kept = list(nodes)
    for n in reversed(nodes):
        rest = [x for x in kept if x != n]
        if rest and (judge(rest) or 0) >= 0.8:
            kept = rest
    return kept


def test_support_goes_from_the_last_rank(spark):
    """All questions in lockstep equal a loop over each; a round asks once for the whole table."""
    r = random.Random(6)
    marks = {}  # of (question, nodes): correctness, or none where the judge fails
    lists = {q: r.sample("abcdefgh", r.randint(1, 5)) for q in range(40)}

    def judge(q, nodes):
        return marks.setdefault((q, tuple(nodes)), r.choice([0.0, 0.5, 0.8, 1.0, 0.9, None]))

    want = {q: eliminated(nodes, lambda rest, q=q: judge(q, rest)) for q, nodes in lists.items()}
    asked, rounds_ = [], []

    def ask(trials):
        rows = [(t.question_id, t.node_ids) for t in trials.collect()]
        asked.extend(rows)
        rounds_.append(len(rows))
        found = [(q, judge(q, nodes)) for q, nodes in rows]
        return spark.createDataFrame([x for x in found if x[0] % 2 or x[1] is not None], "question_id long, correctness double")

    hits = spark.createDataFrame([(q, k + 1, n) for q, nodes in lists.items() for k, n in enumerate(nodes)], "question_id long, rank int, node_id string")
    got = {}
    for x in sorted(memory.support(hits, ask).collect(), key=lambda x: x.rank):
        got.setdefault(x.question_id, []).append(x.node_id)
    assert got == want and len(rounds_) == 5 and len(asked) == len(marks)
    assert memory.support(hits.limit(0), ask).count() == 0


def test_expand(spark):
    seeds = spark.createDataFrame([(1, "a", 0.5), (1, "z", 0.9)], "query_id int, id string, score double")
    members = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "z"), ("2", "b"), ("3", "b"), ("3", "c"), ("4", "a"), ("4", "z")], "group string, id string")
    got = {r.id: (r.seed, r.hop, r.score) for r in retrieval.expand(seeds, members, depth=2).collect()}
    assert got == {"b": ("z", 1, 0.72), "c": ("z", 2, 0.576)}
    active = spark.createDataFrame([("c",)], "id string")  # b is a bridge only
    assert [r.id for r in retrieval.expand(seeds, members, depth=2, active=active).collect()] == ["c"]


def queue_walk(seeds, near, depth, decay=0.8):
    """Breadth first from all seeds at once."""
    queue = [(i, i, 0) for i, _ in sorted(seeds.items(), key=lambda x: (-x[1], x[0]))]
    seen, out = set(seeds), {}
    while queue:
        node, seed, hop = queue.pop(0)
        if hop < depth:
            for other in sorted(near.get(node, ())):
                if other not in seen:
                    seen.add(other)
                    out[other] = (seed, hop + 1, round(seeds[seed] * decay ** (hop + 1), 6))
                    queue.append((other, seed, hop + 1))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_expand_as_a_queue(spark, depth):
    r = random.Random(depth)
    nodes = [(k, r.sample([f"p{x}" for x in range(12)] + [str(x) for x in range(40)], r.randint(0, 3))) for k in range(40)]
    df = spark.createDataFrame(nodes, "id long, provenance array<string>")
    near = {}
    for row in retrieval.provenance_neighbours(df).collect():
        near.setdefault(row.a, set()).add(row.b)
    seeds = {k: round(r.random(), 3) for k in r.sample(range(40), 4)}
    s = spark.createDataFrame([(1, k, v) for k, v in seeds.items()], "query_id int, id long, score double")
    got = {x.id: (x.seed, x.hop, x.score) for x in retrieval.expand(s, retrieval.memberships(df), depth).collect()}
    assert got == queue_walk(seeds, near, depth)


def test_said_words(spark):
    docs = spark.createDataFrame([(1, "the blueberry pie"), (2, "berry"), (3, ""), (4, None)], "id long, content string")
    words = spark.createDataFrame([(1, "blueberry"), (2, "berr"), (3, "y p"), (4, ""), (5, "berries")], "query_id int, word string")
    got = {}
    for r in retrieval.said(words, docs).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {1: {1}, 2: {1, 2}, 3: {1}, 4: {1, 2, 3, 4}}


def test_opposed_edges(spark):
    walks = spark.createDataFrame([(1, "r", ["A", "B", "A"])], "case_id int, route string, walk array<string>")
    edges = spark.createDataFrame([(1, "A", "B", "PARENT", 0), (1, "B", "A", "PARENT", 1)], "case_id int, source string, target string, type string, pos int")
    way = lambda e: [r.direction for r in graph.walk_steps(walks, e).orderBy("step").collect()]
    assert way(edges) == ["reverse", "forward"]  # the later edge is B to A
    assert way(edges.withColumn("pos", 1 - F.col("pos"))) == ["forward", "reverse"]
    assert way(edges.where("pos = 0")) == ["forward", "reverse"]
    loop = spark.createDataFrame([(1, "A", "A", "PARENT", 0)], "case_id int, source string, target string, type string, pos int")
    assert [r.direction for r in graph.walk_steps(spark.createDataFrame([(1, "r", ["A", "A"])], "case_id int, route string, walk array<string>"), loop).collect()] == ["reverse"]


def fold_by_hand(edits):
    """{(case, content): (status, provenance, questions, created, updated)}."""
    nodes, version = {}, {}
    unique = lambda *lists: list(dict.fromkeys(x for xs in lists for x in xs))
    for case, _, op, targets, content, q, prov in sorted(edits, key=lambda e: e[:2]):
        if op == "noop":
            continue
        v = version[case] = version.get(case, 0) + 1
        hit = [nodes[t] for t in targets]
        if op in ("merge", "delete"):
            for n in hit:
                n.update(status="archived", updated=v)
        if op in ("add", "merge"):
            made = hashlib.sha256(f"{case}|{v}|{content}".encode()).hexdigest()[:20]
            nodes[made] = {"case": case, "content": content, "status": "active", "prov": unique(prov, *(n["prov"] for n in hit)), "qs": unique(*(n["qs"] for n in hit), [q] if q else []), "created": v, "updated": v}
    return {(n["case"], n["content"]): (n["status"], n["prov"], n["qs"], n["created"], n["updated"]) for n in nodes.values()}


def test_fold_of_merges_of_merges(spark):
    r = random.Random(4)
    edits = []
    for case in (1, 2, 3):
        made, version = [], 0
        for seq in range(25):
            op = r.choice(["add", "add", "merge", "merge", "delete", "noop"]) if len(made) > 1 else "add"
            targets = r.sample(made, r.randint(1, 2)) if op in ("merge", "delete") else []
            version += op != "noop"
            content = f"c{seq}"
            edits.append((case, seq, op, targets, content, r.choice([None, "", "q1", f"q{seq}"]), [f"p{r.randrange(6)}", f"p{r.randrange(6)}"]))
            if op in ("add", "merge"):
                made.append(hashlib.sha256(f"{case}|{version}|{content}".encode()).hexdigest()[:20])
    schema = "case_id long, seq long, op string, targets array<string>, content string, question_id string, provenance array<string>"
    df = spark.createDataFrame(edits, schema).withColumn("source_ids", F.array(F.lit("s"))).withColumn("tags", F.lit(None).cast("array<string>"))
    got = {(n.case_id, n.content): (n.status, n.provenance, n.linked_questions, n.created_version, n.updated_version) for n in memory.fold_edits(df).collect()}
    assert got == fold_by_hand(edits)
    lost = spark.createDataFrame([(1, 1, "delete", ["nobody"], "", None, [])], schema).withColumn("source_ids", F.array().cast("array<string>")).withColumn("tags", F.array().cast("array<string>"))
    with pytest.raises(ValueError, match="don't exist"):
        memory.fold_edits(lost)


def test_a_long_chain_of_merges_takes_few_rounds(spark):
    """Each of 1,000 merges takes the node before: the last rests on all, in order, and on their questions the other way."""
    n, edits, last = 1000, [(1, 1, "add", [], "c1", "q1", ["p1"])], hashlib.sha256(b"1|1|c1").hexdigest()[:20]
    for k in range(2, n + 2):
        edits.append((1, k, "merge", [last], f"c{k}", f"q{k}", [f"p{k}"]))
        last = hashlib.sha256(f"1|{k}|c{k}".encode()).hexdigest()[:20]
    df = spark.createDataFrame(edits, "case_id long, seq long, op string, targets array<string>, content string, question_id string, provenance array<string>").withColumns({"source_ids": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")})
    cuts = []
    rows = {r.id: r for r in memory.fold_edits(df, cut=lambda x: cuts.append(1) or checkpointed(x)).where("status = 'active'").collect()}
    assert list(rows) == [last] and rows[last].provenance == [f"p{k}" for k in range(n + 1, 0, -1)] and rows[last].linked_questions == [f"q{k}" for k in range(1, n + 2)]
    assert len(cuts) - 2 <= 12  # but for the edits and the nodes that merge nothing


def test_store_refuses(spark):
    edits = spark.createDataFrame([(1, 1, "add", [], "one", "q1", ["p"], ["s"], ["t"])], "case_id long, seq long, op string, targets array<string>, content string, question_id string, provenance array<string>, source_ids array<string>, tags array<string>")
    nodes = memory.fold_edits(edits)
    with pytest.raises(ValueError, match="exist"):
        store.add_nodes(nodes, nodes)
    with pytest.raises(ValueError, match="no such"):
        store.archive_nodes(nodes, spark.createDataFrame([(1, "x", 2)], "case_id long, id string, version long"))
    bad = spark.createDataFrame([(1, "q", 1, True, [], 1)], "case_id long, question_id string, seq long, passed boolean, node_ids array<string>, version long")
    with pytest.raises(ValueError, match="without support"):
        store.capability_ledger(bad)
    assert store.advance_iteration(spark.createDataFrame([(1, 4)], "case_id long, iteration long")).first().iteration == 5
    assert store.archive_nodes(nodes, nodes.select("case_id", "id", F.lit(9).cast("long").alias("version"))).first().updated_version == 9


def test_demands_are_errors(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "k int, found boolean")
    assert checks.demand(df.where("k = 1"), F.col("found"), "missing question").count() == 1
    with pytest.raises(Exception, match="missing question"):
        checks.demand(df, F.col("found"), "missing question").collect()


def test_prompts_are_json(spark):
    said = 'a "b"\n\\ ß\t价'
    prompt = one(spark, templates.attacker_payload(F.array(lit(said), lit(None).cast("string")), lit("comparison"), lit("cost"), F.array().cast("array<string>")))
    assert prompt == json.dumps({"target": [said, None], "dimension": "cost", "known": []}, ensure_ascii=False)
    sources = F.array(F.struct(lit("user").alias("role"), lit(None).cast("string").alias("chat_time"), lit(said).alias("content")))
    items = F.array(F.struct(lit(0).alias("id"), lit("what?").alias("question")))
    want = {"mode": "same_topic", "sources": [{"id": 0, "role": "user", "time": None, "content": said}], "items": [{"id": 0, "question": "what?"}]}
    assert one(spark, templates.oracle_payload(lit("same_topic"), sources, items, lit(None).cast("string"))) == json.dumps(want, ensure_ascii=False, separators=(",", ":"))
    row = spark.createDataFrame([("x", datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.date(2024, 1, 2))], "a string, t timestamp, d date")
    assert row.select(templates.plain_values(row.dtypes)).first() == ("x", "2024-01-02T03:04:05.000000Z", "2024-01-02")


def test_reward_hook(spark):
    solutions = spark.createDataFrame([(1, "g", "What is new?"), (2, "g", "two\nlines"), (3, "g", "Known. ")], "id long, group_id string, solution string")
    context = solutions.select("id", F.array().cast("array<string>").alias("identifiers"), F.array(F.lit("known?")).alias("prior"), F.lit(False).alias("oracle_error"), F.lit(True).alias("oracle_valid"), F.lit(0.5).alias("relevance"), F.lit("x").alias("answer"), F.lit(1.0).alias("fidelity"), F.lit("y").alias("golden_answer"), F.lit(False).alias("judge_error"), F.lit(1.0).alias("gold"), F.lit(0.0).alias("parametric"), F.lit(0.0).alias("memory"), F.lit(1.0).alias("value"), F.lit(1.0).alias("novelty"))
    got = {r.id: (r.stage, r.score, r.schema_valid, r.question_valid, r.attack_valid) for r in rewards.compute_score(solutions, context).collect()}
    assert got == {1: ("scored", 1.0, 1.0, 1.0, 1.0), 2: ("schema_invalid", -1.0, 0.0, 0.0, 0.0), 3: ("duplicate", -1.0, 1.0, 1.0, 0.0)}


def test_relevance_and_question_text(spark):
    v = lambda *x: F.array(*map(lit, x))
    assert one(spark, rewards.route_relevance(v(1.0, 0.0), F.array(v(0.0, 1.0), v(3.0, 4.0)))) == pytest.approx(0.6)
    assert one(spark, rewards.route_relevance(v(1.0, 0.0), F.array(v(-1.0, 0.0)))) == 0
    assert one(spark, rewards.question_text(lit("q"), lit("a"))) == "q\nAnswer: a"


def test_cached_plans_and_answers(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id int, query string")
    cache = spark.createDataFrame([("a", '{"rewritten_query":"A"}')], "query string, response string")
    asked = []

    def ask(missing):
        asked.extend(r.query for r in missing.collect())
        return missing.withColumn("response", F.lit('{"keywords":["k"]}'))

    got = {r.query_id: (r.rewritten_query, r.keywords) for r in providers.cached_plans(queries, cache, ask).collect()}
    assert got == {1: ("A", []), 2: ("b", ["k"]), 3: ("b", ["k"])} and asked == ["b"]
    keys = spark.createDataFrame([("r", "What?"), ("r", "what."), ("s", "what")], "route string, q string").select(providers.oracle_key(F.col("route"), F.col("q")).alias("key"))
    assert keys.distinct().count() == 2
    known, missing = providers.cached_results(keys, keys.limit(1).withColumn("result", F.lit("x")))
    assert known.count() + missing.count() >= 3


def test_shuffle_and_draws(spark):
    rows = spark.range(200)
    order = [r.id for r in datasets.shuffled(rows, 3).collect()]
    assert sorted(order) == list(range(200)) and order != sorted(order) and order == [r.id for r in datasets.shuffled(rows.repartition(5), 3).collect()]
    size = datasets.draw_size(1, 2, F.least(F.lit(3), F.col("id") + 2), "id")
    sizes = [r.n for r in rows.select(size.alias("n")).collect()]
    assert set(sizes) == {2, 3} and 60 < sizes.count(3) < 140 and sizes[0] == 2


def test_split_membership(spark):
    df = spark.createDataFrame([(k, "a" if k < 25 else "b") for k in range(26)], "id long, mode string")
    got = datasets.stratified_split(df).collect()
    assert sum(r.split == "val" for r in got) == 2 and len({r.id for r in got}) == 26
    assert sum(r.mode == "b" for r in datasets.stratified_split(df, strict=True).collect()) == 2


def test_oracle_reconciliation(spark):
    asked = spark.createDataFrame([(0, k) for k in (0, 1, 2)], "batch int, item int")
    back = spark.createDataFrame([(0, k) for k in (0, 1, 1, 7)], "batch int, item int")
    assert {r.item: r.status for r in rewards.reconciled(asked, back).collect()} == {0: "ok", 1: "duplicate", 2: "omitted"}


def test_answer_contexts(spark):
    """Against strings worked out by hand."""
    source = spark.createDataFrame([([("n:0", "2024-01-02", "user", "I moved."), ("n:1", None, "assistant", "Where?")],)], "s array<struct<source_id:string,chat_time:string,role:string,content:string>>")
    assert source.select(templates.source_block(F.col("s"))).first()[0] == "[n:0] time=2024-01-02 role=user\nI moved.\n\n[n:1] time=None role=assistant\nWhere?"
    memory_ = spark.createDataFrame([([("a", ("2024", None), "x"), ("b", None, "y")],)], "m array<struct<id:string,time_span:struct<start:string,end:string>,content:string>>")
    block = templates.memory_block(F.col("m"))
    assert memory_.select(block).first()[0] == "[a] time=('2024', None)\nx\n\n[b] time=None\ny"
    turns = memory_.select(templates.answer_prompt(lit("When?"), block, "Be brief.")).first()[0]
    assert [t.asDict() for t in turns] == [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "Context:\n[a] time=('2024', None)\nx\n\n[b] time=None\ny\n\nQuestion:\nWhen?"}]
