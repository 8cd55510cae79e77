"""Queries of the memory store, rounds and routes; ``SQL`` has the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators import compaction, convergence, datasets, graph, memory, retrieval, rewards, rounds, store
from engram.session import checkpointed, small_side
from engram.sources import graphs

from .views import Views

_K = "event_id"


def _strings(*columns):
    return F.array(*((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)).cast("array<string>")


def _nodes(v: Views) -> DataFrame:
    """A customer's orders as memory nodes of version 1."""
    k = F.col("o_orderkey")
    return v.table("orders").select(
        F.col("o_custkey").alias("case_id"), k.cast("string").alias("id"), F.concat_ws(" ", "o_orderpriority", F.lit("order"), k.cast("string")).alias("content"), F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active").alias("status"),
        _strings(F.concat(F.lit("p"), k % 4)).alias("provenance"), _strings(k, F.lit("s")).alias("source_ids"), _strings(F.concat(F.lit("q"), k % 6), F.concat(F.lit("q"), k % 10)).alias("linked_questions"), _strings("o_orderstatus").alias("tags"),
        F.lit(None).cast("struct<start:string,end:string>").alias("time_span"), F.lit(3).alias("token_count"), F.lit(1).cast("long").alias("created_version"), F.lit(1).cast("long").alias("updated_version"),
    ).withColumn("linked_questions", F.array_distinct("linked_questions"))


def _actions(v: Views) -> DataFrame:
    """One edit a customer: their two dearest orders are merged, the dearest deleted, or something is added or nothing."""
    o = v.table("orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("o_totalprice"), "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), 1, 2).alias("top"))
    k = F.col("case_id")
    op = F.element_at(F.array(*map(F.lit, ("merge", "delete", "add", "noop"))), (k % 4 + 1).cast("int"))
    targets = F.when(op == "merge", F.col("top")).when(op == "delete", F.slice("top", 1, 1)).otherwise(_strings())
    span = memory.time_hull(F.array(F.lit("2024-02-01"), F.when(k % 3 == 0, "2024-01-15")))
    return o.select("case_id", F.lit(2).cast("long").alias("version"), op.alias("op"), targets.alias("targets"), F.concat(F.lit("memory of "), k.cast("string")).alias("content"), F.lit("q1").alias("question_id"), _strings(F.lit("p1"), F.lit("p9")).alias("provenance"), _strings(F.lit("s")).alias("source_ids"), _strings(F.lit("new")).alias("tags"), span.alias("time_span"))


def _shown(nodes: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return nodes.select("case_id", "id", "status", join("provenance"), join("source_ids"), join("linked_questions"), join("tags"), F.concat_ws("..", "time_span.start", "time_span.end").alias("time_span"), F.col("token_count").cast("long").alias("token_count"), "created_version", "updated_version")


def store_apply(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return _shown(store.apply_actions(_nodes(v), _actions(v)))


def store_compact(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return _shown(store.compact(_nodes(v), _actions(v)))


def store_add_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders are new, those done are archived after."""
    v = Views(spark, sf)
    n = _nodes(v)
    old, new = n.where("content not like '1-URGENT%'"), n.where("content like '1-URGENT%'").withColumn("created_version", F.lit(2).cast("long"))
    both = store.add_nodes(old, new)
    gone = both.where("array_contains(tags, 'P')").select("case_id", "id", F.lit(3).cast("long").alias("version"))
    return _shown(store.archive_nodes(both, gone))


def store_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Questions q1 to q3 are bound to a customer's first order, and q2 once more to its last."""
    v = Views(spark, sf)
    ends = v.table("orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderkey").cast("string").alias("a"), F.max("o_orderkey").cast("string").alias("b"))
    rows = ends.select("case_id", F.explode(F.array(*(F.struct(F.lit(q).alias("question_id"), F.lit(s).alias("seq"), F.array(F.col(c)).alias("node_ids")) for q, s, c in (("q1", 1, "a"), ("q2", 2, "a"), ("q3", 3, "a"), ("q2", 4, "b"))))).alias("r"))
    out = store.bind_questions(_nodes(v), rows.select("case_id", "r.*"))
    return out.select("case_id", "id", "updated_version", F.array_join("linked_questions", ",").alias("linked_questions"))


def capability_ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).edits()
    events = e.select("case_id", F.col("k").alias("question_id"), "seq", (F.col("op") != "delete").alias("passed"), _strings(F.col(_K) % 9).alias("node_ids"), F.col("seq").alias("version"))
    return store.capability_ledger(events).withColumn("supporting_node_ids", F.array_join("supporting_node_ids", ","))


def _judged(total: Column) -> list[Column]:
    """A stand-in judge: correctness and error by a number that stands for the memories shown."""
    return [F.when(total % 7 != 0, (total % 11) / 10).alias("correctness"), F.when(total % 7 == 0, "no answer").alias("error")]


def defence_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Questions are asked of the five memories that the hybrid retrieval finds, and successes of ever fewer of them; a
    stand-in judge goes by the texts' length in all."""
    from .queries import hybrid_retrieve

    v = Views(spark, sf)
    asked = v.queries().select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
    found = checkpointed(hybrid_retrieve(spark, sf).select(F.col("query_id").alias("question_id"), "id", "rank"))
    texts = v.memories().select("id", "content").join(small_side(found.select("id").distinct()), "id", "left_semi")
    sizes = checkpointed(texts.select("id", F.length("content").cast("long").alias("n")))  # a trial reads no texts again

    def judge(rows: DataFrame) -> DataFrame:
        each = rows.select("question_id", F.explode("node_ids").alias("id")).join(sizes, "id").groupBy("question_id").agg(F.sum("n").alias("n"))
        return each.select("question_id", *_judged(F.col("n")))

    out = rounds.evaluated(asked, lambda q: found.join(q.select("question_id"), "question_id", "left_semi"), judge, 0.5)
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("question_id", shown("node_ids"), "correctness", "outcome", shown("support"))


def commit_round(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of the store's queries, tried; a question then retrieves five of the memories linked to it and keeps those it needs."""
    v = Views(spark, sf)
    k = F.col("case_id")
    actions = _actions(v)
    pending = actions.select("case_id", "question_id", F.lit("q").alias("question"), (k % 5 != 0).alias("commit_valid"), F.when(k % 7 == 0, 0.0).otherwise(0.5).alias("score"))

    def retrieve(asked: DataFrame, nodes: DataFrame) -> DataFrame:
        linked = nodes.where("status = 'active'").select("case_id", "id", F.explode("linked_questions").alias("question_id"))
        rank = F.row_number().over(Window.partitionBy("case_id", "question_id").orderBy("id"))
        return asked.select("case_id", "question_id").join(linked, ["case_id", "question_id"]).withColumn("rank", rank).where("rank <= 5")

    def judge(trials: DataFrame, nodes: DataFrame) -> DataFrame:
        ends = F.aggregate(F.transform("node_ids", lambda i: F.ascii(F.right(i, F.lit(1)))), F.lit(0), lambda a, x: a + x)
        return trials.select("question_id", *_judged(ends))

    after, outcomes = rounds.commit_round(_nodes(v), pending, actions, retrieve, judge, 0.5)
    n = after.groupBy("case_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.array_contains("linked_questions", "q1")).alias("support"))
    return outcomes.select("case_id", "outcome", "pool").join(n, "case_id")


def compaction_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each customer's open orders, of which a stand-in policy merges or deletes; a question retrieves three of
    the memories linked to it, and a stand-in judge goes by their names."""
    v = Views(spark, sf)
    nodes, k = _nodes(v), F.col("case_id")
    pairs = convergence.compaction_candidates(nodes.where("status = 'active'").withColumn("pos", F.col("id").cast("long")).select("case_id", "pos", "id", "tags"), compaction.MOST)
    merge = (F.size("ids") == 2) & ((k + F.col("place")) % 2 == 0)
    op, targets = F.when(merge, "merge").otherwise("delete"), F.when(merge, F.col("ids")).otherwise(F.slice("ids", 1, 1))
    actions = pairs.select("case_id", "place", ((k + F.col("place")) % 3 != 0).alias("valid"), op.alias("op"), targets.alias("targets"), F.concat(F.lit("memory of "), k.cast("string")).alias("content"), _strings().alias("tags"))
    every = nodes.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq")).withColumn("question_id", F.concat(F.lit("q"), "seq"))

    def retrieve(asked: DataFrame, held: DataFrame) -> DataFrame:
        linked = held.where("status = 'active'").select("case_id", "id", "trial", "without", F.explode("linked_questions").alias("question_id"))
        # no trial shows a node that follows three which all trials have
        before = Window.partitionBy("case_id", "question_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        few = linked.withColumn("n", F.count_if(F.col("trial").isNull() & (F.size("without") == 0)).over(before)).where("n < 3")
        lists = few.groupBy("case_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("id", "trial", "without"))).alias("few"))
        ids = F.transform(F.filter("few", compaction.seen), lambda x: x["id"])
        return asked.join(lists, ["case_id", "question_id"], "left").withColumn("node_ids", F.slice(ids, 1, 3)).drop("few")

    def judge(rows: DataFrame, held: DataFrame) -> DataFrame:
        ends = F.aggregate(F.transform("node_ids", lambda i: F.ascii(F.right(i, F.lit(1)))), F.lit(0), lambda a, x: a + x)
        return rows.select("question_id", F.when(ends % 29 != 0, 1 - (ends % 7) / 20).alias("correctness"))

    pool, archive = every.where("seq < 6"), every.where("seq <> 7").select("case_id", "question_id", F.lit("what?").alias("question"))
    after, audits = compaction.tried_compactions(nodes, actions, pool, archive, retrieve, judge, 0.2, 0.71)
    n = after.groupBy("case_id").agg(F.sum(F.when(F.col("status") == "active", F.col("token_count")).otherwise(0)).cast("long").alias("tokens"), F.count("*").alias("nodes"), F.sum(F.size("linked_questions")).cast("long").alias("links"))
    return audits.select("case_id", "compressed", "attempts").join(n, "case_id")


def kept_questions(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    out = rounds.kept_questions(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus <> 'F'"), o.where("o_totalprice > 50000"))
    return out.withColumn("place", F.col("place").cast("long"))


def visit_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    routes = graph.same_topic(v.edges(), v.nodes()).select("case_id", F.slice("facts", 1, 3).alias("evidence"))
    return datasets.visit_counts(routes.unionByName(routes.select("case_id", F.slice("evidence", 1, 1).alias("evidence"))))


#: Saturated rounds in a row that end a case.
PATIENCE = 6


def active_cases(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    cases = v.rounds().select("case_id").distinct()
    return convergence.active_cases(cases, convergence.streaks(v.rounds(), PATIENCE))


def compaction_actions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(_K)
    op = F.element_at(F.array(*map(F.lit, ("add", "merge", "delete", "noop"))), (k % 4 + 1).cast("int"))
    targets = F.when(k % 3 == 0, F.array().cast("array<bigint>")).when(k % 3 == 1, F.array(k % 7)).otherwise(F.array(k % 4, k % 6))
    return Views(spark, sf).table("events").select(_K, rewards.compaction_valid(op, targets, F.array(*(F.lit(x).cast("long") for x in range(5)))).alias("valid"))


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer by an outside score that some lack, the best four."""
    o = Views(spark, sf).table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"))
    scores = o.where("id % 3 <> 0").select("query_id", "id", (F.col("id") % 10 / 10).alias("rerank"))
    return retrieval.reranked(o, scores, 4).withColumn("rank", F.col("rank").cast("long"))


def random_split(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").select(F.col("o_orderkey").alias("id"))
    return datasets.random_split(o, 0.2, 3).groupBy("split").agg(F.count("*").alias("n"))


def drawn_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes over two or three facts of a topic, drawn by inverse visits of the topics' first facts; draws have no SQL."""
    v = Views(spark, sf)
    return graph.drawn_routes(v.edges(), v.nodes(), visits=visit_counts(spark, sf), seed=5)


def unseen_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of the topics that no route was taken from before."""
    v = Views(spark, sf)
    s = graph.same_topic(v.edges(), v.nodes()).withColumn("walk", graph.topic_walk(F.col("topic"), F.slice("facts", 1, 3)))
    named = s.select("case_id", "topic", graph.walk_signature(F.col("case_id").cast("string"), F.lit("same_topic"), F.lit(None).cast("string"), F.col("walk")).alias("signature"))
    return datasets.unseen(named, named.where("case_id < 12").select("signature")).select("case_id", "topic")


def mode_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.mode_candidates(v.edges(), v.nodes()).groupBy("case_id", "mode").agg(F.count("*").alias("n"), F.sum(F.size("walk")).cast("long").alias("steps"))


def frozen_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A context for each customer's first order: what is known of them now, read back as it was."""
    v = Views(spark, sf)
    o = v.table("orders")
    routes = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderkey").alias("route")).withColumn("question", F.lit("secret")).withColumn("answer", F.lit("secret"))
    ledger = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"))
    nodes = _nodes(v).select("case_id", "id", "content", "status")
    frozen = rounds.frozen_contexts(rounds.guarded(routes), nodes, ledger, routes.select("case_id", F.lit(1).alias("memory_version")))
    back = rounds.thawed_nodes(frozen).groupBy("case_id", "route").agg(F.count("*").alias("nodes"), F.min("id").alias("least"))
    text = F.array_join(F.transform("prior_questions", lambda q: F.concat_ws("=", q["question"], q["answer"])), ",")
    return frozen.select("case_id", "route", "memory_version", text.alias("prior")).join(back, ["case_id", "route"])


def graph_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of two users, and how many edges each has among both."""
    v = Views(spark, sf)
    named = v.nodes().select("id", F.concat(F.lit("u"), "case_id").alias("user_name"), F.col("chat_time").cast("string").alias("created_at"), F.lit(0).alias("embedding_small"))
    users = ["u1", "u10"]
    edges = graphs.edge_scan(v.edges().withColumn("properties", F.lit("{}")), named, users)
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("edges"))
    return graphs.node_scan(named, users).join(degree, "id", "left").fillna(0, ["edges"]).select("id", "user_name", "edges")


def case_users(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.case_users(spark, "v1", 12)


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    paths = Views(spark, sf).table("customer").select(F.concat(F.lit("/run/global_step_"), "c_custkey").alias("path"))
    return graphs.latest_checkpoint(paths.unionByName(paths.select(F.concat("path", F.lit(".old")).alias("path"))))


_NODES = """
n AS (SELECT o_custkey AS case_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS pr, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status, ['p' || o_orderkey % 4] AS provenance, [CAST(o_orderkey AS VARCHAR), 's'] AS source_ids,
  CASE WHEN o_orderkey % 6 = o_orderkey % 10 THEN ['q' || o_orderkey % 6] ELSE ['q' || o_orderkey % 6, 'q' || o_orderkey % 10] END AS linked, [o_orderstatus] AS tags, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) AS i FROM orders)"""
_FIRSTS = "list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _applied(own_p: str, own_s: str, own_q: str, span: str) -> str:
    first = lambda c: _FIRSTS.format(c=c)
    return f"""{_NODES},
t AS (SELECT * FROM n WHERE (case_id % 4 = 0 AND i <= 2) OR (case_id % 4 = 1 AND i = 1)),
l AS (SELECT c.case_id, coalesce(flatten(list(t.provenance ORDER BY i) FILTER (t.id IS NOT NULL)), []) AS p, coalesce(flatten(list(t.source_ids ORDER BY i) FILTER (t.id IS NOT NULL)), []) AS s, coalesce(flatten(list(t.linked ORDER BY i) FILTER (t.id IS NOT NULL)), []) AS q, coalesce(flatten(list(t.tags ORDER BY i) FILTER (t.id IS NOT NULL)), []) AS g
  FROM (SELECT DISTINCT case_id FROM n WHERE case_id % 4 IN (0, 2)) c LEFT JOIN t ON c.case_id = t.case_id GROUP BY c.case_id),
m AS (SELECT case_id, list_concat({own_p}, p) AS p, list_concat({own_s}, s) AS s, list_concat(q, {own_q}) AS q, list_concat(['new'], g) AS g FROM l),
made AS (SELECT case_id, substring(sha256(case_id || '|2|memory of ' || case_id), 1, 20) AS id, 'active' AS status, array_to_string({first("p")}, ',') AS provenance, array_to_string({first("s")}, ',') AS source_ids, array_to_string({first("q")}, ',') AS linked_questions, array_to_string({first("g")}, ',') AS tags,
  {span} AS time_span, CAST(3 AS BIGINT) AS token_count, CAST(2 AS BIGINT) AS created_version, CAST(2 AS BIGINT) AS updated_version FROM m),
kept AS (SELECT n.case_id, n.id, CASE WHEN t.id IS NOT NULL THEN 'archived' ELSE n.status END AS status, n.provenance, n.source_ids, n.linked, n.tags, CASE WHEN t.id IS NOT NULL THEN 2 ELSE 1 END AS v FROM n LEFT JOIN t ON n.id = t.id)"""


_SPAN = "CASE WHEN case_id % 3 = 0 THEN '2024-01-15..2024-02-01' ELSE '2024-02-01..2024-02-01' END"
_JOINED = "array_to_string(provenance, ',') AS provenance, array_to_string(source_ids, ',') AS source_ids, array_to_string(linked, ',') AS linked_questions, array_to_string(tags, ',') AS tags"
_AFTER = f"SELECT case_id, id, status, {_JOINED}, '' AS time_span, CAST(3 AS BIGINT) AS token_count, CAST(1 AS BIGINT) AS created_version, CAST(v AS BIGINT) AS updated_version FROM kept UNION ALL SELECT * FROM made"


def eliminated(hits: str, key: str, passes: str = "{n} % 7 <> 0 AND {n} % 11 >= 5", most: int = 5) -> str:
    """Backward elimination of ``nodes`` (id and n, in rank order), ``most`` at most, by what a stand-in judge ``passes``: the
    last of the tables el0, el1 and so on has what is kept."""
    steps = [f"el0 AS (SELECT *, nodes AS kept FROM {hits})"]
    test = passes.format(n="list_sum(list_transform(rest, lambda x: x.n))")
    for k in range(most):
        steps.append(f"""
el{k + 1} AS (SELECT {key}, nodes, CASE WHEN len(nodes) > {k} AND len(rest) > 0 AND {test} THEN rest ELSE kept END AS kept
  FROM (SELECT *, CASE WHEN len(nodes) > {k} THEN list_filter(kept, lambda x: x.id <> nodes[len(nodes) - {k}].id) ELSE kept END AS rest FROM el{k}))""")
    return ",".join(steps)


def _answers(name: str, asked: str, live: str, key: str) -> str:
    """Three memories of each question, and what the stand-in judge of ``compaction_trials`` says of them."""
    return f"""
{name}h AS (SELECT p.{key}, p.q, id, row_number() OVER (PARTITION BY p.{key}, p.q ORDER BY id) AS rank FROM {asked} p JOIN {live} l ON p.{key} = l.{key} AND p.q = l.q QUALIFY rank <= 3),
{name}l AS (SELECT {key}, q, list({{'id': id, 'n': ascii(right(id, 1))}} ORDER BY rank) AS nodes, sum(ascii(right(id, 1))) AS n FROM {name}h GROUP BY {key}, q),
{name} AS (SELECT p.{key}, p.q, nodes, CASE WHEN n IS NULL THEN 0.0::DOUBLE WHEN n % 29 <> 0 THEN 1 - (n % 7) / 20.0::DOUBLE END AS c FROM {asked} p LEFT JOIN {name}l l ON p.{key} = l.{key} AND p.q = l.q)"""


_TRIALS = f"""
ap AS (SELECT case_id, id, tags, row_number() OVER (PARTITION BY case_id ORDER BY CAST(id AS BIGINT)) AS r FROM n WHERE status = 'active'),
x AS (SELECT a.case_id, CASE WHEN list_has_any(a.tags, b.tags) THEN 0 ELSE 1 END AS kind, a.r AS i, b.r AS j, [a.id, b.id] AS ids FROM ap a JOIN ap b ON a.case_id = b.case_id AND a.r < b.r UNION ALL SELECT case_id, 2, r, 0, [id] FROM ap),
c AS (SELECT case_id, ids, row_number() OVER (PARTITION BY case_id ORDER BY kind, i, j) AS place FROM x QUALIFY place <= 8),
tr AS (SELECT case_id, place, case_id * 8 + place - 1 AS k, merge, CASE WHEN merge THEN ids ELSE ids[1:1] END AS t FROM (SELECT *, len(ids) = 2 AND (case_id + place) % 2 = 0 AS merge FROM c) WHERE (case_id + place) % 3 <> 0),
mg AS (SELECT DISTINCT tr.k, substring(sha256(tr.k || '|2|memory of ' || tr.case_id), 1, 20) AS id, unnest(linked) AS q FROM tr JOIN n ON tr.case_id = n.case_id AND list_contains(t, n.id) WHERE merge),
old AS (SELECT k, n.id, n.status = 'active' AND NOT list_contains(t, n.id) AS active, linked FROM tr JOIN n ON tr.case_id = n.case_id),
live AS (SELECT k, id, unnest(linked) AS q FROM old WHERE active UNION ALL SELECT k, id, q FROM mg),
prot AS (SELECT DISTINCT k, q FROM (SELECT k, unnest(linked) AS q FROM tr JOIN n ON tr.case_id = n.case_id AND list_contains(t, n.id) UNION ALL SELECT k, 'q' || j FROM tr, range(4) y(j)) WHERE q <> 'q7'),
was AS (SELECT case_id, unnest(linked) AS q, id FROM n WHERE status = 'active'), asked AS (SELECT DISTINCT case_id, q FROM prot JOIN tr ON prot.k = tr.k),
{_answers("a", "prot", "live", "k")}, {_answers("b", "asked", "was", "case_id")},
ok AS (SELECT tr.case_id, tr.place, tr.k FROM tr JOIN a ON tr.k = a.k JOIN b ON tr.case_id = b.case_id AND a.q = b.q GROUP BY ALL HAVING bool_and(coalesce(a.c >= 0.71 AND b.c - a.c <= 0.2, false))),
best AS (SELECT case_id, min(place) AS place, arg_min(k, place) AS k FROM ok GROUP BY case_id),
sup AS (SELECT a.k, a.q, nodes FROM a JOIN best ON a.k = best.k), {eliminated("sup", "k, q", "{n} % 29 <> 0 AND {n} % 7 <= 5", 3)},
links AS (
  SELECT best.case_id, count(*) AS n FROM best JOIN (SELECT k, id, unnest(linked) AS q FROM old UNION ALL SELECT k, id, q FROM mg) l ON best.k = l.k WHERE (l.k, l.q) NOT IN (SELECT (k, q) FROM prot) GROUP BY best.case_id),
bound AS (SELECT best.case_id, sum(len(kept)) AS n FROM best JOIN el3 ON best.k = el3.k GROUP BY best.case_id),
s AS (SELECT case_id, count(*) AS nodes, count(*) FILTER (status = 'active') AS active, sum(len(linked)) AS links FROM n GROUP BY case_id),
m AS (SELECT case_id, count(*) AS n FROM c GROUP BY case_id)
SELECT m.case_id, best.k IS NOT NULL AS compressed, coalesce(best.place, m.n) AS attempts, 3 * (s.active - (best.k IS NOT NULL)::INT) AS tokens,
  s.nodes + CASE WHEN tr.merge THEN 1 ELSE 0 END AS nodes, CAST(CASE WHEN best.k IS NULL THEN s.links ELSE coalesce(links.n, 0) + coalesce(bound.n, 0) END AS BIGINT) AS links
FROM m JOIN s ON m.case_id = s.case_id LEFT JOIN best ON m.case_id = best.case_id LEFT JOIN tr ON best.k = tr.k LEFT JOIN links ON m.case_id = links.case_id LEFT JOIN bound ON m.case_id = bound.case_id"""


def build(graph_cte: str, edits_cte: str, bm25_token: str) -> dict[str, str]:
    """SQL of the queries, over the common tables of the other module."""
    return {
        "store_apply": f"WITH {_applied("['p1', 'p9']", "['s']", "['q1']", _SPAN)} {_AFTER}",
        "store_compact": f"WITH {_applied("[]", "[]", "[]", "''")} {_AFTER}",
        "store_add_archive": f"""WITH {_NODES} SELECT case_id, id, CASE WHEN tags = ['P'] THEN 'archived' WHEN pr = '1-URGENT' THEN 'active' ELSE status END AS status, {_JOINED}, '' AS time_span, CAST(3 AS BIGINT) AS token_count,
  CAST(CASE WHEN pr = '1-URGENT' THEN 2 ELSE 1 END AS BIGINT) AS created_version, CAST(CASE WHEN tags = ['P'] THEN 3 WHEN pr = '1-URGENT' THEN 2 ELSE 1 END AS BIGINT) AS updated_version FROM n""",
        "store_bind": f"""WITH {_NODES}, x AS (SELECT *, CAST(id AS BIGINT) = min(CAST(id AS BIGINT)) OVER (PARTITION BY case_id) AS a, CAST(id AS BIGINT) = max(CAST(id AS BIGINT)) OVER (PARTITION BY case_id) AS z FROM n),
k AS (SELECT *, list_filter(linked, lambda q: NOT (q = 'q1' AND NOT a) AND NOT (q = 'q2' AND NOT z) AND NOT (q = 'q3' AND NOT a)) AS l FROM x),
b AS (SELECT *, list_concat(l, list_filter([CASE WHEN a AND NOT list_contains(linked, 'q1') THEN 'q1' END, CASE WHEN a AND NOT list_contains(linked, 'q3') THEN 'q3' END, CASE WHEN z AND NOT list_contains(linked, 'q2') THEN 'q2' END], lambda q: q IS NOT NULL)) AS l2 FROM k)
SELECT case_id, id, CAST(1 AS BIGINT) AS updated_version, array_to_string(l2, ',') AS linked_questions FROM b""",
        "capability_ledger": f"""WITH {edits_cte}, l AS (SELECT case_id, k AS question_id, min(seq) AS place, arg_max(op, seq) <> 'delete' AS passed, arg_max(event_id % 9, seq) AS node, max(seq) AS last FROM ed GROUP BY case_id, k)
SELECT case_id, question_id, place, passed, CASE WHEN passed THEN CAST(node AS VARCHAR) ELSE '' END AS supporting_node_ids, CASE WHEN passed THEN last END AS verified_version FROM l""",
        "commit_round": f"""WITH {_applied("['p1', 'p9']", "['s']", "['q1']", _SPAN)},
tried AS (SELECT case_id, id, status, linked AS l FROM kept WHERE true UNION ALL SELECT case_id, id, status, string_split(linked_questions, ',') FROM made),
p AS (SELECT DISTINCT case_id, case_id % 5 <> 0 AND case_id % 7 <> 0 AS good FROM n),
h1 AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS rank FROM tried WHERE status = 'active' AND list_contains(l, 'q1')),
h2 AS (SELECT case_id, list({{'id': id, 'n': ascii(right(id, 1))}} ORDER BY rank) AS nodes FROM h1 WHERE rank <= 5 GROUP BY case_id), {eliminated("h2", "case_id")},
h AS (SELECT case_id, len(kept) AS hits FROM el5),
o AS (SELECT p.case_id, CASE WHEN NOT good THEN 'discarded' WHEN coalesce(hits, 0) > 0 THEN 'committed' ELSE 'unsupported' END AS outcome, coalesce(hits, 0) AS hits FROM p LEFT JOIN h ON p.case_id = h.case_id),
a AS (SELECT tried.case_id, status FROM tried JOIN o ON tried.case_id = o.case_id WHERE outcome = 'committed' UNION ALL SELECT n.case_id, status FROM n JOIN o ON n.case_id = o.case_id WHERE outcome <> 'committed')
SELECT o.case_id, outcome, CASE WHEN outcome = 'committed' THEN 'success' ELSE 'high_priority' END AS pool, count(*) AS nodes, count(*) FILTER (status = 'active') AS active, CASE WHEN outcome = 'committed' THEN hits ELSE 0 END AS support
FROM o JOIN a ON o.case_id = a.case_id GROUP BY o.case_id, outcome, hits""",
        "compaction_trials": f"WITH {_NODES}, {_TRIALS}",
        "kept_questions": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'F' ORDER BY o_orderkey) AS k FROM orders),
c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus <> 'F' AND k <= 4 THEN 1 END AS p, o_totalprice FROM o)
SELECT o_custkey AS case_id, o_orderkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS place FROM c WHERE p IS NOT NULL AND o_totalprice > 50000""",
        "visit_counts": f"WITH {graph_cte}, v AS (SELECT case_id, unnest(list_slice(facts, 1, 3)) AS node_id FROM st UNION ALL SELECT case_id, facts[1] FROM st) SELECT case_id, node_id, count(*) AS visits FROM v GROUP BY ALL",
        "active_cases": """WITH r AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS round, count(*) FILTER (event_type = 'error') = 0 AS s FROM events GROUP BY 1, 2),
p AS (SELECT *, count(*) FILTER (s) OVER (PARTITION BY case_id ORDER BY round ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS k FROM r) SELECT case_id FROM p GROUP BY case_id HAVING max(k) < 6""",
        "compaction_actions": """WITH a AS (SELECT event_id, ['add', 'merge', 'delete', 'noop'][event_id % 4 + 1] AS op, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN [event_id % 7] ELSE [event_id % 4, event_id % 6] END AS t FROM events)
SELECT event_id, len(t) > 0 AND len(list_filter(t, lambda x: x > 4)) = 0 AND (op = 'delete' OR (op = 'merge' AND len(t) >= 2)) AS valid FROM a""",
        "rerank": """WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 / 10.0 ELSE 0 END::DOUBLE AS rerank FROM orders)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, id) AS rank FROM s) WHERE rank <= 4""",
        "random_split": "WITH n AS (SELECT count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS v FROM orders) SELECT 'val' AS split, v AS n FROM n UNION ALL SELECT 'train', n - v FROM n",
        "unseen_routes": f"WITH {graph_cte} SELECT case_id, topic FROM st WHERE case_id >= 12",
        "frozen_contexts": """SELECT o_custkey AS case_id, min(o_orderkey) AS route, 1 AS memory_version, string_agg(o_orderpriority || '=' || o_orderstatus, ',' ORDER BY o_orderkey) AS prior, count(*) AS nodes, min(CAST(o_orderkey AS VARCHAR)) AS least FROM orders GROUP BY o_custkey""",
        "graph_scan": f"""WITH {graph_cte}, e AS (SELECT e.* FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE a.case_id IN (1, 10) AND b.case_id IN (1, 10)),
g AS (SELECT id, count(*) AS edges FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT nodes.id, 'u' || case_id AS user_name, coalesce(g.edges, 0) AS edges FROM nodes LEFT JOIN g ON nodes.id = g.id WHERE case_id IN (1, 10)""",
        "case_users": "SELECT 'lme_exper_user_v1_' || range AS user_name FROM range(12)",
        "checkpoints": "SELECT '/run/global_step_' || max(c_custkey) AS path FROM customer",
    }


QUERIES = [
    store_apply, store_compact, store_add_archive, store_bind, capability_ledger, defence_evaluation, commit_round, compaction_trials, kept_questions, visit_counts, active_cases, compaction_actions, rerank, random_split,
    drawn_routes, unseen_routes, mode_candidates, frozen_contexts, graph_scan, case_users, checkpoints,
]
