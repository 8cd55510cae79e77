"""One query for each operator family, over the views; ``SQL`` holds the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import jsonx, templates, text
from engram.operators import convergence, datasets, graph, laps, memory, retrieval, rewards, rounds

from .views import Views


def case_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.case_summary(v.nodes(), v.edges())


def relation_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_histogram(Views(spark, sf).edges())


def case_edges(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    active = v.nodes().where("status = 'activated'")
    return graph.case_edges(v.edges(), active)


def case_index_parse(spark: SparkSession, sf: str) -> DataFrame:
    n = Views(spark, sf).table("nation")
    users = n.select(F.concat(F.when(F.col("n_regionkey") == 0, "other_").otherwise("lme_exper_user_v1_"), "n_nationkey").alias("user_name"))
    return users.select("user_name", graph.case_index(F.col("user_name"), "v1").alias("case_index"))


def missing_users(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    wanted = v.table("customer").select(F.col("c_name").alias("user_name"))
    have = v.table("orders").where("o_orderstatus = 'P'").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("user_name"))
    return graph.missing_users(wanted, have)


def topic_fact_index(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.topic_facts(v.edges(), v.nodes())


def single_fact_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.single_fact(Views(spark, sf).nodes()).select("case_id", F.col("walk")[0].alias("fact"))


def same_topic_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.same_topic(v.edges(), v.nodes()).select("case_id", "topic", "n_facts", F.array_join("facts", ",").alias("facts"))


def temporal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.temporal(v.edges(), v.nodes())


def comparison_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return graph.comparison(v.edges(), v.nodes())


def comparison_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of facts to compare there are of so many visits: what a weighted draw goes by."""
    v = Views(spark, sf)
    visits = v.nodes().select("case_id", F.col("id").alias("node_id"), (F.length("memory") % 3).alias("visits"))
    return laps.pair_classes(laps.compared_facts(v.edges(), v.nodes()), visits).select("case_id", "topic", "dimension", "low", "high", "pairs")


def route_laps(spark: SparkSession, sf: str) -> DataFrame:
    """Six routes of each case in laps over all modes: how many of each mode, in which laps, and that they differ."""
    v = Views(spark, sf)
    r = laps.lap_routes(v.edges(), v.nodes(), 6, seed=3)
    return r.groupBy("case_id", "mode").agg(F.count("*").alias("routes"), F.count_distinct("signature").alias("signatures"), F.min("lap").alias("first_lap"), F.max("lap").alias("last_lap"))


def walk_signature(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    s = graph.same_topic(v.edges(), v.nodes()).withColumn("walk", graph.topic_walk(F.col("topic"), F.slice("facts", 1, 3)))
    return s.select("case_id", "topic", F.array_join("walk", ">").alias("walk"), graph.walk_signature(F.col("case_id").cast("string"), F.lit("same_topic"), F.lit(None).cast("string"), F.col("walk")).alias("signature"))


def walk_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Directions of walks where some parents also have an edge the other way."""
    v = Views(spark, sf)
    s = graph.same_topic(v.edges(), v.nodes()).select("case_id", F.col("topic").alias("route"), graph.topic_walk(F.col("topic"), F.slice("facts", 1, 3)).alias("walk"))
    opposed = v.edges().where("type = 'PARENT' and length(concat(source, target)) % 2 = 0").select("case_id", F.col("target").alias("source"), F.col("source").alias("target"), "type")
    return graph.walk_steps(s, v.edges().unionByName(opposed))


def source_dedup(spark: SparkSession, sf: str) -> DataFrame:
    c = Views(spark, sf).table("conversations")
    s = c.select((F.col("conv_id") % 20).alias("route"), F.col("conv_id").alias("node_pos"), F.col("turn").alias("source_pos"), F.concat_ws(":", "conv_id", "turn").alias("source_id"), "role", F.lit(None).cast("string").alias("chat_time"), F.coalesce("text", F.lit("")).alias("content"))
    return graph.canonical_sources(s).select("route", "source_id", "canonical_id")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Views(spark, sf).memories().select("id", text.token_count(F.col("content")).cast("long").alias("tokens"))


def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_frequencies(retrieval.term_frequencies(Views(spark, sf).memories()))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return retrieval.top_k(retrieval.bm25(v.queries(), v.memories(), k=retrieval.RECALL_K), retrieval.RECALL_K)


def _embeddings(v: Views) -> DataFrame:
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


#: Searches ask for every row whose id is divisible by 20, against all rows.
ASKED = "id % 20 = 0"


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(Views(spark, sf))
    queries = e.where(ASKED).withColumnRenamed("id", "query_id")
    return retrieval.top_k(retrieval.vector_scores(queries, e, retrieval.RECALL_K), retrieval.RECALL_K)


def _plans(v: Views) -> DataFrame:
    """Keywords are all of the query's words."""
    words = F.array_distinct(text.tokens(F.col("query")))
    return v.queries().select("query_id", "query", F.col("query").alias("rewritten_query"), words.alias("keywords"), F.array(F.concat(F.lit("SRC"), F.col("query_id") % 20)).alias("tags"))


def metadata_match(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    return retrieval.metadata_matches(_plans(v), v.memories())


def provenance_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("m"), (F.col("c_custkey") / 7).cast("int"))).alias("provenance"))
    return retrieval.provenance_neighbours(c.select(F.concat(F.lit("c"), "id").alias("id"), "provenance"))


def _seeds(v: Views) -> DataFrame:
    return retrieval.top_k(retrieval.bm25(v.queries(), v.memories(), k=5), 5).select("query_id", "id", "score")


def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Along the memories' own sources, of which one may hold a third of all."""
    v = Views(spark, sf)
    return retrieval.expand(_seeds(v), retrieval.memberships(v.memories()))


def _hybrid(v: Views, rerank, k: int) -> DataFrame:
    """Vectors are the embeddings' rows in turn: a memory has the one at its id, a query those at its id and the next."""
    e = _embeddings(v)
    n = e.agg(F.count("*").alias("n"))
    at = lambda rows, place, *names: rows.crossJoin(F.broadcast(n)).withColumn("at", place % F.col("n")).join(e.withColumnRenamed("id", "at"), "at").select(*names, "vector")
    nodes = v.memories()
    parts = v.queries().select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    return retrieval.hybrid_retrieve(_plans(v), at(parts, F.col("query_id") + F.col("part"), "query_id", "part"), nodes, at(nodes.select("id"), F.col("id"), "id"), rerank, k)


def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Four channels as one list of candidates."""
    out = _hybrid(Views(spark, sf), None, retrieval.CANDIDATES)
    return out.select("query_id", "id", F.col("recall_score").alias("score"), "rank", F.array_join("sources", ",").alias("sources"))


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The five best candidates by a stand-in for a reranker, which goes by the text's length."""
    rerank = lambda shown: shown.select("query_id", "id", F.round(F.length("content") % 97 / 97, 6).alias("rerank"))
    out = _hybrid(Views(spark, sf), rerank, 5)
    return out.withColumn("sources", F.array_join("sources", ","))


def _questions(v: Views) -> DataFrame:
    """Each turn as a question; its answer is the turn before, or itself in every fourth."""
    said = F.coalesce("text", F.lit(""))
    c = v.table("conversations").withColumn("before", F.lag(said).over(Window.partitionBy("conv_id").orderBy("turn", "role", said)))
    ends = F.when(F.col("turn") % 3 == 0, "??").when(F.col("turn") % 3 == 1, " ?").otherwise(".")
    lead = F.when(F.col("conv_id") % 5 == 0, "Which memory is ").when(F.col("conv_id") % 5 == 1, F.concat(F.lit("what of C"), F.col("conv_id").cast("string"), F.lit(" "))).otherwise("memorial ")
    answer = F.when(F.col("turn") % 4 == 0, said).otherwise(F.coalesce("before", F.lit("")))
    return c.select("conv_id", "turn", F.concat(lead, said, ends).alias("question"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("node"), answer.alias("answer"))


def question_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(Views(spark, sf)).select("conv_id", "turn", text.question_error(F.col("question"), F.array("node")).alias("error"))


def question_forms(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("question")
    return _questions(Views(spark, sf)).select("conv_id", "turn", text.normal_question(q).alias("normal"), text.with_question_mark(q).alias("marked"), text.leaks_answer(q, F.col("answer")).alias("leaked"), text.is_abstention(F.concat(F.lit("\t"), F.when(F.col("turn") % 2 == 0, "insufficient_information.").otherwise(q))).alias("abstained"))


def duplicate_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Later turns against all first turns of a group of conversations."""
    q = _questions(Views(spark, sf)).select((F.col("conv_id") % 7).alias("group_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "question", "turn")
    known = q.where("turn = 0")
    return rewards.duplicates(q.where("turn > 0"), known).select("group_id", "seq", "duplicate")


def route_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders")
    mode = F.element_at(F.array(*map(F.lit, datasets.MODES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    k = F.col("o_orderkey")
    nodes = F.array(F.array((k % 5).cast("string"), (k % 3).cast("string")), F.array((k % 7).cast("string")))
    used = F.array((k % 4).cast("string"), (k % 6).cast("string"))
    return o.select("o_orderkey", mode.alias("mode"), rewards.fidelity(mode, nodes, used).cast("double").alias("fidelity"))


def _attacks(v: Views) -> DataFrame:
    e = v.table("events")
    k, u = F.col("event_id"), F.col("value")
    part = lambda n: F.round(((k * n) % 101) / 100, 2)
    return e.select(
        "event_id",
        F.when(k % 23 == 0, None).otherwise(F.concat(F.lit("what is blue "), F.when(k % 2 == 0, "?").otherwise("."))).alias("question"),
        F.when(k % 29 == 0, "id_leak").alias("error"),
        (k % 31 == 0).alias("duplicate"), (k % 37 == 0).alias("oracle_error"), (k % 17 != 0).alias("oracle_valid"), part(7).alias("relevance"),
        F.when(k % 41 == 0, "Blue!").otherwise("red").alias("answer"), F.when(k % 13 == 0, 0.5).otherwise(1.0).alias("fidelity"),
        F.when(k % 43 == 0, "Insufficient_information").otherwise("x").alias("golden_answer"), (k % 47 == 0).alias("judge_error"),
        rewards.label_score(F.element_at(F.array(*map(F.lit, ("correct", "correct", "partial"))), (k % 3 + 1).cast("int"))).alias("gold"),
        part(3).alias("parametric"), part(5).alias("memory"), F.round(F.abs(u) / (1 + F.abs(u)), 2).alias("value"), rewards.novelty(0.7 + 0.25 * part(11)).alias("novelty"),
    )


def attacker_reward(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.attack_rewards(_attacks(Views(spark, sf))).select("event_id", "stage", "score", "reward_available")


def attack_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The whole vector of metrics of each attack."""
    m = rewards.attack_metrics(rewards.attack_rewards(_attacks(Views(spark, sf))))
    return m.select("event_id", "stage", *(F.round(c, 6).alias(c) for c in METRICS))


METRICS = ["score", "reward_available", "schema_valid", "format_valid", "question_valid", "question_mark", "oracle_valid", "gold_correctness", "gold_pass", "memory_correctness", "uncovered", "uncovered_pass", "parametric_correctness", "parametric_pass", "value", "value_pass", "novelty", "novelty_pass", "route_fidelity", "route_pass", "attack_valid"]


def reward_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over all attacks; every batch of 1000 with an oracle error stands for one that failed whole."""
    rows = rewards.attack_metrics(rewards.attack_rewards(_attacks(Views(spark, sf))))
    failed = F.when(F.col("oracle_error"), (F.col("event_id") / 1000).cast("long"))
    return rewards.reward_summary(rows.withColumn("batch_error", failed))


def _edits_judged(v: Views) -> DataFrame:
    k = F.col("event_id")
    part = lambda n: F.round(((k * n) % 101) / 100, 2)
    high = lambda n: F.round(0.55 + 0.45 * ((k * n) % 101) / 100, 2)
    growth, shrink = memory.size_change(k % 50, (k * 3) % 50, k % 20)
    op = F.element_at(F.array(*map(F.lit, ("add", "merge", "delete", "noop"))), (k % 4 + 1).cast("int"))
    targets = F.when(op.isin("merge", "delete"), F.array((k % 6).cast("int"))).otherwise(F.array().cast("array<int>"))
    valid = rewards.edit_valid(op, targets, F.array(*map(F.lit, range(5))), F.when(op.isin("add", "merge"), (k % 140).cast("int")))
    return v.table("events").select(
        "event_id", (k % 19 != 0).alias("schema_valid"), (k % 23 != 0).alias("constraint_valid"), valid.alias("semantic_valid"), (k % 29 == 0).alias("judge_error"),
        part(7).alias("before"), high(5).alias("after"), high(3).alias("groundedness"), high(11).alias("action_quality"), high(13).alias("memory_quality"),
        F.when(k % 2 == 0, F.array(high(17), high(19))).otherwise(F.array().cast("array<double>")).alias("retention"), growth.alias("growth"), shrink.alias("shrink"),
    )


def builder_reward(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.builder_rewards(_edits_judged(Views(spark, sf))).select("event_id", "stage", "score", "commit_valid")


def builder_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = rewards.builder_metrics(rewards.builder_rewards(_edits_judged(Views(spark, sf))))
    names = ["score", "reward_available", "action_valid", "answer_pass", "retention", "retention_pass", "memory_cost", "gain", "groundedness"]
    return m.select("event_id", "stage", *(F.round(c, 6).alias(c) for c in names))


def grpo_advantage(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.advantages(Views(spark, sf).rewards()).select("event_id", "advantage")


def novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Of each question against all other rows."""
    e = _embeddings(Views(spark, sf))
    scored = retrieval.vector_scores(e.where(ASKED).withColumnRenamed("id", "query_id"), e, 1, others=True)
    return scored.groupBy("query_id").agg(F.round(rewards.novelty(F.max("score")), 6).alias("novelty"))


def memory_versions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.running_version(Views(spark, sf).edits()).select("case_id", "seq", "op", "version")


def edit_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Merges and deletes take the last two nodes that adds and merges of the case made, so merges rest on merges."""
    v = Views(spark, sf)
    earlier = Window.partitionBy("case_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("op").isin("merge", "delete") & (F.count_if(F.col("op") == "add").over(earlier) == 0)
    e = v.edits().withColumn("first", first).withColumn("op", F.when(F.col("first"), "noop").otherwise(F.col("op")))
    e = memory.running_version(e).withColumn("content", F.concat_ws(" ", F.lit("event"), "event_id"))
    e = e.withColumn("made", F.when(F.col("op").isin("add", "merge"), memory.new_id(F.col("case_id"), F.col("version"), F.col("content"))))
    e = e.withColumn("before", F.last("made", ignorenulls=True).over(earlier))
    e = e.withColumn("pair", F.when(F.col("made").isNotNull(), F.array("made", "before")))
    none = F.array().cast("array<string>")
    known = F.array_compact(F.last("pair", ignorenulls=True).over(earlier))
    shaped = e.withColumn("targets", F.when(F.col("op").isin("merge", "delete"), known).otherwise(none))
    source = F.array(F.concat(F.lit("e"), "event_id"))
    rows = shaped.select("case_id", "seq", "op", "targets", "content", F.concat(F.lit("q"), "k").alias("question_id"), F.array(F.concat(F.lit("p"), F.col("k") % 5)).alias("provenance"), source.alias("source_ids"), none.alias("tags"))
    out = memory.fold_edits(rows)
    return out.groupBy("case_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "active").alias("active"), F.sum("token_count").cast("long").alias("tokens"), F.max("updated_version").alias("version"), F.sum(F.size("linked_questions")).cast("long").alias("links"), F.sum(F.size("provenance")).cast("long").alias("rests_on"))


def pool_membership(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).edits()
    return memory.pool_membership(e.where("op <> 'noop'").select("case_id", F.col("k").alias("question_id"), "seq", F.when(F.col("op") == "delete", "high_priority").otherwise("success").alias("pool")))


def link_binding(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).edits()
    binds = e.where("op <> 'noop'").select("case_id", F.col("k").alias("question_id"), "seq", F.array(F.col("event_id") % 6, F.col("event_id") % 4 + 10).alias("node_ids"))
    return memory.question_links(binds).select("case_id", "node_id", F.array_join("linked_questions", ",").alias("linked_questions"))


def protected_questions(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).edits()
    caps = memory.latest(e.select("case_id", F.col("k").alias("question_id"), "seq", (F.col("op") != "delete").alias("passed"), F.array(F.col("event_id") % 9).alias("node_ids")), ["case_id", "question_id"])
    caps = caps.select("case_id", "question_id", F.col("first_seq").alias("seq"), "passed", "node_ids")
    near = e.where("seq = 1").select("case_id", (F.col("event_id") % 9).alias("node_id"))
    return memory.protected_questions(caps, near).withColumn("rank", F.col("rank").cast("long"))


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders")
    mode = F.element_at(F.array(*map(F.lit, datasets.MODES)), (F.col("o_orderkey") % 7 % 4 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").alias("case_id"), mode.alias("mode"), F.col("o_orderkey").alias("seq"))
    return datasets.round_robin(rows, 8).select("case_id", "mode", "seq", F.col("place").cast("long").alias("place"))


def priority_fill(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    high = F.col("o_orderpriority") == "1-URGENT"
    return datasets.priority_first(o.where(high), o.where(~high), 8).withColumn("place", F.col("place").cast("long"))


def stratified_sizes(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("mode"))
    return datasets.stratified_split(o).groupBy("mode", "split").agg(F.count("*").alias("n"))


def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Two draws without replacement for each topic, by inverse visits."""
    v = Views(spark, sf)
    facts = graph.active_topic_facts(v.edges(), v.nodes())
    visits = F.pmod(F.xxhash64("fact"), F.lit(5))
    return datasets.weighted_sample(facts, ["case_id", "topic"], "fact", 2, 7, datasets.visit_weight(visits))


def compaction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = Views(spark, sf).table("customer")
    nodes = c.select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("tags"))
    return convergence.compaction_candidates(nodes).select("case_id", F.col("place").cast("long").alias("place"), F.array_join("ids", ",").alias("ids"))


def stop_streak(spark: SparkSession, sf: str) -> DataFrame:
    return convergence.streaks(Views(spark, sf).rounds())


def saturation(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is a case, also those without a fresh question; nodes are their signups."""
    e = Views(spark, sf).table("events")
    fresh = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 97 != 0).alias("available"), (F.col("event_id") % 53 != 0).alias("resolved"))
    waiting = e.where("event_type = 'error' and value > 100").select(F.col("user_id").alias("case_id"))
    cases = e.groupBy(F.col("user_id").alias("case_id")).agg(F.count_if(F.col("event_type") == "signup").alias("active_nodes"))
    return convergence.saturation(fresh, waiting, cases)


def _actions(v: Views) -> DataFrame:
    k = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, ("add", "merge", "delete", "noop", "move"))), (k % 5 + 1).cast("int"))
    targets = F.when(k % 3 == 0, "[]").when(k % 3 == 1, F.concat(F.lit("["), k % 4, F.lit("]"))).otherwise(F.concat(F.lit("["), k % 4, F.lit(","), k % 7, F.lit("]")))
    body = F.concat(F.lit('{"operation":"'), op, F.lit('","targets":'), targets, F.lit(',"content":"'), F.when(k % 2 == 0, "text").otherwise(""), F.lit('"'), F.when(k % 11 == 0, ',"x":1').otherwise(""), F.when(k % 13 == 0, "").otherwise("}"))
    return v.table("events").select("event_id", body.alias("action"))


def action_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _actions(Views(spark, sf)).select("event_id", jsonx.action_error(F.col("action"), F.lit(5)).alias("error"))


def oracle_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).table("events")
    batch, item = (F.col("event_id") / 4).cast("long").alias("batch"), (F.col("event_id") % 4).alias("item")
    answered = e.where("event_id % 9 <> 0").select(batch, F.when(F.col("event_id") % 10 == 3, F.col("event_id") % 4 + 1).otherwise(F.col("event_id") % 4).alias("item"))
    return rewards.reconciled(e.select(batch, item), answered)


def training_records(spark: SparkSession, sf: str) -> DataFrame:
    d = Views(spark, sf).memories()
    rows = d.select(F.lit("ask").alias("system"), F.struct("id", F.col("content").alias("target")).alias("payload"), F.sha2("content", 256).alias("truth"), F.struct(F.col("id").alias("index")).alias("extra"))
    r = datasets.training_records(rows, "attacker", "memory_attack")
    return r.select("data_source", "ability", F.col("extra_info.index").alias("id"), F.col("reward_model.ground_truth").alias("truth"), F.col("prompt")[0]["role"].alias("first_role"), F.size("prompt").cast("long").alias("turns"))


def route_bundle(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    routes = graph.same_topic(v.edges(), v.nodes()).select("case_id", F.col("topic").alias("route"), graph.topic_walk(F.col("topic"), F.slice("facts", 1, 3)).alias("walk"))
    b = graph.route_bundles(routes, v.nodes())
    return b.select("case_id", "route", rounds.observation_query(F.col("evidence")).alias("query"), F.size("evidence").cast("long").alias("n_evidence"), F.size("connectors").cast("long").alias("n_connectors"))


def mode_fallback(spark: SparkSession, sf: str) -> DataFrame:
    v = Views(spark, sf)
    single = graph.single_fact(v.nodes()).select("case_id", F.col("walk")[0].alias("first"))
    pairs = graph.comparison(v.edges(), v.nodes()).where("dimension = 'location'").select("case_id", F.col("fact_a").alias("first"))
    return graph.fallback(pairs, single, v.nodes().select("case_id").distinct())


def mode_funnel(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders")
    return datasets.funnel(o.select(F.col("o_orderpriority").alias("mode"), (F.col("o_orderkey") % 3 != 0).alias("attempted"), (F.col("o_totalprice") < 150000).alias("fits"), (F.col("o_orderstatus") == "O").alias("selected")))


def time_hull(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))).alias("t"))
    return o.select("o_custkey", memory.time_hull(F.col("t")).alias("h")).select("o_custkey", "h.start", "h.end")


def compaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    protected = F.when(k % 2 == 0, F.array(F.struct(F.lit(1.0).alias("before"), F.when(k % 3 == 0, 0.97).otherwise(0.9).alias("after")))).otherwise(F.array().cast("array<struct<before:double,after:double>>"))
    rows = Views(spark, sf).table("orders").select(F.col("o_custkey").alias("case_id"), place.alias("place"), (k % 5 != 0).alias("valid"), (k % 11).alias("tokens_before"), (k % 13).alias("tokens_after"), protected.alias("protected"))
    return convergence.first_compaction(rows).withColumn("place", F.col("place").cast("long"))


def round_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = Views(spark, sf).table("events")
    rows = e.select(F.col("user_id").alias("case_id"), "event_id", F.abs(F.col("value") / 100).alias("correctness"), F.when(F.col("event_type") == "error", "timeout").alias("error"))
    edits = e.where("event_type = 'click'").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 5 != 0).alias("commit_valid"), F.col("value").alias("score"), (F.col("event_id") % 4).alias("n_retrieved"))
    return rounds.round_counters(rounds.defended(rows), rounds.committed(edits))


def guarded_commit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    e = Views(spark, sf).table("events")
    rows = e.select("event_id", (k % 5 != 0).alias("commit_valid"), F.when(k % 7 == 0, 0.0).otherwise(F.col("value")).alias("score"), (k % 4).alias("n_retrieved"))
    return rounds.committed(rows).select("event_id", "outcome", "pool")


def replay_queue(spark: SparkSession, sf: str) -> DataFrame:
    o = Views(spark, sf).table("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice")
    got = rounds.replayed(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), o.where("o_totalprice > 50000"))
    return got.withColumn("place", F.col("place").cast("long"))


def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the prompts that answer a conversation's first turn from its turns as sources and as memories."""
    said = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", "conv_id", "turn")
    time = F.when(F.col("turn") % 3 == 0, F.format_string("2024-01-%02d", (F.col("turn") % 28 + 1).cast("int")))
    span = F.when(F.col("turn") % 4 != 1, F.struct(time.alias("start"), F.when(F.col("turn") % 2 == 0, time).alias("end")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content"), name.alias("source_id"), time.alias("chat_time"), span.alias("time_span"))))
    c = Views(spark, sf).table("conversations").groupBy("conv_id").agg(turns.alias("s"))
    question, memories = F.col("s")[0]["content"], F.transform("s", lambda t: t.dropFields("source_id").withField("id", t["source_id"]))
    digest = lambda block: F.sha2(templates.answer_prompt(question, block)[1]["content"], 256)
    return c.select("conv_id", digest(templates.source_block(F.col("s"))).alias("sources_sha256"), digest(templates.memory_block(memories)).alias("memories_sha256"))


QUERIES = [
    case_summary, relation_histogram, case_edges, case_index_parse, missing_users, topic_fact_index, single_fact_candidates, same_topic_candidates,
    temporal_candidates, comparison_candidates, comparison_classes, route_laps, walk_signature, walk_directions, source_dedup, token_counts, doc_freq, bm25_topk, vector_topk,
    metadata_match, provenance_neighbours, graph_expand, hybrid_fusion, hybrid_retrieve, question_constraints, question_forms, duplicate_antijoin, route_fidelity,
    attacker_reward, attack_metrics, reward_summary, builder_reward, builder_metrics, grpo_advantage, novelty, memory_versions, edit_fold, pool_membership, link_binding,
    protected_questions, round_robin, priority_fill, stratified_sizes, weighted_sample, compaction_pairs, stop_streak, saturation,
    action_validation, oracle_reconcile, training_records, route_bundle, mode_fallback, mode_funnel, time_hull, compaction_audit, round_outcomes,
    guarded_commit, replay_queue, context_blocks,
]


def queries() -> dict:
    from . import collection, state

    return {q.__name__: q for q in [*QUERIES, *collection.QUERIES, *state.QUERIES]}
