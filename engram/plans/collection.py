"""Queries of what comes before training: checks of models' answers, the collector, prompts and payloads; ``SQL`` has the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import jsonx, templates, text
from engram.operators import checks, datasets, graph, rewards, rounds
from engram.session import checkpointed
from engram.sources import providers

from .views import Views

_K = "event_id"


def _of(k, *values):
    """The value whose turn it is."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


#: Items of an oracle's answer, {i} for the item's number and {j} for the next; None leaves the item out.
ITEMS = [
    '{"id":{i},"valid":true,"answer":" yes ","sources":[0,1]}', '{"id":{i},"valid":false,"reason":"ambiguous"}', '{"id":{i},"valid":false,"reason":"other"}',
    '{"id":{i},"valid":"true","answer":"a","sources":[0]}', '{"id":{i},"valid":true,"answer":" ","sources":[0]}', '{"id":{i},"valid":true,"answer":"a","sources":[0,0]}',
    '{"id":{i},"valid":true,"answer":"b","sources":[9]}', '{"id":{i},"valid":true,"answer":"a","sources":[1.0]}', '{"id":{i},"valid":true,"answer":"a","sources":[0],"more":1}',
    '{"id":"{i}","valid":true,"answer":"a","sources":[0]}', '{"id":{j},"valid":true,"answer":"c","sources":[2]}', None, '{"id":{i},"valid":true,"answer":"a","sources":[true]}',
    '{"id":{i},"valid":true,"answer":"a","sources":[]}', '{"id":{i},"valid":false,"reason":"unsupported","answer":null}', '{"id":{i}}', '[1]',
]


def oracle_items(spark: SparkSession, sf: str) -> DataFrame:
    """Four events are a batch; what each item's answer looks like goes by turns."""
    k = F.col(_K)
    e = Views(spark, sf).table("events").select((k / 4).cast("long").alias("batch"), (k % 4).alias("item"), k.alias("k"))
    form = F.replace(F.replace(_of(F.col("k"), *ITEMS), F.lit("{i}"), F.col("item").cast("string")), F.lit("{j}"), (F.col("item") + 1).cast("string"))
    bodies = e.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", form.alias("f")))), lambda x: x["f"]), ",").alias("b"))
    answered = bodies.select("batch", F.when(F.col("batch") % 17 == 0, '{"results":{}}').otherwise(F.concat(F.lit('{"results":['), "b", F.lit("]}"))).alias("response"))
    out = checks.oracle_items(e.select("batch", "item", F.lit(3).alias("n_sources")), answered)
    return out.withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


JUDGEMENTS = [
    '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1.0,"retention_correctness":[1,0.5]}', '{"after_correctness":true,"groundedness":0.5,"action_quality":0.25,"memory_quality":1.0,"retention_correctness":[1,0.5]}',
    '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"retention_correctness":[1,0.5]}', '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1.5,"retention_correctness":[1,0.5]}',
    '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1,"retention_correctness":[1]}', '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1,"retention_correctness":["1",0]}',
    '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1,"retention_correctness":1}', '{"after_correctness":1,"groundedness":0.5,"action_quality":0.25,"memory_quality":1,"retention_correctness":[1,-0.5]}',
    "not json", '{"after_correctness":0.75,"groundedness":0,"action_quality":0,"memory_quality":1,"retention_correctness":[0,1],"extra":null}', '{"after_correctness":"1","groundedness":0,"action_quality":0,"memory_quality":1,"retention_correctness":[0,1]}',
]


def edit_judgements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(_K)
    after = F.when(k % 3 == 0, " insufficient_information. ").otherwise("an answer")
    j = checks.edit_judgement(_of(k, *JUDGEMENTS), after, F.array(F.lit("kept"), F.when(k % 5 == 0, "INSUFFICIENT_INFORMATION").otherwise("also kept")))
    e = Views(spark, sf).table("events").select(_K, j.alias("j"))
    return e.select(_K, "j.error", "j.after_correctness", "j.groundedness", "j.action_quality", "j.memory_quality", F.array_join(F.col("j.retention").cast("array<string>"), ",").alias("retention"))


LABELS = [
    '{"gold_correctness":"correct","memory_correctness":"partial","parametric_correctness":"incorrect","value":"high"}', '{"gold_correctness":"partial","memory_correctness":"correct","parametric_correctness":"correct","value":"medium"}',
    '{"gold_correctness":"right","memory_correctness":"partial","parametric_correctness":"incorrect","value":"high"}', '{"gold_correctness":"correct","memory_correctness":"partial","value":"high"}',
    '{"gold_correctness":"correct","memory_correctness":"partial","parametric_correctness":"incorrect","value":"correct"}', '{"gold_correctness":1,"memory_correctness":"partial","parametric_correctness":"incorrect","value":"low"}',
    '{"gold_correctness":"correct","memory_correctness":"partial","parametric_correctness":"incorrect","value":"high","x":1}',
]


def label_judgements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(_K)
    none = lambda n: F.when(k % n == 0, "Insufficient_Information!").otherwise("x")
    e = Views(spark, sf).table("events").select(_K, checks.label_judgement(_of(k, *LABELS), none(2), none(3), none(5)).alias("j"))
    return e.select(_K, "j.error", "j.gold", "j.memory", "j.parametric", "j.value")


def ledger_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer's ten dearest are looked up in a ledger of those that are done."""
    o = Views(spark, sf).table("orders")
    wanted = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("o_totalprice"), "o_orderkey"))), lambda x: x["o_orderkey"]).alias("question_ids"))
    ledger = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("answer"))
    return checks.ledger_lookup(wanted, ledger).select("case_id", F.col("place").cast("long").alias("place"), "question_id", "found", "answer")


def case_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are cases, users those with an order, records the suppliers in order."""
    v = Views(spark, sf)
    cases = v.table("customer").select((F.col("c_custkey") - 1).alias("case_index"), F.col("c_name").alias("user_name"), "c_custkey")
    users = v.table("orders").select("o_custkey").distinct().join(cases, F.col("o_custkey") == F.col("c_custkey")).select("user_name")
    records = v.table("supplier").select((F.col("s_suppkey") - 1).alias("case_index"), F.col("s_name").alias("question"))
    return checks.case_records(cases.drop("c_custkey"), users, records)


def collector_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events are responses to routes; three of them are taken, none that was asked at a signup."""
    k = F.col(_K)
    part = lambda n: F.round(((k * n) % 101) / 100, 2)
    e = Views(spark, sf).table("events")
    question = F.concat(F.lit("What is item "), (k % 30).cast("string"), _of(k, "?", ".", " ?", "? or not?"))
    rows = e.where("event_type <> 'signup'").select(
        F.col("user_id").alias("case_id"), k.alias("seq"), F.concat(F.lit("r"), k.cast("string")).alias("route_id"),
        F.when(k % 13 == 0, "two\nlines").otherwise(F.concat(F.when(k % 2 == 0, "<think>\n</think>\n").otherwise(""), question)).alias("response"), F.array(F.lit("n7")).alias("identifiers"),
        (k % 37 == 0).alias("oracle_error"), (k % 11 != 0).alias("oracle_valid"), F.concat(F.lit("item "), (k % 9).cast("string")).alias("answer"), F.when(k % 7 == 0, 0.5).otherwise(1.0).alias("fidelity"),
        F.when(k % 17 == 0, "insufficient_information").otherwise("x").alias("golden_answer"), F.when(k % 3 == 0, "INSUFFICIENT_INFORMATION.").otherwise("y").alias("parametric_answer"), (k % 41 == 0).alias("judge_error"),
        F.when(k % 5 == 0, 0.5).otherwise(1.0).alias("gold"), part(7).alias("value"), part(3).alias("parametric"),
    )
    prior = e.where("event_type = 'signup'").select(F.col("user_id").alias("case_id"), question.alias("question"))
    return checks.collected(rows, prior, 3).withColumn("place", F.col("place").cast("long"))


def latest_times(spark: SparkSession, sf: str) -> DataFrame:
    """The last of three times of an order, written in different ways, some of them not times."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda days: F.date_format(F.date_add(d.cast("date"), days), "yyyy-MM-dd")
    times = F.array(F.when(k % 3 == 0, F.concat(at(1), F.lit("T10:00:00Z"))), F.when(k % 2 == 0, F.concat(at(1), F.lit("T11:30:00+02:00"))).otherwise("yesterday"), F.when(k % 5 == 0, at(0)))
    return Views(spark, sf).table("orders").select("o_orderkey", F.unix_micros(text.latest_time(times)).alias("latest"))


def _known(v: Views) -> DataFrame:
    """A customer's orders, dear ones first, as evidence and memories."""
    o = v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"\n\\ ß'), F.col("o_orderkey").cast("string")).alias("said"), F.col("o_orderstatus").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    lists = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("dear"), "o_orderkey", "said", "role", "day")))
    return o.groupBy("o_custkey").agg(lists.alias("o"))


def attacker_prompts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    said = F.transform("o", lambda x: x["said"])
    mode = _of(k, *datasets.MODES)
    payload = templates.attacker_payload(F.slice(said, 1, 2), mode, F.when(k % 8 == 3, "").otherwise("cost"), F.slice(said, 3, 100))
    prompt = templates.chat(F.concat(F.lit("Ask. "), mode), payload)
    return _known(Views(spark, sf)).select("o_custkey", F.sha2(prompt[1]["content"], 256).alias("user_sha256"), prompt[0]["content"].alias("system"), checks.prompt_tokens(prompt).cast("long").alias("tokens"))


def oracle_payloads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    sources = F.transform("o", lambda x: F.struct(x["role"].alias("role"), x["day"].alias("chat_time"), x["said"].alias("content")))
    items = F.transform(F.slice("o", 1, 3), lambda x, i: F.struct(i.alias("id"), x["said"].alias("question")))
    payload = templates.oracle_payload(_of(k, *datasets.MODES), sources, items, F.when(k % 2 == 0, "time"))
    return _known(Views(spark, sf)).select("o_custkey", F.sha2(payload, 256).alias("payload_sha256"))


def oracle_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each source that an oracle is shown."""
    k = F.col("o_custkey")
    sources = F.transform("o", lambda x: F.struct(x["role"].alias("role"), x["day"].alias("chat_time"), x["said"].alias("content")))
    context = templates.oracle_context(_of(k, *datasets.MODES), F.when(k % 2 == 0, "time"), sources)
    shown = _known(Views(spark, sf)).select("o_custkey", context.alias("c")).select("o_custkey", "c.attack_mode", "c.mode_dimension", F.posexplode("c.source_records").alias("place", "s"))
    return shown.select("o_custkey", "attack_mode", "mode_dimension", F.col("place").cast("long").alias("place"), "s.role", "s.chat_time", "s.content")


def protected_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates to ledger rows, to what is shown of them, with the number of sources in their evidence rows."""
    k = F.col("o_custkey")
    asked = _known(Views(spark, sf)).select(k.cast("string").alias("route"), _of(k, *datasets.MODES).alias("mode"), F.posexplode(F.slice("o", 1, 3)).alias("i", "x"), F.size("o").alias("version"))
    sources = F.transform(F.sequence(F.lit(0), F.col("i")), lambda n: F.concat_ws(":", F.col("x.o_orderkey"), n))
    candidates = asked.select("route", "mode", F.col("x.said").alias("question"), F.col("x.role").alias("answer"), sources.alias("source_ids"), "version")
    capability = rounds.capability_rows(candidates)
    evidence = rounds.evidence_rows(candidates).groupBy("question_id").agg(F.count("*").alias("n_sources"), F.max("source_id").alias("last_source"))
    return rounds.protected_rows(capability).join(evidence, "question_id").join(capability.select("question_id", "passed", "attack_mode", F.col("verified_version").cast("long").alias("version")), "question_id")


def builder_prompts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    evidence = F.transform(F.slice("o", 1, 2), lambda x: F.struct(x["said"].alias("quote"), x["day"].alias("chat_time"), x["role"].alias("role")))
    span = lambda x: F.when(x["day"].isNotNull(), F.struct(x["day"].alias("start"), F.lit(None).cast("string").alias("end")))
    nodes = F.transform(F.slice("o", 3, 100), lambda x: F.struct(x["said"].alias("content"), F.when(x["role"] == "O", F.array(x["role"], F.lit("q2"))).otherwise(F.array().cast("array<string>")).alias("linked_questions"), F.array(x["role"]).alias("tags"), span(x).alias("time_span")))
    kept = F.transform(F.slice("o", 1, 1), lambda x: F.struct(F.lit("q1").alias("question_id"), x["said"].alias("question"), x["role"].alias("canonical_answer")))
    payload = F.when(k % 5 == 0, templates.compaction_payload(nodes, kept)).otherwise(templates.builder_payload(F.lit("what?"), evidence, nodes, kept))
    return _known(Views(spark, sf)).select("o_custkey", F.sha2(payload, 256).alias("payload_sha256"))


def prompt_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose turns as one prompt fit into 300 tokens."""
    c = Views(spark, sf).table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.coalesce("text", F.lit("")).alias("content"))).alias("prompt"))
    return checks.fitting(c, 300).select("conv_id", checks.prompt_tokens(F.col("prompt")).cast("long").alias("tokens"))


def question_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of four kinds: plain, with an empty thought, of several lines, blank."""
    k = F.col("conv_id") * 10 + F.col("turn")
    said = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    response = F.when(k % 4 == 0, said).when(k % 4 == 1, F.concat(F.lit(" <think>\n\n</think>\n"), said)).when(k % 4 == 2, F.concat(said, F.lit("\nmore"))).otherwise("\t ")
    q = text.parsed_question(response)
    return Views(spark, sf).table("conversations").select("conv_id", "turn", F.sha2(q, 256).alias("question_sha256"), rounds.question_id(F.col("conv_id").cast("string"), text.with_question_mark(q)).alias("question_id"))


def first_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Free text with something broken, a list, an object without the keys, and one with them."""
    k = F.col(_K).cast("string")
    said = F.concat(F.lit("Well {a} [1] {\"a\": "), k, F.lit("} then {\"b\": [1, {\"a\": 2}], \"a\": \"x"), k, F.lit("\"} and {\"a\":1,\"b\":2}"))
    said = F.when(F.col(_K) % 7 == 0, F.concat(F.lit("nothing {"), k)).otherwise(said)
    return Views(spark, sf).table("events").select(_K, jsonx.first_object(("a", "b"))(said).alias("found"))


STRICT = [
    '{"operation":"add","targets":[],"content":"x"}', '{"operation":"merge","targets":[true],"content":"x"}', '{"operation":"merge","targets":[1.0],"content":"x"}', '{"operation":"merge","targets":["1"],"content":"x"}',
    '{"operation":"merge","targets":1,"content":"x"}', '{"operation":"add","targets":[],"content":5}', '{"operation":"noop","targets":[],"content":" "}', '{"operation":"add","targets":[],"content":" "}',
    '{"operation":"delete","targets":[0,4],"content":""}', '{"operation":7,"targets":[],"content":""}', '{"operation":"merge","targets":[-1],"content":"x"}', '{"operation":"merge","targets":[2,2],"content":"x"}', "[]",
]


def strict_actions(spark: SparkSession, sf: str) -> DataFrame:
    return Views(spark, sf).table("events").select(_K, jsonx.action_error(_of(F.col(_K), *STRICT), F.lit(5)).alias("error"))


PLANS = [
    '{"rewritten_query":" best match ","retrieval_queries":["one"," ","two "],"keywords":[" k "],"tags":[]}', "broken {", '{"rewritten_query":""}', '{"keywords":["a","","b "]}', None,
]


def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    b = Views(spark, sf).table("benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), _of(F.col("item_id"), *PLANS).alias("response"))
    p = providers.parsed_plan(b)
    lists = ["retrieval_queries", "keywords", "tags"]
    return p.select("query_id", F.sha2("rewritten_query", 256).alias("rewritten_sha256"), *(F.sha2(F.array_join(c, "|"), 256).alias(c) for c in lists))


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """A user's clicks ask few different questions, each answered once."""
    k = F.col(_K)
    e = Views(spark, sf).table("events").where("event_type = 'click'")
    rows = e.select((F.col("user_id") % 5).alias("group_id"), (F.col("user_id") % 7).alias("route_id"), k.alias("seq"), F.concat(F.lit("Item "), (k % 4).cast("string"), _of(k, "?", " ", ".")).alias("question"))
    return rewards.fanned_out(rows, lambda df: df.withColumn("answered_by", F.col("seq")))


def request_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a run of batches of four, some of which were halved."""
    k = F.col(_K)
    rows = Views(spark, sf).table("events").select(k.alias("id"), F.when(k % 4 == 0, F.when(k % 3 == 0, 3).otherwise(1)).otherwise(0).alias("requests"), F.when(k % 97 == 5, F.concat(F.lit("failed "), k.cast("string"))).alias("error"))
    return providers.request_accounting(rows)


def mode_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Modes of records, of which builders' have none, and one mode doesn't occur."""
    k = F.col("o_orderkey")
    mode = F.when(k % 5 < 3, _of(k % 5, *datasets.MODES[:2], datasets.MODES[3]))
    route = F.when(mode.isNotNull(), F.struct(mode.alias("attack_mode")))
    return datasets.mode_histogram(Views(spark, sf).table("orders").select(F.struct(route.alias("route")).alias("extra_info")))


def _sources(v: Views, of: DataFrame | None = None) -> DataFrame:
    """Facts with sources as JSON, one of them encoded twice; orders of a customer share the source of their priority.  With
    ``of`` (case_id, id) those facts only."""
    k = F.col("o_orderkey")
    plain = F.to_json(F.struct(F.lit("user").alias("role"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("chat_time"), F.col("o_orderstatus").alias("content")), {"ignoreNullFields": "false"})
    shared = F.to_json(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("chat_time"), F.col("o_orderpriority").alias("content")), {"ignoreNullFields": "false"})
    twice = F.get_json_object(F.to_json(F.struct(F.to_json(F.array(shared)).alias("x"))), "$.x")
    o = v.table("orders").join(v.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("case_id")), "o_custkey")
    o = o.withColumn("id", F.concat(F.lit("o:"), k))
    o = o if of is None else o.join(of, ["case_id", "id"], "left_semi")
    raw = o.select("case_id", "id", F.array(plain, templates.quoted(shared), F.when(k % 3 == 0, plain)).alias("sources"))
    return graph.exploded_sources(raw.withColumn("sources", F.array_compact("sources")))


def source_explode(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(Views(spark, sf))
    return s.select("case_id", "source_id", "node_id", F.col("ordinal").cast("long").alias("ordinal"), "role", "chat_time", "content")


def bundle_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Routes over a topic's first three facts, with their sources, each once."""
    v = Views(spark, sf)
    routes = graph.same_topic(v.edges(), v.nodes()).select("case_id", F.col("topic").alias("route"), graph.topic_walk(F.col("topic"), F.slice("facts", 1, 3)).alias("walk"))
    routes = checkpointed(routes)  # only what they walk over is decoded
    walked = routes.select("case_id", F.explode("walk").alias("id")).distinct()
    b = graph.route_bundles(routes, v.nodes(), _sources(v, walked))
    ids = F.array_join(F.transform("evidence", lambda n: F.array_join(n["source_ids"], ",")), ";")
    return b.select("case_id", "route", ids.alias("source_ids"), F.array_join(F.transform("source_records", lambda s: s["source_id"]), ",").alias("records"))


def _sql_of(k: str, values: list) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(quote, values))}][{k} % {len(values)} + 1]"


_ABSTAINS = "upper(regexp_replace(trim({c}), '[.!]+$', '')) = 'INSUFFICIENT_INFORMATION'"
_NUMBER = "json_type({c}) IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_KNOWN = r"""
o AS (SELECT o_custkey, o_orderkey, o_totalprice, 'say "' || o_orderpriority || '"' || chr(10) || '\ ß' || o_orderkey AS said, o_orderstatus AS role, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) AS i FROM o),
j AS (SELECT o_custkey, i, CAST(to_json(said) AS VARCHAR) AS said, CAST(to_json(role) AS VARCHAR) AS role, coalesce(CAST(to_json(day) AS VARCHAR), 'null') AS day FROM r)"""
_MODE = "['single_fact', 'same_topic', 'temporal_evolution', 'comparison'][o_custkey % 4 + 1]"
_LIST = "'[' || coalesce(string_agg({what}, '{sep}' ORDER BY i) FILTER ({when}), '') || ']'"


def _list(what: str, when: str = "true", sep: str = ", ") -> str:
    return _LIST.format(what=what, when=when, sep=sep)


_QUESTION = "'What is item ' || event_id % 30 || ['?', '.', ' ?', '? or not?'][event_id % 4 + 1]"
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({c}), '[?.!？。！]+$', ''), '\s+', ' ', 'g'))"
_SOURCES = """
s0 AS (SELECT CAST(c_nationkey AS BIGINT) AS case_id, 'o:' || o_orderkey AS node_id, o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (
  SELECT case_id, node_id || ':0' AS source_id, node_id, CAST(0 AS BIGINT) AS ordinal, 'user' AS role, day AS chat_time, o_orderstatus AS content FROM s0
  UNION ALL SELECT case_id, node_id || ':1', node_id, 1, NULL, NULL, o_orderpriority FROM s0
  UNION ALL SELECT case_id, node_id || ':2', node_id, 2, 'user', day, o_orderstatus FROM s0 WHERE o_orderkey % 3 = 0)"""

SQL = {
    "oracle_items": f"""WITH e AS (SELECT event_id AS k, CAST(event_id // 4 AS BIGINT) AS batch, event_id % 4 AS item FROM events),
f AS (SELECT *, replace(replace({_sql_of("k", ITEMS)}, '{{i}}', CAST(item AS VARCHAR)), '{{j}}', CAST(item + 1 AS VARCHAR))::JSON AS r FROM e),
g AS (SELECT batch, r, CASE WHEN json_type(r, '$.id') IN ('UBIGINT', 'BIGINT') THEN CAST(r->>'$.id' AS BIGINT) END AS id FROM f WHERE r IS NOT NULL AND batch % 17 <> 0 AND json_type(r) = 'OBJECT'),
n AS (SELECT batch, id, count(*) AS n, any_value(r) AS r FROM g WHERE id IS NOT NULL GROUP BY ALL),
b AS (SELECT e.batch, e.item, n.n, n.r, list_sort(json_keys(n.r)) AS keys, json_type(n.r, '$.valid') AS kind, n.r->>'$.valid' AS valid, json_extract(n.r, '$.sources[*]') AS src FROM e LEFT JOIN n ON e.batch = n.batch AND e.item = n.id),
c AS (SELECT *, CASE WHEN batch % 17 = 0 THEN 'schema' WHEN n IS NULL THEN 'omitted' WHEN n > 1 THEN 'duplicate' WHEN coalesce(kind, '') <> 'BOOLEAN' THEN 'validity'
  WHEN valid = 'false' AND keys <> ['id', 'reason', 'valid'] THEN 'keys'
  WHEN valid = 'false' AND r->>'$.reason' NOT IN ('not_question', 'unsupported', 'ambiguous', 'answer_leak', 'mode_mismatch') THEN 'reason'
  WHEN valid = 'true' AND keys <> ['answer', 'id', 'sources', 'valid'] THEN 'keys'
  WHEN valid = 'true' AND (json_type(r, '$.answer') <> 'VARCHAR' OR trim(r->>'$.answer') = '' OR len(src) = 0 OR len(list_filter(src, lambda x: json_type(x) NOT IN ('UBIGINT', 'BIGINT'))) > 0 OR len(list_distinct(src)) <> len(src)) THEN 'answer' END AS error FROM b),
d AS (SELECT *, error IS NULL AND valid = 'true' AND len(list_filter(src, lambda x: CAST(x AS BIGINT) NOT BETWEEN 0 AND 2)) = 0 AS ok FROM c)
SELECT batch, item, error, CASE WHEN error IS NULL THEN ok END AS valid, CASE WHEN ok THEN trim(r->>'$.answer') END AS answer, CASE WHEN ok THEN array_to_string(list_transform(src, lambda x: CAST(x AS VARCHAR)), ',') END AS sources,
  CASE WHEN error IS NULL AND valid = 'false' THEN r->>'$.reason' WHEN error IS NULL AND NOT ok THEN 'unsupported' END AS reason FROM d""",
    "edit_judgements": f"""WITH e AS (SELECT event_id AS k, try_cast({_sql_of("event_id", JUDGEMENTS)} AS JSON) AS j FROM events),
f AS (SELECT *, json_extract(j, '$.retention_correctness[*]') AS r, [json_extract(j, '$.after_correctness'), json_extract(j, '$.groundedness'), json_extract(j, '$.action_quality'), json_extract(j, '$.memory_quality')] AS s FROM e),
g AS (SELECT *, CASE WHEN j IS NULL OR len(list_filter(s, lambda x: x IS NULL)) > 0 OR json_extract(j, '$.retention_correctness') IS NULL THEN 'keys' WHEN len(list_filter(s, lambda x: NOT {_NUMBER.format(c="x")})) > 0 THEN 'numeric'
  WHEN json_type(j, '$.retention_correctness') <> 'ARRAY' OR len(list_filter(r, lambda x: NOT {_NUMBER.format(c="x")})) > 0 THEN 'list'
  WHEN len(list_filter(list_concat(s, r), lambda x: TRY_CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1)) > 0 THEN 'range' WHEN len(r) <> 2 THEN 'length' END AS error FROM f),
h AS (SELECT *, error IS NULL AS ok FROM g)
SELECT k AS event_id, error, CASE WHEN ok THEN CASE WHEN k % 3 = 0 THEN 0 ELSE CAST(s[1] AS DOUBLE) END END::DOUBLE AS after_correctness, CASE WHEN ok THEN CAST(s[2] AS DOUBLE) END AS groundedness, CASE WHEN ok THEN CAST(s[3] AS DOUBLE) END AS action_quality,
  CASE WHEN ok THEN CAST(s[4] AS DOUBLE) END AS memory_quality, CASE WHEN ok THEN CAST(CAST(r[1] AS DOUBLE) AS VARCHAR) || ',' || CAST(CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(r[2] AS DOUBLE) END AS VARCHAR) END AS retention FROM h""",
    "label_judgements": f"""WITH e AS (SELECT event_id AS k, {_sql_of("event_id", LABELS)}::JSON AS j FROM events),
f AS (SELECT *, map {{'incorrect': 0.0::DOUBLE, 'partial': 0.5, 'correct': 1.0}} AS eq, map {{'low': 0.0::DOUBLE, 'medium': 0.5, 'high': 1.0}} AS val FROM e),
g AS (SELECT *, eq[j->>'$.gold_correctness'] AS a, eq[j->>'$.memory_correctness'] AS b, eq[j->>'$.parametric_correctness'] AS c, val[j->>'$.value'] AS d FROM f),
h AS (SELECT *, CASE WHEN list_sort(json_keys(j)) <> ['gold_correctness', 'memory_correctness', 'parametric_correctness', 'value'] THEN 'keys' WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN 'label' END AS error FROM g)
SELECT k AS event_id, error, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 0 ELSE a END END::DOUBLE AS gold, CASE WHEN error IS NULL THEN CASE WHEN k % 3 = 0 THEN 0 ELSE b END END::DOUBLE AS memory,
  CASE WHEN error IS NULL THEN CASE WHEN k % 5 = 0 THEN 0 ELSE c END END::DOUBLE AS parametric, CASE WHEN error IS NULL THEN d END AS value FROM h""",
    "ledger_lookups": """SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) - 1 AS place, o_orderkey AS question_id, o_orderstatus <> 'O' AS found,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS answer FROM orders""",
    "case_records": """SELECT c_custkey - 1 AS case_index, c_name AS user_name, s_name AS question, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'no_user' WHEN s_suppkey IS NULL THEN 'no_record' END AS error
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "collector_filter": f"""WITH e AS (SELECT event_id AS k, user_id AS case_id, event_type, {_QUESTION} AS q FROM events),
n AS (SELECT *, {_NORMAL.format(c="q")} AS normal FROM e),
p AS (SELECT * FROM n WHERE event_type <> 'signup' AND k % 13 <> 0 AND k % 4 <> 3 AND NOT EXISTS (SELECT 1 FROM n s WHERE s.event_type = 'signup' AND s.case_id = n.case_id AND s.normal = n.normal)
  AND k % 37 <> 0 AND k % 11 <> 0 AND k % 30 <> k % 9 AND k % 7 <> 0 AND k % 17 <> 0 AND k % 41 <> 0 AND k % 5 <> 0 AND round((k * 7 % 101) / 100, 2) >= 0.5 AND (k % 3 = 0 OR round((k * 3 % 101) / 100, 2) < 0.8)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY case_id, normal ORDER BY k) = 1),
m AS (SELECT *, CASE WHEN regexp_matches(q, '[?？]$') THEN q ELSE regexp_replace(q, '[.!。！]+$', '') || '?' END AS question, row_number() OVER (PARTITION BY case_id ORDER BY k) AS place FROM f)
SELECT case_id, k AS seq, question, substring(sha256('r' || k || chr(10) || question), 1, 20) AS question_id, place FROM m WHERE place <= 3""",
    "latest_times": """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS o_orderkey, epoch_us(greatest(CASE WHEN k % 3 = 0 THEN (d + 1) + INTERVAL 10 HOUR END, CASE WHEN k % 2 = 0 THEN (d + 1) + INTERVAL 570 MINUTE END, CASE WHEN k % 5 = 0 THEN d + INTERVAL 0 HOUR END)) AS latest FROM t""",
    "attacker_prompts": f"""WITH {_KNOWN},
g AS (SELECT o_custkey, {_list("said", "i <= 2")} AS target, {_list("said", "i > 2")} AS known FROM j GROUP BY o_custkey),
p AS (SELECT o_custkey, {_MODE} AS mode, '{{"target": ' || target || CASE WHEN o_custkey % 4 = 3 AND o_custkey % 8 <> 3 THEN ', "dimension": "cost"' ELSE '' END || ', "known": ' || known || '}}' || chr(10) || chr(10) || '/no_think' AS t FROM g)
SELECT o_custkey, sha256(t) AS user_sha256, 'Ask. ' || mode AS system, CAST(len(regexp_extract_all(t, '[a-zA-Z0-9]+')) + len(regexp_extract_all('Ask. ' || mode, '[a-zA-Z0-9]+')) AS BIGINT) AS tokens FROM p""",
    "oracle_payloads": f"""WITH {_KNOWN},
x AS (SELECT *, '{{"id":' || i - 1 || ',"role":' || role || ',"time":' || day || ',"content":' || said || '}}' AS src, '{{"id":' || i - 1 || ',"question":' || said || '}}' AS item FROM j),
g AS (SELECT o_custkey, {_list("src", sep=",")} AS src, {_list("item", "i <= 3", ",")} AS items FROM x GROUP BY o_custkey)
SELECT o_custkey, sha256('{{"mode":"' || {_MODE} || '","sources":' || src || ',"items":' || items || CASE WHEN o_custkey % 2 = 0 THEN ',"dimension":"time"' ELSE '' END || '}}') AS payload_sha256 FROM g""",
    "oracle_contexts": f"""WITH {_KNOWN} SELECT o_custkey, {_MODE} AS attack_mode, CASE WHEN o_custkey % 2 = 0 THEN 'time' END AS mode_dimension, i - 1 AS place, role, day AS chat_time, said AS content FROM r""",
    "protected_ledger": f"""WITH {_KNOWN}, c AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey)
SELECT substring(sha256(o_custkey || chr(10) || said), 1, 20) AS question_id, said AS question, role AS canonical_answer, i AS n_sources, o_orderkey || ':' || i - 1 AS last_source, false AS passed, {_MODE} AS attack_mode, n AS version
FROM r JOIN c USING (o_custkey) WHERE i <= 3""",
    "builder_prompts": f"""WITH {_KNOWN},
x AS (SELECT *, '{{"text": ' || said || ', "time": ' || day || ', "role": ' || role || '}}' AS ev, '{{"id": "q1", "question": ' || said || ', "canonical_answer": ' || role || '}}' AS kept,
  '{{"index": ' || i - 3 || ', "content": ' || said || ', "linked_questions": ' || CASE WHEN role = '"O"' THEN '["O", "q2"]' ELSE '[]' END || ', "tags": [' || role || '], "time_span": ' || CASE WHEN day = 'null' THEN 'null' ELSE '[' || day || ', null]' END || '}}' AS node FROM j),
g AS (SELECT o_custkey, {_list("ev", "i <= 2")} AS ev, {_list("kept", "i = 1")} AS kept, {_list("node", "i > 2")} AS nodes FROM x GROUP BY o_custkey)
SELECT o_custkey, sha256(CASE WHEN o_custkey % 5 = 0 THEN '{{' ELSE '{{"question": "what?", "new_evidence": ' || ev || ', ' END || '"memory_neighborhood": ' || nodes || ', "protected_questions": ' || kept || '}}') AS payload_sha256 FROM g""",
    "prompt_lengths": r"""SELECT conv_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+|[\x{4e00}-\x{9fff}]'))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id HAVING tokens <= 300""",
    "question_parse": r"""WITH c AS (SELECT conv_id, turn, (conv_id * 10 + turn) % 4 AS m, translate(coalesce(text, ''), chr(10) || chr(13), '  ') AS said FROM conversations),
q AS (SELECT conv_id, turn, CASE WHEN m < 2 THEN nullif(regexp_replace(regexp_replace(said, '^\s+', ''), '\s+$', ''), '') END AS q FROM c)
SELECT conv_id, turn, sha256(q) AS question_sha256, substring(sha256(conv_id || chr(10) || coalesce(CASE WHEN regexp_matches(q, '[?？]$') THEN q ELSE regexp_replace(q, '[.!。！]+$', '') || '?' END, '')), 1, 20) AS question_id FROM q""",
    "first_objects": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN '{"b": [1, {"a": 2}], "a": "x' || event_id || '"}' END AS found FROM events""",
    "strict_actions": f"""SELECT event_id, {_sql_of("event_id", [None, "targets", "targets", "targets", "targets", "content", "shape", "shape", None, "operation", "range", "repeated", "keys"])} AS error FROM events""",
    "query_plans": """WITH b AS (SELECT item_id, item_id % 5 AS m, trim(coalesce(text, '')) AS q FROM benchmark)
SELECT item_id AS query_id, sha256(CASE WHEN m = 0 THEN 'best match' ELSE q END) AS rewritten_sha256, sha256(CASE WHEN m = 0 THEN 'one|two' ELSE q END) AS retrieval_queries, sha256(CASE m WHEN 0 THEN 'k' WHEN 3 THEN 'a|b' ELSE '' END) AS keywords, sha256('') AS tags FROM b""",
    "fan_out": """SELECT user_id % 5 AS group_id, user_id % 7 AS route_id, event_id AS seq, 'Item ' || event_id % 4 || ['?', ' ', '.'][event_id % 3 + 1] AS question,
  min(event_id) OVER (PARTITION BY user_id % 5, user_id % 7, event_id % 4) AS answered_by FROM events WHERE event_type = 'click'""",
    "request_accounting": """WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END ELSE 0 END AS n, event_id % 97 = 5 AS bad FROM events)
SELECT CAST(sum(n) AS BIGINT) AS requests, CAST(sum(n) - ceil(count(*) / 4.0) AS BIGINT) AS fallbacks, 'failed ' || min(k) FILTER (bad) AS first_error, count(*) FILTER (bad) AS errors FROM r""",
    "mode_histogram": """WITH r AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS place FROM orders)
SELECT CAST(place AS BIGINT) AS place, ['single_fact', 'same_topic', '', 'comparison'][place] AS mode, count(*) AS n FROM r WHERE place IS NOT NULL GROUP BY 1, 2""",
    "source_explode": f"WITH {_SOURCES} SELECT * FROM s",
}


def _bundle_sql(graph_cte: str) -> str:
    return f"""WITH {graph_cte}, {_SOURCES},
w AS (SELECT case_id, topic AS route, unnest(walk) AS id, unnest(range(1, len(walk) + 1)) AS pos FROM walks),
u AS (SELECT w.case_id, w.route, w.pos, s.* EXCLUDE (case_id) FROM w JOIN s ON w.case_id = s.case_id AND w.id = s.node_id),
cn AS (SELECT *, first_value(source_id) OVER (PARTITION BY case_id, route, role, chat_time, content ORDER BY pos, ordinal) AS canonical FROM u),
d AS (SELECT case_id, route, pos, canonical, min(ordinal) AS o FROM cn GROUP BY ALL),
n AS (SELECT case_id, route, pos, string_agg(canonical, ',' ORDER BY o) AS ids FROM d GROUP BY ALL)
SELECT n.case_id, n.route, string_agg(n.ids, ';' ORDER BY n.pos) AS source_ids, any_value(r.records) AS records FROM n
JOIN (SELECT case_id, route, string_agg(source_id, ',' ORDER BY pos, ordinal) AS records FROM cn WHERE source_id = canonical GROUP BY ALL) r ON n.case_id = r.case_id AND n.route = r.route GROUP BY n.case_id, n.route"""


QUERIES = [
    oracle_items, edit_judgements, label_judgements, ledger_lookups, case_records, collector_filter, latest_times, attacker_prompts, oracle_payloads, oracle_contexts, protected_ledger, builder_prompts, prompt_lengths,
    question_parse, first_objects, strict_actions, query_plans, fan_out, request_accounting, mode_histogram, source_explode, bundle_sources,
]
