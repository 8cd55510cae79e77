"""DuckDB SQL with the results of ``queries``, over the driver's tables."""

from __future__ import annotations

from engram.functions.text import COMPARISON_DIMENSIONS, STATE_TERMS, TRANSITION_TERMS

from . import collection, state

UPPER_WORD, WORD = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_]+"
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"

GRAPH = """
c AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS case_id, lower(c_mktsegment) AS seg FROM customer),
o AS (SELECT orders.*, c.case_id, c.seg FROM orders JOIN c ON o_custkey = c_custkey),
nodes AS (
  SELECT case_id, 'c:' || c_custkey AS id, 'topic' AS type, 'activated' AS status, seg AS memory, '' AS key, [seg] AS tags, CAST(NULL AS TIMESTAMP) AS chat_time FROM c
  UNION ALL
  SELECT case_id, 'o:' || o_orderkey, 'fact', CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'activated' END,
    'plan ' || CASE WHEN o_totalprice < 100000 THEN 'budget purchase now' WHEN o_totalprice < 200000 THEN 'weekly schedule changed' ELSE 'favorite place' END || ' ' || lower(o_orderpriority),
    o_orderstatus, [lower(o_orderpriority), seg], o_orderdate FROM o),
edges AS (
  SELECT case_id, CASE WHEN o_orderkey % 2 = 1 THEN 'o:' || o_orderkey ELSE 'c:' || o_custkey END AS source,
    CASE WHEN o_orderkey % 2 = 1 THEN 'c:' || o_custkey ELSE 'o:' || o_orderkey END AS target, 'PARENT' AS type FROM o
  UNION ALL
  SELECT case_id, 'o:' || o_orderkey, 'o:' || n, 'MERGED_TO' FROM (
    SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM o) WHERE n IS NOT NULL),
tf AS (
  SELECT e.case_id, CASE WHEN s.type = 'topic' THEN s.id ELSE t.id END AS topic, CASE WHEN s.type = 'topic' THEN t.id ELSE s.id END AS fact,
    CASE WHEN s.type = 'topic' THEN 'forward' ELSE 'reverse' END AS direction
  FROM edges e JOIN nodes s ON e.case_id = s.case_id AND e.source = s.id JOIN nodes t ON e.case_id = t.case_id AND e.target = t.id
  WHERE e.type = 'PARENT' AND s.type <> t.type),
active AS (SELECT case_id, id, lower(concat_ws(' ', nullif(key, ''), memory, array_to_string(tags, ' '))) AS text, tags FROM nodes WHERE type = 'fact' AND status = 'activated'),
atf AS (SELECT DISTINCT tf.case_id, topic, fact FROM tf JOIN active a ON tf.case_id = a.case_id AND tf.fact = a.id),
st AS (SELECT case_id, topic, count(*) AS n_facts, list_sort(list(fact)) AS facts FROM atf GROUP BY case_id, topic HAVING count(*) >= 2),
walks AS (SELECT case_id, topic, CASE WHEN n_facts = 2 THEN [facts[1], topic, facts[2]] ELSE [facts[1], topic, facts[2], topic, facts[3]] END AS walk FROM st)"""


def _any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _dimension(name: str, terms: list[str]) -> str:
    tests = []
    for t in terms:
        if t.isascii() and t != "$":
            tests.append(f"regexp_matches(text, '(^|{UPPER_WORD}){t}({UPPER_WORD}|$)')")
        else:
            tests.append(f"contains(text, '{t}')")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END"


DIMENSIONS = "list_filter([" + ", ".join(_dimension(n, t) for n, t in COMPARISON_DIMENSIONS.items()) + "], lambda x: x IS NOT NULL)"

TEMPORAL = f"""
f AS (SELECT case_id, id, status, chat_time, tags, lower(concat_ws(' ', nullif(key, ''), memory, array_to_string(tags, ' '))) AS text FROM nodes WHERE type = 'fact'),
p AS (SELECT e.case_id, e.source, e.target, ' ' || t.text || ' ' AS padded, list_intersect(s.tags, t.tags) AS shared
  FROM edges e JOIN f s ON e.case_id = s.case_id AND e.source = s.id AND s.status = 'archived' JOIN f t ON e.case_id = t.case_id AND e.target = t.id AND t.status = 'activated'
  WHERE e.type = 'MERGED_TO' AND t.chat_time > s.chat_time),
d AS (SELECT *, CASE WHEN {_any("padded", TRANSITION_TERMS)} THEN coalesce(list_min(list_transform(shared, lambda x: {{'n': length(x), 't': x}})).t, CASE WHEN {_any("padded", STATE_TERMS)} THEN 'state' END) END AS dimension FROM p)"""

BM25 = f"""
d AS (SELECT doc_id AS id, regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '{TOKEN}') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark),
tf AS (SELECT id, term, any_value(l) AS l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.l / n.a))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""

PLANS = f"""
plans AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')) AS words, 'src' || CAST(item_id % 20 AS VARCHAR) AS tag FROM benchmark),
kw AS (SELECT query_id, unnest(words) AS word FROM plans),
md AS MATERIALIZED (
  SELECT query_id, doc_id AS id, 1.0::DOUBLE AS score FROM plans JOIN documents ON lower(lang) = tag OR lower(source) = tag
  UNION SELECT query_id, doc_id, 1.0 FROM kw JOIN documents ON contains(lower(text), word))"""

NEAR = "near AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id)"


def _expand(seeds: str, name: str) -> str:
    return f"""
{name}_m AS (SELECT s.query_id, near.b AS id, s.id AS seed, s.score, row_number() OVER (PARTITION BY s.query_id, near.b ORDER BY s.score DESC, s.id) AS turn
  FROM {seeds} s JOIN near ON s.id = near.a WHERE (s.query_id, near.b) NOT IN (SELECT (x.query_id, x.id) FROM {seeds} x)),
{name} AS (SELECT query_id, id, seed, 1 AS hop, round(score * 0.8, 6) AS score FROM {name}_m WHERE turn = 1)"""


HYBRID = f"""{PLANS}, {NEAR},
act AS MATERIALIZED (SELECT * FROM documents WHERE doc_id % 10 <> 9),
d AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '{TOKEN}') AS t FROM act),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text || ' src' || CAST(item_id % 20 AS VARCHAR)), '{TOKEN}')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT id, term, any_value(l) AS l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS MATERIALIZED (SELECT query_id, id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.l / n.a))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, id),
lexall AS MATERIALIZED (SELECT query_id, id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM bm),
ne AS (SELECT count(*) AS n FROM embeddings),
nv AS MATERIALIZED (SELECT act.doc_id AS id, CAST(e.embedding AS DOUBLE[]) AS v FROM act, ne JOIN embeddings e ON e.vec_id = act.doc_id % ne.n),
qv AS MATERIALIZED (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM (SELECT item_id, unnest([0, 1]) AS part FROM benchmark) b, ne JOIN embeddings e ON e.vec_id = (b.item_id + b.part) % ne.n),
vecall AS MATERIALIZED (SELECT query_id, id, round((max(round(list_cosine_similarity(qv.v, nv.v), 6)) + 1) / 2, 7) AS score FROM qv, nv GROUP BY query_id, id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src, query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, 'bm25' AS src FROM lexall UNION ALL SELECT *, 'embedding' FROM vecall)),
channels AS MATERIALIZED (SELECT query_id, id, score, src FROM ranked WHERE rank <= 20 AND score > 0 UNION ALL SELECT md.*, 'metadata' FROM md JOIN act ON md.id = act.doc_id),
seeds AS MATERIALIZED (SELECT query_id, id, max(score) AS score FROM channels GROUP BY query_id, id), {_expand('seeds', 'ex')},
fused AS MATERIALIZED (
  SELECT query_id, id, round(max(score), 7) AS recall_score, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources
  FROM (SELECT * FROM channels UNION ALL SELECT query_id, id, score, 'graph' FROM ex WHERE id % 10 <> 9) GROUP BY query_id, id),
few AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recall_score DESC, id) AS rank FROM fused QUALIFY rank <= 40)"""

FIVE = """
rr AS (SELECT few.* EXCLUDE (rank), round((length(text) % 97) / 97.0::DOUBLE, 6) AS score FROM few JOIN documents ON doc_id = id),
r5 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM rr QUALIFY rank <= 5)"""

COSINES = "cos AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"

QUESTIONS = """
c0 AS (SELECT conv_id, turn, coalesce(text, '') AS said, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS before FROM conversations),
qs AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'Which memory is ' WHEN conv_id % 5 = 1 THEN 'what of C' || conv_id || ' ' ELSE 'memorial ' END
    || said || CASE turn % 3 WHEN 0 THEN '??' WHEN 1 THEN ' ?' ELSE '.' END AS question, 'c' || conv_id AS node, CASE WHEN turn % 4 = 0 THEN said ELSE coalesce(before, '') END AS answer
  FROM c0)"""


def _fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _normal(c: str) -> str:
    inner = f"regexp_replace({_fold(c)}, '[?.!？。！]+$', '')"
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"


def _plain(c: str) -> str:
    return f"trim(regexp_replace({_fold(c)}, '{WORD}', ' ', 'g'))"


MODE4 = "['single_fact', 'same_topic', 'temporal_evolution', 'comparison']"

EDITS = """
ed AS (
  SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'add' WHEN event_type = 'click' THEN 'merge' WHEN event_type = 'error' THEN 'delete' ELSE 'noop' END AS op
  FROM events)"""

ATTACKS = """
a0 AS (
  SELECT event_id AS k, value AS u, CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'what is blue ' || CASE WHEN event_id % 2 = 0 THEN '?' ELSE '.' END END AS question,
    round((event_id * 7 % 101) / 100, 2) AS relevance, CASE WHEN event_id % 41 = 0 THEN 'Blue!' ELSE 'red' END AS answer,
    CASE WHEN event_id % 13 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS fidelity, CASE WHEN event_id % 3 = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS gold,
    round((event_id * 3 % 101) / 100, 2) AS parametric, round((event_id * 5 % 101) / 100, 2) AS memory, round(abs(value) / (1 + abs(value)), 2) AS val,
    least(1.0, greatest(0.0, (0.92::DOUBLE - (0.7::DOUBLE + 0.25::DOUBLE * round((event_id * 11 % 101) / 100, 2))) / (0.92::DOUBLE - 0.75::DOUBLE))) AS novelty FROM events),
a1 AS (
  SELECT *, list_min(list_filter([
    CASE WHEN gold < 0.8::DOUBLE THEN {'score': gold / 0.8::DOUBLE - 1, 'k': 0, 'stage': 'gold_invalid'} END,
    CASE WHEN parametric >= 0.8::DOUBLE THEN {'score': -parametric, 'k': 1, 'stage': 'parametric_answerable'} END,
    CASE WHEN memory >= 0.8::DOUBLE THEN {'score': -memory, 'k': 2, 'stage': 'memory_answerable'} END,
    CASE WHEN val < 0.5::DOUBLE THEN {'score': val / 0.5::DOUBLE - 1, 'k': 3, 'stage': 'low_value'} END,
    CASE WHEN novelty < 0.2::DOUBLE THEN {'score': novelty / 0.2::DOUBLE - 1, 'k': 4, 'stage': 'redundant'} END], lambda x: x IS NOT NULL)) AS worst,
    CASE WHEN k % 2 = 0 THEN 0.0 ELSE 0.05 END::DOUBLE AS pen FROM a0),
a2 AS (
  SELECT *, CASE WHEN question IS NULL THEN 'schema_invalid' WHEN k % 29 = 0 THEN 'id_leak' WHEN k % 31 = 0 THEN 'duplicate' WHEN k % 37 = 0 THEN 'oracle_unavailable'
    WHEN k % 17 = 0 THEN 'oracle_invalid' WHEN k % 41 = 0 THEN 'answer_leak' WHEN fidelity < 0.8 THEN 'route_unfaithful' WHEN k % 43 = 0 THEN 'gold_insufficient'
    WHEN k % 47 = 0 THEN 'judge_unavailable' WHEN worst IS NOT NULL THEN worst.stage ELSE 'scored' END AS stage FROM a1),
a3 AS (
  SELECT *, round(CASE stage WHEN 'schema_invalid' THEN -1.0 WHEN 'id_leak' THEN -0.9 WHEN 'duplicate' THEN -1.0 WHEN 'oracle_unavailable' THEN 0.0
    WHEN 'oracle_invalid' THEN greatest(-1.0, -0.8 + 0.4 * relevance - pen) WHEN 'answer_leak' THEN -1.0 WHEN 'route_unfaithful' THEN -1.0 WHEN 'gold_insufficient' THEN -1.0
    WHEN 'judge_unavailable' THEN 0.0 WHEN 'scored' THEN greatest(-1.0, least(1.0, 0.4 * (1 - memory) + 0.25 * val + 0.2 * novelty + 0.15 * fidelity) - pen)
    ELSE greatest(-1.0, worst.score - pen) END::DOUBLE, 6) AS score FROM a2)"""

BUILDER = """
b0 AS (
  SELECT event_id AS k, event_id % 4 AS o, round((event_id * 7 % 101) / 100, 2) AS bef, round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 5 % 101) / 100, 2) AS aft, round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 3 % 101) / 100, 2) AS g,
    round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 11 % 101) / 100, 2) AS aq, round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 13 % 101) / 100, 2) AS mq,
    CASE WHEN event_id % 2 = 0 THEN least(round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 17 % 101) / 100, 2), round(0.55::DOUBLE + 0.45::DOUBLE * (event_id * 19 % 101) / 100, 2)) ELSE 1.0 END::DOUBLE AS kept,
    least(1.0, greatest(0, event_id * 3 % 50 - event_id % 50) / greatest(1, event_id % 20)::DOUBLE) AS growth, least(1.0, greatest(0, event_id % 50 - event_id * 3 % 50) / greatest(1, event_id % 50)::DOUBLE) AS shrink FROM events),
b1 AS (SELECT *, CASE o WHEN 0 THEN k % 140 BETWEEN 1 AND 128 WHEN 1 THEN k % 6 < 5 AND k % 140 BETWEEN 1 AND 128 WHEN 2 THEN k % 6 < 5 ELSE true END AS sem,
  list_min(list_filter([CASE WHEN g < 0.8::DOUBLE THEN g / 0.8::DOUBLE - 1 END, CASE WHEN aft < 0.8::DOUBLE THEN aft / 0.8::DOUBLE - 1 END, CASE WHEN aq < 0.6::DOUBLE THEN aq / 0.6::DOUBLE - 1 END, CASE WHEN mq < 0.6::DOUBLE THEN mq / 0.6::DOUBLE - 1 END, CASE WHEN kept < 0.8::DOUBLE THEN kept / 0.8::DOUBLE - 1 END], lambda x: x IS NOT NULL)) AS worst FROM b0),
b2 AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'schema_invalid' WHEN k % 23 = 0 THEN 'constraint_invalid' WHEN NOT sem THEN 'action_invalid' WHEN k % 29 = 0 THEN 'judge_unavailable' WHEN worst IS NOT NULL THEN 'failed' ELSE 'scored' END AS stage FROM b1),
b3 AS (SELECT *, k AS event_id, round(CASE stage WHEN 'schema_invalid' THEN -1.0 WHEN 'constraint_invalid' THEN -0.8 WHEN 'action_invalid' THEN -0.7 WHEN 'judge_unavailable' THEN 0.0 WHEN 'failed' THEN worst
  ELSE least(1.0, greatest(0.0, 0.7 * greatest(0.0, aft - bef) + 0.2 * (aq + mq) / 2 + 0.1 * shrink - 0.1 * growth)) END::DOUBLE, 6) AS score, CASE WHEN stage = 'scored' THEN 1.0 ELSE 0.0 END::DOUBLE AS commit_valid FROM b2)"""

EARLY = "('schema_invalid', 'question_invalid', 'multiple_questions', 'metadata_leak', 'id_leak')"
ATTACK_METRICS = f"""
af AS (
  SELECT *, stage <> 'schema_invalid' AS parsed, stage NOT IN {EARLY} AS asked,
    stage NOT IN {EARLY} AND stage NOT IN ('duplicate', 'oracle_unavailable', 'oracle_invalid') AS ok,
    stage NOT IN {EARLY} AND stage NOT IN ('duplicate', 'oracle_unavailable', 'oracle_invalid', 'answer_leak', 'route_unfaithful', 'gold_insufficient', 'judge_unavailable') AS seen FROM a3),
am AS (
  SELECT k, k AS event_id, stage, score, CASE WHEN stage IN ('oracle_unavailable', 'judge_unavailable') THEN 0.0 ELSE 1.0 END::DOUBLE AS reward_available,
    parsed::INT::DOUBLE AS schema_valid, parsed::INT::DOUBLE AS format_valid, asked::INT::DOUBLE AS question_valid, (parsed AND k % 2 = 0)::INT::DOUBLE AS question_mark, ok::INT::DOUBLE AS oracle_valid,
    CASE WHEN seen THEN gold ELSE 0 END::DOUBLE AS gold_correctness, (seen AND gold >= 0.8::DOUBLE)::INT::DOUBLE AS gold_pass,
    CASE WHEN seen THEN memory ELSE 0 END::DOUBLE AS memory_correctness, round(CASE WHEN seen THEN 1 - memory ELSE 0 END::DOUBLE, 6) AS uncovered, (seen AND memory < 0.8::DOUBLE)::INT::DOUBLE AS uncovered_pass,
    CASE WHEN seen THEN parametric ELSE 0 END::DOUBLE AS parametric_correctness, (seen AND parametric < 0.8::DOUBLE)::INT::DOUBLE AS parametric_pass,
    CASE WHEN seen THEN val ELSE 0 END::DOUBLE AS value, (seen AND val >= 0.5::DOUBLE)::INT::DOUBLE AS value_pass,
    round(CASE WHEN seen THEN novelty ELSE 0 END::DOUBLE, 6) AS novelty, (seen AND novelty >= 0.2::DOUBLE)::INT::DOUBLE AS novelty_pass,
    CASE WHEN ok THEN fidelity ELSE 0 END::DOUBLE AS route_fidelity, (ok AND fidelity >= 0.8)::INT::DOUBLE AS route_pass, (stage = 'scored')::INT::DOUBLE AS attack_valid FROM af)"""

MARK_CLASS = "[.!。！]+$"

_MODES = f"""WITH {GRAPH},
dim AS (SELECT case_id, id, unnest({DIMENSIONS}) AS dimension FROM active),
u AS (SELECT atf.*, dim.dimension FROM atf JOIN dim ON atf.case_id = dim.case_id AND atf.fact = dim.id),
f AS (SELECT case_id, id, status, chat_time, tags, lower(concat_ws(' ', nullif(key, ''), memory, array_to_string(tags, ' '))) AS text FROM nodes WHERE type = 'fact'),
tp AS (SELECT e.case_id, ' ' || t.text || ' ' AS padded, list_intersect(s.tags, t.tags) AS shared
  FROM edges e JOIN f s ON e.case_id = s.case_id AND e.source = s.id AND s.status = 'archived' JOIN f t ON e.case_id = t.case_id AND e.target = t.id AND t.status = 'activated' WHERE e.type = 'MERGED_TO' AND t.chat_time > s.chat_time),
mc AS (
  SELECT case_id, 'single_fact' AS mode, 1 AS k FROM active UNION ALL SELECT case_id, 'same_topic', len(walk) FROM walks
  UNION ALL SELECT case_id, 'temporal_evolution', 2 FROM tp WHERE {_any("padded", TRANSITION_TERMS)} AND (len(shared) > 0 OR {_any("padded", STATE_TERMS)})
  UNION ALL SELECT a.case_id, 'comparison', 3 FROM u a JOIN u b ON a.case_id = b.case_id AND a.topic = b.topic AND a.dimension = b.dimension AND a.fact < b.fact)
SELECT case_id, mode, count(*) AS n, CAST(sum(k) AS BIGINT) AS steps FROM mc GROUP BY ALL"""

SQL = collection.SQL | state.build(GRAPH, EDITS, TOKEN) | {
    "bundle_sources": collection._bundle_sql(GRAPH),
    "mode_candidates": _MODES,
    "case_summary": f"""WITH {GRAPH}
SELECT n.*, coalesce(e.edges, 0) AS edges, coalesce(e.parent, 0) AS parent, coalesce(e.merged_to, 0) AS merged_to FROM (
  SELECT case_id, count(*) AS nodes, count(*) FILTER (status = 'activated') AS activated, count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (type = 'fact') AS fact, count(*) FILTER (type = 'topic') AS topic FROM nodes GROUP BY case_id) n
LEFT JOIN (SELECT case_id, count(*) AS edges, count(*) FILTER (type = 'PARENT') AS parent, count(*) FILTER (type = 'MERGED_TO') AS merged_to FROM edges GROUP BY case_id) e ON n.case_id = e.case_id""",
    "relation_histogram": f"WITH {GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY type",
    "case_edges": f"""WITH {GRAPH}
SELECT case_id, source, target, type FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.status = 'activated' AND n.case_id = e.case_id AND n.id = e.source)
  AND EXISTS (SELECT 1 FROM nodes n WHERE n.status = 'activated' AND n.case_id = e.case_id AND n.id = e.target)""",
    "case_index_parse": r"""SELECT user_name, CAST(nullif(regexp_extract(user_name, '^lme_exper_user_v1_(\d+)$', 1), '') AS INTEGER) AS case_index
FROM (SELECT CASE WHEN n_regionkey = 0 THEN 'other_' ELSE 'lme_exper_user_v1_' END || n_nationkey AS user_name FROM nation)""",
    "missing_users": "SELECT c_name AS user_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "topic_fact_index": f"WITH {GRAPH} SELECT * FROM tf",
    "single_fact_candidates": f"WITH {GRAPH} SELECT case_id, id AS fact FROM active",
    "same_topic_candidates": f"WITH {GRAPH} SELECT case_id, topic, n_facts, array_to_string(facts, ',') AS facts FROM st",
    "temporal_candidates": f"""WITH {GRAPH},
{TEMPORAL}
SELECT case_id, source, target, dimension FROM d WHERE dimension IS NOT NULL""",
    "comparison_candidates": f"""WITH {GRAPH},
dim AS (SELECT case_id, id, unnest({DIMENSIONS}) AS dimension FROM active),
u AS (SELECT atf.*, dim.dimension FROM atf JOIN dim ON atf.case_id = dim.case_id AND atf.fact = dim.id)
SELECT a.case_id, a.topic, a.fact AS fact_a, b.fact AS fact_b, a.dimension FROM u a JOIN u b ON a.case_id = b.case_id AND a.topic = b.topic AND a.dimension = b.dimension AND a.fact < b.fact""",
    "comparison_classes": f"""WITH {GRAPH},
m AS (SELECT atf.case_id, topic, unnest({DIMENSIONS}) AS dimension, length(n.memory) % 3 AS v FROM atf JOIN active a ON atf.case_id = a.case_id AND fact = a.id JOIN nodes n ON atf.case_id = n.case_id AND fact = n.id),
k AS (SELECT case_id, topic, dimension, v, count(*) AS n FROM m GROUP BY ALL)
SELECT x.case_id, x.topic, x.dimension, x.v AS low, y.v AS high, CASE WHEN x.v = y.v THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS pairs FROM k x JOIN k y ON x.case_id = y.case_id AND x.topic = y.topic AND x.dimension = y.dimension AND x.v <= y.v WHERE x.v < y.v OR x.n > 1""",
    "route_laps": f"""WITH {GRAPH},
{TEMPORAL},
m AS (SELECT atf.case_id, topic, unnest({DIMENSIONS}) AS dimension FROM atf JOIN active a ON atf.case_id = a.case_id AND fact = a.id),
totals AS (
  SELECT case_id, 1 AS k, count(*) AS n FROM active GROUP BY 1
  UNION ALL SELECT case_id, 2, sum(n_facts * (n_facts - 1) + n_facts * (n_facts - 1) * (n_facts - 2)) FROM st GROUP BY 1
  UNION ALL SELECT case_id, 3, count(DISTINCT (source, target, dimension)) FROM d WHERE dimension IS NOT NULL GROUP BY 1
  UNION ALL SELECT case_id, 4, sum(n * (n - 1) // 2) FROM (SELECT case_id, topic, dimension, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1),
turns AS (SELECT case_id, k, lap, row_number() OVER (PARTITION BY case_id ORDER BY lap, k) AS place FROM totals, range(1, 7) l(lap) WHERE lap <= n)
SELECT case_id, {MODE4}[k] AS mode, count(*) AS routes, count(*) AS signatures, CAST(min(lap) AS INTEGER) AS first_lap, CAST(max(lap) AS INTEGER) AS last_lap FROM turns WHERE place <= 6 GROUP BY case_id, k""",
    "walk_signature": f"""WITH {GRAPH}
SELECT case_id, topic, array_to_string(walk, '>') AS walk, substring(sha256(case_id || '|same_topic||' || array_to_string(walk, '|')), 1, 20) AS signature FROM walks""",
    "walk_directions": f"""WITH {GRAPH},
every AS (SELECT * FROM edges UNION ALL SELECT case_id, target, source, type FROM edges WHERE type = 'PARENT' AND length(source || target) % 2 = 0),
turns AS (
  SELECT case_id, source AS a, target AS b, type, 'forward' AS direction, source AS s, target AS t, 0 AS back FROM every
  UNION ALL SELECT case_id, target, source, type, 'reverse', source, target, 1 FROM every),
known AS (SELECT case_id, a, b, type, direction FROM turns QUALIFY row_number() OVER (PARTITION BY case_id, a, b, type ORDER BY s DESC, t DESC, back DESC) = 1),
steps AS (SELECT case_id, topic AS route, k - 1 AS step, walk[k] AS from_id, walk[k + 1] AS to_id FROM (SELECT *, unnest(range(1, len(walk))) AS k FROM walks))
SELECT s.case_id, s.from_id, s.to_id, s.route, CAST(s.step AS INTEGER) AS step, known.type, known.direction FROM steps s JOIN known ON s.case_id = known.case_id AND s.from_id = known.a AND s.to_id = known.b""",
    "source_dedup": """SELECT conv_id % 20 AS route, conv_id || ':' || turn AS source_id,
first_value(conv_id || ':' || turn) OVER (PARTITION BY conv_id % 20, role, coalesce(text, '') ORDER BY conv_id, turn) AS canonical_id FROM conversations""",
    "token_counts": rf"SELECT doc_id AS id, CAST(len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+|[\x{{4e00}}-\x{{9fff}}]')) AS BIGINT) AS tokens FROM documents",
    "doc_freq": f"SELECT term, count(DISTINCT id) AS df FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '{TOKEN}')) AS term FROM documents) GROUP BY term",
    "bm25_topk": f"WITH {BM25} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 20 AND score > 0",
    "vector_topk": f"WITH {COSINES} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos) WHERE rank <= 20 AND score > 0",
    "metadata_match": f"WITH {PLANS} SELECT * FROM md",
    "provenance_neighbours": """WITH p AS (SELECT 'c' || c_custkey AS id, CAST(floor(c_custkey / 7.0) AS BIGINT) AS m FROM customer)
SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.m = b.m AND a.id <> b.id""",
    "graph_expand": f"WITH {BM25}, {NEAR}, seeds AS (SELECT * FROM bmr WHERE rank <= 5 AND score > 0), {_expand('seeds', 'ex')} SELECT * FROM ex",
    "hybrid_fusion": f"WITH {HYBRID} SELECT query_id, id, recall_score AS score, CAST(rank AS INTEGER) AS rank, sources FROM few",
    "hybrid_retrieve": f"""WITH {HYBRID}, {FIVE}
SELECT r5.query_id, r5.id, r5.score, r5.rank, r5.recall_score, r5.sources, ex.seed, coalesce(ex.hop, 0) AS hop FROM r5 LEFT JOIN ex ON r5.query_id = ex.query_id AND r5.id = ex.id AND ex.id % 10 <> 9""",
    "defence_evaluation": f"""WITH {HYBRID}, {FIVE},
h AS (SELECT query_id, list({{'id': id, 'n': length(text)}} ORDER BY rank) AS nodes FROM r5 JOIN documents ON id = doc_id GROUP BY query_id),
j AS (SELECT *, CASE WHEN n % 7 <> 0 THEN (n % 11) / 10.0::DOUBLE END AS c FROM (SELECT *, list_sum(list_transform(nodes, lambda x: x.n)) AS n FROM h)),
won AS (SELECT query_id, nodes FROM j WHERE c >= 0.5), {state.eliminated("won", "query_id")}
SELECT item_id AS question_id, array_to_string(list_transform(j.nodes, lambda x: x.id), ',') AS node_ids, CASE WHEN j.query_id IS NULL THEN 0.0 ELSE c END AS correctness,
  CASE WHEN j.query_id IS NULL THEN 'pending' WHEN c IS NULL THEN 'unavailable' WHEN c >= 0.5 THEN 'success' ELSE 'pending' END AS outcome, array_to_string(list_transform(kept, lambda x: x.id), ',') AS support
FROM benchmark LEFT JOIN j ON item_id = j.query_id LEFT JOIN el5 ON item_id = el5.query_id""",
    "question_constraints": f"""WITH {QUESTIONS}
SELECT conv_id, turn, CASE WHEN question = '' THEN 'question_invalid' WHEN len(regexp_extract_all(question, '[?？]')) > 1 THEN 'multiple_questions'
  WHEN regexp_matches(question, '(?i)(^|{UPPER_WORD})(route|evidence|facts?|nodes?|memory|context|ids?|instructions?)({UPPER_WORD}|$)') THEN 'metadata_leak'
  WHEN contains(lower(question), node) THEN 'id_leak' END AS error FROM qs""",
    "question_forms": f"""WITH {QUESTIONS}
SELECT conv_id, turn, {_normal("question")} AS normal, CASE WHEN regexp_matches(question, '[?？]$') THEN question ELSE regexp_replace(question, '{MARK_CLASS}', '') || '?' END AS marked,
  {_plain("answer")} <> '' AND contains(' ' || {_plain("question")} || ' ', ' ' || {_plain("answer")} || ' ') AS leaked, turn % 2 = 0 AS abstained FROM qs""",
    "duplicate_antijoin": f"""WITH {QUESTIONS}, q AS (SELECT conv_id % 7 AS group_id, conv_id * 100 + turn AS seq, turn, {_normal("question")} AS normal FROM qs)
SELECT group_id, seq, EXISTS (SELECT 1 FROM q k WHERE k.turn = 0 AND k.group_id = q.group_id AND k.normal = q.normal) OR row_number() OVER (PARTITION BY group_id, normal ORDER BY seq) > 1 AS duplicate FROM q WHERE turn > 0""",
    "route_fidelity": f"""SELECT o_orderkey, {MODE4}[o_orderkey % 4 + 1] AS mode, least(1.0, (
  CAST(o_orderkey % 5 IN (o_orderkey % 4, o_orderkey % 6) OR o_orderkey % 3 IN (o_orderkey % 4, o_orderkey % 6) AS INTEGER) + CAST(o_orderkey % 7 IN (o_orderkey % 4, o_orderkey % 6) AS INTEGER))
  / CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 2.0 END)::DOUBLE AS fidelity FROM orders""",
    "attacker_reward": f"WITH {ATTACKS} SELECT k AS event_id, stage, score, CASE WHEN stage IN ('oracle_unavailable', 'judge_unavailable') THEN 0.0 ELSE 1.0 END::DOUBLE AS reward_available FROM a3",
    "attack_metrics": f"WITH {ATTACKS}, {ATTACK_METRICS} SELECT * EXCLUDE (k) FROM am",
    "reward_summary": f"""WITH {ATTACKS}, {ATTACK_METRICS}
SELECT count(*) AS samples, count(*) FILTER (score > 0) AS positive, count(*) FILTER (score = 0) AS neutral, count(*) FILTER (score < 0) AS negative,
  count(*) FILTER (stage = 'oracle_unavailable') AS oracle_unavailable, count(*) FILTER (stage = 'judge_unavailable') AS judge_unavailable,
  {", ".join(f"count(*) FILTER ({c} > 0) AS {c}" for c in ("schema_valid", "question_valid", "oracle_valid", "route_pass", "gold_pass", "parametric_pass", "uncovered_pass", "value_pass", "novelty_pass", "attack_valid"))},
  count(DISTINCT CASE WHEN k % 37 = 0 THEN k // 1000 END) AS batch_fallbacks FROM am""",
    "builder_reward": f"WITH {BUILDER} SELECT event_id, stage, score, commit_valid FROM b3",
    "grpo_advantage": """WITH w AS (SELECT event_id, user_id, value, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN value END AS s FROM events),
g AS (SELECT *, count(s) OVER (PARTITION BY user_id) AS n, avg(s) OVER (PARTITION BY user_id) AS m, stddev_samp(s) OVER (PARTITION BY user_id) AS sd FROM w)
SELECT event_id, round(CASE WHEN NOT ok OR n = 1 THEN 0.0 ELSE (value - m) / (sd + 1e-6) END, 6) AS advantage FROM g""",
    "novelty": f"WITH {COSINES} SELECT query_id, round(least(1.0, greatest(0.0, (0.92::DOUBLE - max(score)) / (0.92::DOUBLE - 0.75::DOUBLE))), 6) AS novelty FROM cos WHERE query_id <> id GROUP BY query_id",
    "memory_versions": f"WITH {EDITS} SELECT case_id, seq, op, CAST(sum(CASE WHEN op <> 'noop' THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq) AS BIGINT) AS version FROM ed",
    "edit_fold": f"""WITH RECURSIVE {EDITS},
a AS (SELECT *, count(*) FILTER (op = 'add') OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS adds FROM ed),
e AS (SELECT * EXCLUDE (op), CASE WHEN op IN ('merge', 'delete') AND adds = 0 THEN 'noop' ELSE op END AS op FROM a),
n AS (SELECT *, count(*) FILTER (op IN ('add', 'merge')) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM e),
made AS (SELECT case_id, c + 1 AS r, op, k FROM n WHERE op IN ('add', 'merge')),
t AS (SELECT case_id, op, c + 1 AS of, unnest(CASE WHEN c > 1 THEN [c, c - 1] ELSE [c] END) AS r FROM n WHERE op IN ('merge', 'delete')),
gone AS (SELECT case_id, count(DISTINCT r) AS n FROM t GROUP BY case_id),
reach AS (SELECT case_id, r AS of, r FROM made UNION SELECT t.case_id, reach.of, t.r FROM reach JOIN t ON t.case_id = reach.case_id AND t.of = reach.r AND t.op = 'merge'),
m AS (SELECT reach.case_id, reach.of, count(DISTINCT k) AS links, count(DISTINCT k % 5) AS rests FROM reach JOIN made ON reach.case_id = made.case_id AND reach.r = made.r GROUP BY ALL),
s AS (SELECT case_id, count(*) FILTER (op IN ('add', 'merge')) AS nodes, count(*) FILTER (op <> 'noop') AS version FROM e GROUP BY case_id),
l AS (SELECT case_id, sum(links) AS links, sum(rests) AS rests FROM m GROUP BY case_id)
SELECT s.case_id, s.nodes, s.nodes - coalesce(gone.n, 0) AS active, 2 * s.nodes AS tokens, s.version, CAST(l.links AS BIGINT) AS links, CAST(l.rests AS BIGINT) AS rests_on
FROM s LEFT JOIN gone ON s.case_id = gone.case_id LEFT JOIN l ON s.case_id = l.case_id WHERE s.nodes > 0""",
    "builder_metrics": f"""WITH {BUILDER},
f AS (SELECT *, stage NOT IN ('schema_invalid', 'constraint_invalid', 'action_invalid') AS acted, stage NOT IN ('schema_invalid', 'constraint_invalid', 'action_invalid', 'judge_unavailable') AS seen FROM b3)
SELECT event_id, stage, score, (stage <> 'judge_unavailable')::INT::DOUBLE AS reward_available, acted::INT::DOUBLE AS action_valid, (seen AND aft >= 0.8::DOUBLE)::INT::DOUBLE AS answer_pass,
  CASE WHEN seen THEN kept ELSE 0 END::DOUBLE AS retention, (seen AND kept >= 0.8::DOUBLE)::INT::DOUBLE AS retention_pass, round(CASE WHEN acted THEN growth ELSE 0 END::DOUBLE, 6) AS memory_cost,
  round(CASE WHEN seen THEN greatest(0.0, aft - bef) ELSE 0 END::DOUBLE, 6) AS gain, CASE WHEN seen THEN g ELSE 0 END::DOUBLE AS groundedness FROM f""",
    "pool_membership": f"""WITH {EDITS}, p AS (SELECT case_id, k AS question_id, seq, CASE WHEN op = 'delete' THEN 'high_priority' ELSE 'success' END AS pool FROM ed WHERE op <> 'noop'),
l AS (SELECT *, last_value(pool) OVER (PARTITION BY case_id, question_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM p),
b AS (SELECT case_id, question_id, now AS pool, max(CASE WHEN pool <> now THEN seq ELSE 0 END) AS broke FROM l GROUP BY ALL)
SELECT b.case_id, b.question_id, b.pool, min(p.seq) AS entered FROM b JOIN p ON b.case_id = p.case_id AND b.question_id = p.question_id AND p.seq > b.broke GROUP BY ALL""",
    "link_binding": f"""WITH {EDITS}, l AS (SELECT case_id, k, max(seq) AS seq, arg_max(event_id, seq) AS e FROM ed WHERE op <> 'noop' GROUP BY case_id, k)
SELECT case_id, node_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY seq) AS linked_questions FROM (SELECT case_id, k, seq, unnest([e % 6, e % 4 + 10]) AS node_id FROM l) GROUP BY case_id, node_id""",
    "protected_questions": f"""WITH {EDITS}, l AS (SELECT case_id, k AS question_id, min(seq) AS seq, arg_max(op, seq) AS op, arg_max(event_id, seq) % 9 AS node FROM ed GROUP BY case_id, k),
n AS (SELECT case_id, event_id % 9 AS node FROM ed WHERE seq = 1),
p AS (SELECT l.*, CASE WHEN n.node IS NOT NULL THEN 1 ELSE 0 END AS linked FROM l LEFT JOIN n ON l.case_id = n.case_id AND l.node = n.node WHERE op <> 'delete'),
r AS (SELECT *, max(linked) OVER (PARTITION BY case_id) AS any_linked FROM p)
SELECT case_id, question_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS rank FROM r WHERE linked = any_linked) WHERE rank <= 3""",
    "round_robin": f"""WITH r AS (SELECT o_custkey AS case_id, o_orderkey % 7 % 4 AS m, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 % 4 ORDER BY o_orderkey) AS lap FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY lap, m) AS place FROM r) SELECT case_id, {MODE4}[m + 1] AS mode, seq, place FROM p WHERE place <= 8""",
    "priority_fill": "SELECT case_id, item, place FROM (SELECT o_custkey AS case_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders) WHERE place <= 8",
    "stratified_sizes": """WITH s AS (SELECT o_orderpriority AS mode, count(*) AS n FROM orders GROUP BY 1),
v AS (SELECT mode, n, greatest(0, least(greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)), n - 1)) AS v FROM s)
SELECT mode, 'val' AS split, v AS n FROM v WHERE v > 0 UNION ALL SELECT mode, 'train', n - v FROM v WHERE n > v""",
    "compaction_pairs": """WITH n AS (SELECT c_nationkey AS case_id, c_custkey AS id, c_mktsegment AS tag FROM customer),
x AS (SELECT a.case_id, CASE WHEN a.tag = b.tag THEN 0 ELSE 1 END AS kind, a.id AS i, b.id AS j, a.id || ',' || b.id AS ids FROM n a JOIN n b ON a.case_id = b.case_id AND a.id < b.id
  UNION ALL SELECT case_id, 2, id, 0, CAST(id AS VARCHAR) FROM n)
SELECT case_id, place, ids FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY kind, i, j) AS place FROM x) WHERE place <= 8""",
    "stop_streak": """WITH r AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS round, count(*) FILTER (event_type = 'error') = 0 AS saturated FROM events GROUP BY 1, 2),
i AS (SELECT *, sum(CASE WHEN saturated THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY round) AS island FROM r),
s AS (SELECT *, CAST(sum(CASE WHEN saturated THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, island ORDER BY round) AS BIGINT) AS streak FROM i)
SELECT case_id, round, saturated, streak, streak >= 2 AS stopped FROM s""",
    "saturation": """WITH s AS (SELECT c.case_id, coalesce(f.n >= 4 AND f.judged AND f.open = 0 AND w.case_id IS NULL, false) AS saturated, c.nodes FROM (
  SELECT user_id AS case_id, count(*) FILTER (event_type = 'signup') AS nodes FROM events GROUP BY 1) c
LEFT JOIN (SELECT user_id AS case_id, count(*) AS n, bool_and(event_id % 97 <> 0) AS judged, count(*) FILTER (event_id % 53 = 0) AS open FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) f ON c.case_id = f.case_id
LEFT JOIN (SELECT DISTINCT user_id AS case_id FROM events WHERE event_type = 'error' AND value > 100) w ON c.case_id = w.case_id)
SELECT case_id, saturated, saturated AND nodes = 0 AS builder_saturated FROM s""",
    "action_validation": """WITH a AS (SELECT event_id AS k, ['add', 'merge', 'delete', 'noop', 'move'][event_id % 5 + 1] AS op, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN [event_id % 4] ELSE [event_id % 4, event_id % 7] END AS t, event_id % 2 = 0 AS has FROM events)
SELECT k AS event_id, CASE WHEN k % 13 = 0 OR k % 11 = 0 THEN 'keys' WHEN op = 'move' THEN 'operation' WHEN len(list_distinct(t)) <> len(t) THEN 'repeated' WHEN len(list_filter(t, lambda x: x >= 5)) > 0 THEN 'range'
  WHEN op = 'add' AND (len(t) > 0 OR NOT has) THEN 'shape' WHEN op = 'merge' AND (len(t) = 0 OR NOT has) THEN 'shape' WHEN op = 'delete' AND (len(t) = 0 OR has) THEN 'shape' WHEN op = 'noop' AND (len(t) > 0 OR has) THEN 'shape' END AS error FROM a""",
    "oracle_reconcile": """WITH e AS (SELECT event_id, CAST(floor(event_id / 4.0) AS BIGINT) AS batch FROM events),
a AS (SELECT batch, CASE WHEN event_id % 10 = 3 THEN event_id % 4 + 1 ELSE event_id % 4 END AS item, count(*) AS n FROM e WHERE event_id % 9 <> 0 GROUP BY 1, 2)
SELECT e.batch, e.event_id % 4 AS item, CASE WHEN a.n IS NULL THEN 'omitted' WHEN a.n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM e LEFT JOIN a ON e.batch = a.batch AND e.event_id % 4 = a.item""",
    "training_records": "SELECT 'attacker' AS data_source, 'memory_attack' AS ability, doc_id AS id, sha256(text) AS truth, 'system' AS first_role, CAST(2 AS BIGINT) AS turns FROM documents",
    "route_bundle": f"""WITH {GRAPH},
e AS (SELECT w.case_id, w.topic AS route, w.k, n.type, n.memory FROM (SELECT case_id, topic, unnest(walk) AS id, unnest(range(1, len(walk) + 1)) AS k FROM walks) w JOIN nodes n ON w.case_id = n.case_id AND w.id = n.id)
SELECT case_id, route, string_agg(memory, chr(10) ORDER BY k) FILTER (type = 'fact') AS query, count(*) FILTER (type = 'fact') AS n_evidence, count(*) FILTER (type = 'topic') AS n_connectors FROM e GROUP BY case_id, route""",
    "mode_fallback": f"""WITH {GRAPH},
dim AS (SELECT case_id, id, unnest({DIMENSIONS}) AS dimension FROM active),
u AS (SELECT atf.*, dim.dimension FROM atf JOIN dim ON atf.case_id = dim.case_id AND atf.fact = dim.id),
p AS (SELECT a.case_id, a.fact AS first FROM u a JOIN u b ON a.case_id = b.case_id AND a.topic = b.topic AND a.dimension = b.dimension AND a.fact < b.fact WHERE a.dimension = 'location')
SELECT * FROM p UNION ALL SELECT case_id, id AS first FROM active WHERE case_id NOT IN (SELECT case_id FROM p)""",
    "mode_funnel": """SELECT o_orderpriority AS mode, count(*) AS sampled, count(*) FILTER (o_orderkey % 3 <> 0) AS attempted, count(*) FILTER (o_totalprice < 150000) AS fits, count(*) FILTER (o_orderstatus = 'O') AS selected FROM orders GROUP BY 1""",
    "time_hull": 'SELECT o_custkey, min(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END) AS start, max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END) AS "end" FROM orders GROUP BY 1',
    "compaction_audit": """WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT case_id, min(place) AS place FROM r WHERE k % 5 <> 0 AND k % 13 < k % 11 AND (k % 2 = 1 OR k % 3 = 0) GROUP BY 1""",
    "round_outcomes": """WITH r AS (SELECT user_id AS case_id, CASE WHEN event_type = 'error' OR value IS NULL THEN 'unavailable' WHEN abs(value / 100) >= 0.8 THEN 'success' ELSE 'pending' END AS o,
  event_type = 'click' AS edit, event_id % 5 <> 0 AND value > 0 AND event_id % 4 > 0 AS kept FROM events)
SELECT case_id, count(*) FILTER (o = 'success') AS success, count(*) FILTER (o = 'pending') AS pending, count(*) FILTER (o = 'unavailable') AS unavailable,
  count(*) FILTER (edit AND kept) AS committed, count(*) FILTER (edit AND NOT coalesce(kept, false)) AS discarded FROM r GROUP BY 1""",
    "guarded_commit": """WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR value <= 0 THEN 'discarded' WHEN event_id % 4 > 0 THEN 'committed' ELSE 'unsupported' END AS outcome FROM events)
SELECT event_id, outcome, CASE WHEN outcome = 'committed' THEN 'success' ELSE 'high_priority' END AS pool FROM r""",
    "replay_queue": """SELECT case_id, question_id, place FROM (SELECT o_custkey AS case_id, o_orderkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey) AS place
FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_totalprice > 50000) WHERE place <= 4""",
    "context_blocks": r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS c, CASE WHEN turn % 3 = 0 THEN printf('2024-01-%02d', turn % 28 + 1) END AS t FROM conversations),
r AS (SELECT *, coalesce(t, 'None') AS st, CASE WHEN turn % 4 = 1 THEN 'None' ELSE '(' || coalesce('''' || t || '''', 'None') || ', ' || coalesce(CASE WHEN turn % 2 = 0 THEN '''' || t || '''' END, 'None') || ')' END AS mt FROM t),
b AS (SELECT conv_id, arg_min(c, (turn, role, c)) AS q, string_agg('[' || conv_id || ':' || turn || '] time=' || st || ' role=' || role || chr(10) || c, chr(10) || chr(10) ORDER BY turn, role, c) AS s,
  string_agg('[' || conv_id || ':' || turn || '] time=' || mt || chr(10) || c, chr(10) || chr(10) ORDER BY turn, role, c) AS m FROM r GROUP BY conv_id)
SELECT conv_id, sha256('Context:' || chr(10) || s || chr(10) || chr(10) || 'Question:' || chr(10) || q) AS sources_sha256, sha256('Context:' || chr(10) || m || chr(10) || chr(10) || 'Question:' || chr(10) || q) AS memories_sha256 FROM b""",
}
