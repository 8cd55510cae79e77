"""Checks of what outside models return and the gates of collection, as column expressions with error classes.

JSON is read as variants, so types are strict: true is no number, 1.0 and "1" are no whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text
from engram.operators import rounds

# Reasons of an oracle's rejection, labels of a judge and what they count.
INVALID_REASONS = ["not_question", "unsupported", "ambiguous", "answer_leak", "mode_mismatch"]
EQUIVALENCE = {"incorrect": 0.0, "partial": 0.5, "correct": 1.0}
VALUE = {"low": 0.0, "medium": 0.5, "high": 1.0}
JUDGE_SCORES = ["after_correctness", "groundedness", "action_quality", "memory_quality"]


def field(v: Column, name: str) -> Column:
    """A field of a variant object as a variant; null where it is missing."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """The JSON type of a variant, '' where it is missing: BOOLEAN, BIGINT, STRING, VOID, ARRAY<...>, OBJECT<...>, DECIMAL(...), DOUBLE."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def keys_are(v: Column, *names: str) -> Column:
    keys = F.array_sort(F.json_object_keys(F.to_json(v)))
    return F.coalesce(keys == F.array(*map(F.lit, sorted(names))), F.lit(False))


def is_number(v: Column) -> Column:
    return kind(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)")


def elements(v: Column) -> Column:
    """A variant array's elements; null for anything else."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def oracle_items(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """batch, item, error, valid, answer, sources, reason of each question asked.

    ``requested``: batch, item, n_sources; ``answered``: batch, response (JSON: results, a list of items).  Items that weren't
    asked for are ignored; error is schema (of the whole response), omitted, duplicate, validity, keys, reason or answer,
    else null.  An answer that names a source that isn't there is a rejection as unsupported.
    """
    payload = F.try_parse_json("response")
    results = elements(field(F.col("v"), "results"))
    whole = answered.withColumn("v", payload).withColumn("sound", keys_are(F.col("v"), "results") & results.isNotNull())
    each = whole.where("sound").select("batch", F.explode(results).alias("r"))
    item_id = F.when(kind(field(F.col("r"), "id")) == "BIGINT", F.try_variant_get("r", "$.id", "long"))
    found = each.select("batch", item_id.alias("item"), "r").where("item is not null").groupBy("batch", "item").agg(F.count("*").alias("n"), F.first("r").alias("r"))
    r = F.col("r")
    valid, reason, answer = F.try_variant_get(r, "$.valid", "boolean"), F.try_variant_get(r, "$.reason", "string"), F.try_variant_get(r, "$.answer", "string")
    ids = elements(field(r, "sources"))
    numbers = F.transform(ids, lambda x: F.try_variant_get(x, "$", "long"))
    whole_ids = (F.size(ids) > 0) & F.forall(ids, lambda x: kind(x) == "BIGINT") & (F.size(F.array_distinct(numbers)) == F.size(ids))
    good_answer = (kind(field(r, "answer")) == "STRING") & (text.strip(answer) != "") & F.coalesce(whole_ids, F.lit(False))
    error = (
        F.when(~F.coalesce("sound", F.lit(False)), "schema")
        .when(F.col("n").isNull(), "omitted")
        .when(F.col("n") > 1, "duplicate")
        .when(kind(field(r, "valid")) != "BOOLEAN", "validity")
        .when(~valid & ~keys_are(r, "id", "valid", "reason"), "keys")
        .when(~valid & ~F.coalesce((kind(field(r, "reason")) == "STRING") & reason.isin(INVALID_REASONS), F.lit(False)), "reason")
        .when(valid & ~keys_are(r, "id", "valid", "answer", "sources"), "keys")
        .when(valid & ~F.coalesce(good_answer, F.lit(False)), "answer")
    )
    both = requested.join(whole.select("batch", "sound"), "batch", "left").join(found, ["batch", "item"], "left").withColumn("error", error)
    known = F.forall(numbers, lambda x: (x >= 0) & (x < F.col("n_sources")))
    ok, says = F.col("error").isNull(), F.coalesce(valid, F.lit(False))
    supported = ok & says & F.coalesce(known, F.lit(False))
    return both.select(
        "batch", "item", "error",
        F.when(ok, supported).alias("valid"),
        F.when(supported, text.strip(answer)).alias("answer"),
        F.when(supported, numbers).alias("sources"),
        F.when(ok & ~says, reason).when(ok & ~supported, "unsupported").alias("reason"),
    )


def edit_judgement(response: Column, after_answer: Column, protected_answers: Column) -> Column:
    """error (keys, numeric, list, range, length or null) and the scores of an edit judge's JSON; an abstained answer's scores are 0."""
    v = F.try_parse_json(response)
    retention = elements(field(v, "retention_correctness"))
    score = lambda x: F.try_variant_get(x, "$", "double")
    scores = [score(field(v, name)) for name in JUDGE_SCORES]
    kept = F.transform(retention, score)
    inside = lambda x: (x >= 0) & (x <= 1)
    missing = [kind(field(v, name)) == "" for name in [*JUDGE_SCORES, "retention_correctness"]]
    any_of = lambda tests: F.array_contains(F.array(*(F.coalesce(t, F.lit(True)) for t in tests)), True)
    error = (
        F.when(~kind(v).startswith("OBJECT") | any_of(missing), "keys")
        .when(any_of([~is_number(field(v, name)) for name in JUDGE_SCORES]), "numeric")
        .when(retention.isNull() | ~F.coalesce(F.forall(retention, is_number), F.lit(False)), "list")
        .when(any_of([~inside(s) for s in scores]) | ~F.coalesce(F.forall(kept, inside), F.lit(False)), "range")
        .when(F.size(kept) != F.size(protected_answers), "length")
    )
    zeroed = F.zip_with(kept, protected_answers, lambda s, a: F.when(text.is_abstention(a), 0.0).otherwise(s))
    good = error.isNull()
    named = [F.when(good, F.when(text.is_abstention(after_answer), 0.0).otherwise(s) if name == "after_correctness" else s).alias(name) for name, s in zip(JUDGE_SCORES, scores, strict=True)]
    return F.struct(error.alias("error"), *named, F.when(good, zeroed).alias("retention"))


def label_judgement(response: Column, golden: Column, memory: Column, parametric: Column | None) -> Column:
    """error (keys, label or null), gold, memory, parametric, value of an answer judge's JSON of labels; abstained answers are 0."""
    v = F.try_parse_json(response)
    names = ["gold_correctness", "memory_correctness", "value"] + (["parametric_correctness"] if parametric is not None else [])
    score_of = lambda table, c: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)
    label = lambda name: F.when(kind(field(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    scores = {name: score_of(VALUE if name == "value" else EQUIVALENCE, label(name)) for name in names}
    error = F.when(~keys_are(v, *names), "keys").when(F.array_contains(F.array(*(s.isNull() for s in scores.values())), True), "label")
    part = lambda name, answer: F.when(error.isNull(), F.when(text.is_abstention(answer), 0.0).otherwise(scores[name]))
    return F.struct(
        error.alias("error"), part("gold_correctness", golden).alias("gold"), part("memory_correctness", memory).alias("memory"),
        (part("parametric_correctness", parametric) if parametric is not None else F.when(error.isNull(), 0.0)).alias("parametric"), F.when(error.isNull(), scores["value"]).alias("value"),
    )


def ledger_lookup(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of ``wanted`` (case_id, question_ids) in order: case_id, place, question_id, found and the ledger's columns."""
    each = wanted.select("case_id", F.posexplode("question_ids").alias("place", "question_id"))
    return each.join(ledger.withColumn("found", F.lit(True)), ["case_id", "question_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def demand(rows: DataFrame, condition: Column, what: str) -> DataFrame:
    """``rows``, whose every row must fulfil the condition: reading one that doesn't is an error that names ``what``."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def case_records(cases: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Each case (case_index, user_name) with its record and error: no_user (no node of the user), no_record (beyond the records) or null."""
    users = nodes.select("user_name").distinct().withColumn("_has", F.lit(True))
    both = cases.join(users, "user_name", "left").join(records.withColumn("_known", F.lit(True)), "case_index", "left")
    return both.withColumn("error", F.when(F.col("_has").isNull(), "no_user").when(F.col("_known").isNull(), "no_record")).drop("_has", "_known")


def collected(rows: DataFrame, prior: DataFrame, count: int, route: float = 0.8, gold: float = 0.8, value: float = 0.5, parametric: float = 0.8) -> DataFrame:
    """The questions that training takes: case_id, seq, question (marked), question_id, place; ``count`` for each case, in route order.

    ``rows``: case_id, seq, route_id, response, identifiers, oracle_error, oracle_valid, answer, fidelity, golden_answer,
    parametric_answer, judge_error, gold, value, parametric; ``prior``: case_id, question.  A question passes if it parses,
    breaks no rule, isn't known, and oracle, answers and judge find it answerable, supported, useful and not common knowledge;
    of passing ones with one normal form the first is taken.
    """
    c = F.col
    parsed = rows.withColumn("_q", text.parsed_question(c("response"))).withColumn("_normal", text.normal_question(c("_q")))
    cheap = parsed.where(c("_q").isNotNull() & text.question_error(c("_q"), c("identifiers")).isNull())
    seen = prior.select("case_id", text.normal_question(c("question")).alias("_normal")).distinct()
    fresh = cheap.join(seen, ["case_id", "_normal"], "left_anti")
    sound = ~c("oracle_error") & c("oracle_valid") & ~text.leaks_answer(c("_q"), c("answer")) & (c("fidelity") >= route) & ~text.is_abstention(c("golden_answer"))
    common = ~text.is_abstention(c("parametric_answer")) & (c("parametric") >= parametric)
    passing = fresh.where(F.coalesce(sound & ~c("judge_error") & (c("gold") >= gold) & (c("value") >= value) & ~common, F.lit(False)))
    firsts = passing.withColumn("_turn", F.row_number().over(Window.partitionBy("case_id", "_normal").orderBy("seq"))).where("_turn = 1")
    placed = firsts.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))).where(c("place") <= count)
    marked = text.with_question_mark(c("_q"))
    return placed.select("case_id", "seq", marked.alias("question"), rounds.question_id(c("route_id"), marked).alias("question_id"), "place")


def prompt_tokens(prompt: Column) -> Column:
    """Token estimate of a prompt (array of role, content): words and signs of all turns."""
    return F.aggregate(F.transform(prompt, lambda t: text.token_count(t["content"])), F.lit(0), lambda a, n: a + n)


def fitting(records: DataFrame, most: int, length=None) -> DataFrame:
    """``records`` (prompt) whose prompt has at most ``most`` tokens; ``length`` gives a prompt's exact number, such as a
    pandas function over a tokenizer, and without one the estimate counts."""
    return records.where((length or prompt_tokens)(F.col("prompt")) <= most)
