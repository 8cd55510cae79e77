"""Rule cascades for rewards, and group-normalised advantages.

A cascade is one ordered list of (stage, condition, score); the same list makes
the stage and the score, so their order can't differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text


@dataclass(frozen=True)
class AttackParams:
    gold: float = 0.8
    parametric: float = 0.8
    memory: float = 0.8
    value: float = 0.5
    novelty: float = 0.2
    route: float = 0.8
    novelty_low: float = 0.75
    novelty_high: float = 0.92
    weights: tuple[float, float, float, float] = (0.4, 0.25, 0.2, 0.15)
    mark_penalty: float = 0.05


@dataclass(frozen=True)
class BuilderParams:
    grounding: float = 0.8
    answer: float = 0.8
    retention: float = 0.8
    quality: float = 0.6
    max_tokens: int = 128
    gain: float = 0.7
    quality_weight: float = 0.2
    growth: float = 0.1
    shrink: float = 0.1


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def label_score(label: Column) -> Column:
    """correct and high 1, partial and medium 0.5, incorrect and low 0; null for any other."""
    return F.when(label.isin("correct", "high"), 1.0).when(label.isin("partial", "medium"), 0.5).when(label.isin("incorrect", "low"), 0.0)


def fidelity(mode: Column, evidence_source_ids: Column, used: Column) -> Column:
    """Share of the evidence nodes needed (one, or two beyond single_fact) that a used source supports."""
    met = F.size(F.filter(evidence_source_ids, lambda ids: F.coalesce(F.arrays_overlap(ids, used), F.lit(False))))
    return F.least(F.lit(1.0), met / F.when(mode == "single_fact", 1).otherwise(2))


def novelty(max_cosine: Column, p: AttackParams = AttackParams()) -> Column:
    """1 without earlier questions."""
    return F.when(max_cosine.isNull(), 1.0).otherwise(clip((F.lit(p.novelty_high) - max_cosine) / (p.novelty_high - p.novelty_low)))


def attack_rewards(rows: DataFrame, p: AttackParams = AttackParams()) -> DataFrame:
    """``rows`` with stage, score and reward_available.

    Columns read: question (null if it doesn't parse), error (of question_error), duplicate, oracle_error,
    oracle_valid, relevance, answer, fidelity, golden_answer, judge_error, gold, parametric, memory, value, novelty.
    """
    c = F.col
    marked = text.has_question_mark(F.coalesce(c("question"), F.lit("")))
    penalised = lambda s: F.greatest(F.lit(-1.0), s - F.when(marked, 0.0).otherwise(p.mark_penalty))
    gates = [
        ("gold_invalid", c("gold") < p.gold, c("gold") / p.gold - 1),
        ("parametric_answerable", c("parametric") >= p.parametric, -c("parametric")),
        ("memory_answerable", c("memory") >= p.memory, -c("memory")),
        ("low_value", c("value") < p.value, c("value") / p.value - 1),
        ("redundant", c("novelty") < p.novelty, c("novelty") / p.novelty - 1),
    ]
    failed = F.filter(F.array(*(F.when(bad, F.struct(score.alias("score"), F.lit(k).alias("k"), F.lit(name).alias("stage"))) for k, (name, bad, score) in enumerate(gates))), lambda x: x.isNotNull())
    worst = F.array_min(failed)
    w = p.weights
    whole = F.least(F.lit(1.0), w[0] * (1 - c("memory")) + w[1] * c("value") + w[2] * c("novelty") + w[3] * c("fidelity"))
    rules = [
        ("schema_invalid", c("question").isNull(), F.lit(-1.0)),
        (c("error"), c("error").isNotNull(), F.lit(-0.9)),
        ("duplicate", c("duplicate"), F.lit(-1.0)),
        ("oracle_unavailable", c("oracle_error"), F.lit(0.0)),
        ("oracle_invalid", ~c("oracle_valid"), penalised(-0.8 + 0.4 * c("relevance"))),
        ("answer_leak", text.leaks_answer(c("question"), c("answer")), penalised(F.lit(-1.0))),
        ("route_unfaithful", c("fidelity") < p.route, penalised(F.lit(-1.0))),
        ("gold_insufficient", text.is_abstention(c("golden_answer")), penalised(F.lit(-1.0))),
        ("judge_unavailable", c("judge_error"), F.lit(0.0)),
        (worst["stage"], F.size(failed) > 0, penalised(worst["score"])),
        ("scored", F.lit(True), penalised(whole)),
    ]
    stage = score = None
    for name, when, value in rules:
        name = F.lit(name) if isinstance(name, str) else name
        stage = F.when(when, name) if stage is None else stage.when(when, name)
        score = F.when(when, value) if score is None else score.when(when, value)
    out = rows.withColumn("stage", stage).withColumn("score", F.round(score, 6))
    return out.withColumn("reward_available", (~c("stage").isin("oracle_unavailable", "judge_unavailable")).cast("double"))


def builder_rewards(rows: DataFrame, p: BuilderParams = BuilderParams()) -> DataFrame:
    """``rows`` with stage, score, commit_valid.

    Columns read: schema_valid, constraint_valid, semantic_valid, judge_error, before, after, groundedness,
    action_quality, memory_quality, retention (array), growth, shrink.
    """
    c = F.col
    kept = F.coalesce(F.array_min("retention"), F.lit(1.0))
    checks = [(c("groundedness"), p.grounding), (c("after"), p.answer), (c("action_quality"), p.quality), (c("memory_quality"), p.quality), (kept, p.retention)]
    worst = F.array_min(F.filter(F.array(*(F.when(v < t, v / t - 1) for v, t in checks)), lambda x: x.isNotNull()))
    gain = F.greatest(F.lit(0.0), c("after") - c("before"))
    whole = clip(p.gain * gain + p.quality_weight * (c("action_quality") + c("memory_quality")) / 2 + p.shrink * c("shrink") - p.growth * c("growth"))
    stage = F.when(~c("schema_valid"), "schema_invalid").when(~c("constraint_valid"), "constraint_invalid").when(~c("semantic_valid"), "action_invalid").when(c("judge_error"), "judge_unavailable").when(worst.isNotNull(), "failed").otherwise("scored")
    score = F.when(~c("schema_valid"), -1.0).when(~c("constraint_valid"), -0.8).when(~c("semantic_valid"), -0.7).when(c("judge_error"), 0.0).when(worst.isNotNull(), worst).otherwise(whole)
    return rows.withColumn("stage", stage).withColumn("score", F.round(score, 6)).withColumn("commit_valid", (stage == "scored").cast("double"))


def edit_valid(op: Column, targets: Column, neighbourhood: Column, new_tokens: Column, most: int = 128) -> Column:
    """Whether an edit's targets are near and its content fits its operation; ``new_tokens`` is null without content."""
    near = F.size(F.array_except(targets, neighbourhood)) == 0
    some, has = F.size(targets) > 0, F.coalesce((new_tokens > 0) & (new_tokens <= most), F.lit(False))
    shape = F.when(op == "add", ~some & has).when(op == "merge", some & has).when(op == "delete", some & new_tokens.isNull()).otherwise(~some & new_tokens.isNull())
    return near & shape


def compaction_valid(op: Column, targets: Column, neighbourhood: Column) -> Column:
    n = F.size(targets)
    return (n > 0) & (F.size(F.array_except(targets, neighbourhood)) == 0) & ((op == "delete") | ((op == "merge") & (n >= 2)))


def attack_metrics(rows: DataFrame, p: AttackParams = AttackParams()) -> DataFrame:
    """``attack_rewards`` as the full vector of metrics, 0 for what a stage doesn't come to; other columns stay in front.

    Columns that already have a metric's name give way to it.
    """
    c, s = F.col, F.col("stage")
    early = ["schema_invalid", "question_invalid", "multiple_questions", "metadata_leak", "id_leak"]
    hard = ["answer_leak", "route_unfaithful", "gold_insufficient", "judge_unavailable"]
    valid = ~s.isin(*early, "duplicate", "oracle_unavailable", "oracle_invalid")
    judged = valid & ~s.isin(hard)
    marked = text.has_question_mark(F.coalesce(c("question"), F.lit("")))
    at = lambda when, value: F.when(when, F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(0.0)
    metrics = {
        "score": c("score"), "reward_available": c("reward_available"), "schema_valid": at(s != "schema_invalid", F.lit(1)), "question_valid": at(~s.isin(early), F.lit(1)),
        "question_mark": at(s != "schema_invalid", marked), "oracle_valid": at(valid, F.lit(1)), "gold_correctness": at(judged, c("gold")), "gold_pass": at(judged, c("gold") >= p.gold),
        "memory_correctness": at(judged, c("memory")), "uncovered": at(judged, 1 - c("memory")), "uncovered_pass": at(judged, c("memory") < p.memory),
        "parametric_correctness": at(judged, c("parametric")), "parametric_pass": at(judged, c("parametric") < p.parametric), "value": at(judged, c("value")), "value_pass": at(judged, c("value") >= p.value),
        "novelty": at(judged, c("novelty")), "novelty_pass": at(judged, c("novelty") >= p.novelty), "route_fidelity": at(valid, c("fidelity")), "route_pass": at(valid, c("fidelity") >= p.route),
        "attack_valid": at(s == "scored", F.lit(1)),
    }
    metrics["format_valid"] = metrics["schema_valid"]
    return rows.select(*(f"`{n}`" for n in rows.columns if n not in metrics), *(value.alias(name) for name, value in metrics.items()))


def builder_metrics(rows: DataFrame, p: BuilderParams = BuilderParams()) -> DataFrame:
    """``builder_rewards`` as the full vector of metrics, as ``attack_metrics``."""
    c, s = F.col, F.col("stage")
    acted = ~s.isin("schema_invalid", "constraint_invalid", "action_invalid")
    judged = acted & (s != "judge_unavailable")
    kept = F.coalesce(F.array_min("retention"), F.lit(1.0))
    at = lambda when, value: F.when(when, F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(0.0)
    metrics = {
        "score": c("score"), "reward_available": at(s != "judge_unavailable", F.lit(1)), "schema_valid": at(s != "schema_invalid", F.lit(1)), "action_valid": at(acted, F.lit(1)),
        "groundedness": at(judged, c("groundedness")), "after_correctness": at(judged, c("after")), "answer_pass": at(judged, c("after") >= p.answer), "action_quality": at(judged, c("action_quality")),
        "memory_quality": at(judged, c("memory_quality")), "retention_min": at(judged, kept), "retention_pass": at(judged, kept >= p.retention), "growth": at(acted, c("growth")), "shrink": at(acted, c("shrink")),
        "commit_valid": c("commit_valid"), "gain": at(judged, F.greatest(F.lit(0.0), c("after") - c("before"))),
    }
    metrics |= {"retention": metrics["retention_min"], "memory_cost": metrics["growth"]}
    return rows.select(*(f"`{n}`" for n in rows.columns if n not in metrics), *(value.alias(name) for name, value in metrics.items()))


def compute_score(solutions: DataFrame, context: DataFrame, p: AttackParams = AttackParams()) -> DataFrame:
    """A trainer's reward hook: metrics of each of ``solutions`` (id, group_id, solution), ``context`` (id and the columns of
    ``attack_rewards`` but question, error and duplicate; also identifiers and prior, an array of earlier questions)."""
    both = solutions.join(context, "id").withColumn("question", text.parsed_question(F.col("solution")))
    known = F.transform(F.coalesce("prior", F.array().cast("array<string>")), text.normal_question)
    both = both.withColumn("error", text.question_error(F.col("question"), F.col("identifiers"))).withColumn("duplicate", F.coalesce(F.array_contains(known, text.normal_question(F.col("question"))), F.lit(False)))
    return attack_metrics(attack_rewards(both, p), p).drop("solution", "identifiers", "prior")


def compute_builder_score(solutions: DataFrame, context: DataFrame, judge, p: BuilderParams = BuilderParams(), most: int = 128) -> DataFrame:
    """A trainer's reward hook for edits: metrics of each of ``solutions`` (id, solution).

    ``context``: id, neighbourhood (the memories' ids by place).  The first JSON object with an action's keys in a solution
    counts.  ``judge(rows)`` gets the valid ones (id, operation, target_ids, content, null where the operation has none) and gives
    id, judge_error, before, after, groundedness, action_quality, memory_quality, retention, growth, shrink; an action that it
    leaves out has no reward.  Content has at most ``most`` tokens.  A solution without a context has an empty neighbourhood.
    """
    from engram.functions import jsonx
    from engram.operators import checks

    near = F.coalesce("neighbourhood", F.array().cast("array<string>"))
    both = solutions.join(context.select("id", "neighbourhood"), "id", "left").withColumn("_action", jsonx.first_object(("operation", "targets", "content"))(F.col("solution")))
    v, error = F.try_parse_json("_action"), F.col("_error")
    both = both.withColumn("_error", jsonx.action_error(F.col("_action"), F.size(near)))
    named = checks.kind(checks.field(v, "operation")) == "STRING"
    schema = error.isNull() | ~(error.isin("keys", "targets", "content") | ((error == "operation") & ~named))
    op = F.when(error.isNull(), F.try_variant_get(v, "$.operation", "string"))
    places = F.when(error.isNull(), F.try_variant_get(v, "$.targets", "array<int>"))
    content = F.when(op.isin("add", "merge"), F.try_variant_get(v, "$.content", "string"))
    read = both.select("id", near.alias("_near"), schema.alias("schema_valid"), error.isNull().alias("constraint_valid"), op.alias("operation"), places.alias("_places"), content.alias("content"))
    targets = F.transform("_places", lambda i: F.get(F.col("_near"), i))
    read = read.withColumn("target_ids", targets)
    valid = edit_valid(F.col("operation"), F.col("target_ids"), F.col("_near"), F.when(F.col("content").isNotNull(), text.token_count(F.col("content"))), most)
    rows = read.withColumn("semantic_valid", F.coalesce(valid, F.lit(False))).drop("_near", "_places")
    marks = judge(rows.where("semantic_valid").select("id", "operation", "target_ids", "content"))
    scored = rows.join(marks, "id", "left").withColumn("judge_error", F.coalesce("judge_error", F.lit(True)))
    return builder_metrics(builder_rewards(scored, p), p).drop("operation", "target_ids", "content")


def reward_summary(metrics: DataFrame) -> DataFrame:
    """One row of counts over ``attack_metrics``; batch_fallbacks counts the different batches whose oracle call failed whole
    (a column batch_error, if there is one)."""
    n = lambda c: F.count_if(c)
    off = F.col("reward_available") == 0
    passes = ["schema_valid", "question_valid", "oracle_valid", "route_pass", "gold_pass", "parametric_pass", "uncovered_pass", "value_pass", "novelty_pass", "attack_valid"]
    fallbacks = F.count_distinct("batch_error") if "batch_error" in metrics.columns else F.lit(0).cast("long")
    return metrics.agg(
        F.count("*").alias("samples"), n(F.col("score") > 0).alias("positive"), n(F.col("score") == 0).alias("neutral"), n(F.col("score") < 0).alias("negative"),
        n(off & (F.col("oracle_valid") == 0)).alias("oracle_unavailable"), n(off & (F.col("oracle_valid") > 0)).alias("judge_unavailable"),
        *(n(F.col(c) > 0).alias(c) for c in passes), fallbacks.alias("batch_fallbacks"),
    )


def question_text(question: Column, answer: Column) -> Column:
    """What novelty compares: the question with its answer."""
    return F.concat(question, F.lit("\nAnswer: "), answer)


def route_relevance(question: Column, evidence: Column) -> Column:
    """The best cosine of a question's vector with the evidence's vectors, from 0 to 1."""
    from engram.operators.retrieval import cosine

    return clip(F.array_max(F.transform(evidence, lambda v: cosine(question, v))))


def fanned_out(rows: DataFrame, evaluate) -> DataFrame:
    """``rows`` (group_id, route_id, seq, question) with the columns that ``evaluate`` adds to a row.

    Questions of a group and route with one normal form are evaluated once, by the first, and all get what came back.
    """
    key = ["group_id", "route_id", "_normal"]
    normal = rows.withColumn("_normal", text.normal_question(F.col("question")))
    firsts = normal.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_turn = 1").drop("_turn")
    done = evaluate(firsts)
    new = [c for c in done.columns if c not in firsts.columns]
    return normal.join(done.select(*key, *new), key, "left").drop("_normal")


def advantages(rows: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """``rows`` (uid, score, available) with advantage: the score against its group's available ones; 0 if unavailable."""
    w = Window.partitionBy("uid")
    score = F.when(F.col("available"), F.col("score"))
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
    base = (F.col("score") - mean) / (std + eps) if by_std else F.col("score") - mean
    return rows.withColumn("advantage", F.round(F.when(~F.col("available"), 0.0).when(n == 1, 0.0).otherwise(base), 6))


def duplicates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (group_id, seq, question) with normal, duplicate: known in the group already or asked before in it."""
    normal = rows.withColumn("normal", text.normal_question(F.col("question")))
    seen = known.select("group_id", text.normal_question(F.col("question")).alias("normal"), F.lit(True).alias("known")).distinct()
    first = F.row_number().over(Window.partitionBy("group_id", "normal").orderBy("seq")) == 1
    return normal.join(seen, ["group_id", "normal"], "left").withColumn("duplicate", F.coalesce("known", F.lit(False)) | ~first).drop("known")


def reconciled(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """batch, item, status (ok, duplicate, omitted) of each item asked for; answers to others are ignored."""
    n = answered.groupBy("batch", "item").agg(F.count("*").alias("n"))
    both = requested.join(n, ["batch", "item"], "left")
    return both.select("batch", "item", F.when(F.col("n").isNull(), "omitted").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("status"))
