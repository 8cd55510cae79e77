"""Requests to outside models: order, attempts, halving, open requests, verdicts and caches."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from engram.operators import judges, rewards
from engram.sources import providers


def counted(fails):
    """A call that notes what it is asked and fails as ``fails(items, turn)`` says."""
    seen = []

    def call(items):
        seen.append(list(items))
        return fails(items, len(seen))

    return call, seen


def test_a_batch_is_asked_again_for_what_it_lacks():
    call, seen = counted(lambda items, turn: [ValueError("not yet") if x % 2 and turn == 1 else x * 10 for x in items])
    assert providers.resolved(call, [1, 2, 3, 4], alone=3, shared=2) == [(10, None, 2), (20, None, 0), (30, None, 0), (40, None, 0)]
    assert seen == [[1, 2, 3, 4], [1, 3]]


def test_failing_batches_are_halved_to_the_items_that_fail():
    def fails(items, turn):
        if 3 in items:
            raise RuntimeError("three")
        return items

    call, seen = counted(fails)
    got = providers.resolved(call, [1, 2, 3, 4], alone=3, shared=2)
    assert [(r, e) for r, e, _ in got] == [(1, None), (2, None), (None, "RuntimeError: three"), (4, None)]
    assert seen == [[1, 2, 3, 4]] * 2 + [[1, 2]] + [[3, 4]] * 2 + [[3]] * 2 + [[4]] and got[0][2] == len(seen)


def test_the_last_item_of_a_batch_is_asked_by_itself_and_a_single_item_as_often_as_it_may():
    call, seen = counted(lambda items, turn: [ValueError("no") if x == 2 else x for x in items])
    assert providers.resolved(call, [1, 2], alone=3, shared=2)[1][1] == "ValueError: no"
    assert seen == [[1, 2], [2], [2], [2]]
    call, seen = counted(lambda items, turn: [ValueError("no")])
    assert providers.resolved(call, [2], alone=3, shared=2) == [(None, "ValueError: no", 3)] and len(seen) == 3
    assert providers.resolved(call, []) == []
    call, _ = counted(lambda items, turn: items[1:])
    assert providers.resolved(call, [1])[0][1] == "ValueError: 0 results for 1 items"


@pytest.mark.parametrize("most", [1, 3])
def test_open_requests_overlap_within_their_bound_and_keep_order(spark, most):
    def factory():
        lock, state = threading.Lock(), {"open": 0, "most": 0}

        def call(items):
            with lock:
                state["open"] += 1
                state["most"] = max(state["most"], state["open"])
            time.sleep(0.05 if items[0] % 4 else 0.15)
            with lock:
                state["open"] -= 1
            if items[0] == 6:
                raise RuntimeError("six")
            return [f"{x}:{state['most']}" for x in items]

        return call

    rows = spark.range(24).coalesce(1)
    got = providers.with_results(rows, "id", factory, "string", batch=2, alone=2, shared=2, open_requests=most).collect()
    assert [r.id for r in got] == list(range(24))
    assert [r.id for r in got if r.error] == [6] and all(r.result.startswith(f"{r.id}:") for r in got if not r.error)
    assert max(int(r.result.split(":")[1]) for r in got if r.result) == most


def test_answers_see_their_context_and_abstain_without_one(spark):
    def factory():
        return lambda prompts: [f" {p[0]['role']}|{p[1]['content']} " for p in prompts]

    rows = spark.createDataFrame(
        [(1, "Where?", [("m1", ("a", "b"), "Rome.")]), (2, "When?", []), (3, "Who?", None)],
        "id int, question string, memories array<struct<id:string,time_span:struct<start:string,end:string>,content:string>>",
    )
    got = {r.id: r for r in judges.answered_from_memories(rows, factory).collect()}
    assert got[1].answer == "system|Context:\n[m1] time=('a', 'b')\nRome.\n\nQuestion:\nWhere?" and got[1].requests == 1
    assert all((got[k].answer, got[k].requests, got[k].error) == (judges.ABSTAINED, 0, None) for k in (2, 3))
    sources = spark.createDataFrame([(1, "Where?", [("s1", None, "user", "Rome.")]), (2, "Who?", [])], "id int, question string, sources array<struct<source_id:string,chat_time:string,role:string,content:string>>")
    got = {r.id: r for r in judges.answered_from_sources(sources, factory).collect()}
    assert got[1].answer == "system|Context:\n[s1] time=None role=user\nRome.\n\nQuestion:\nWhere?" and got[2].requests == 1


def test_labels_are_asked_for_until_they_are_sound(spark, tmp_path):
    sound = {"gold_correctness": "correct", "memory_correctness": "partial", "value": "high", "parametric_correctness": "incorrect"}
    log = f"{tmp_path}/asked"

    def factory():
        def one(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            with open(log) as f:
                turn = sum(line == prompt + "\n" for line in f)
            if prompt == "down":
                raise RuntimeError("down")
            if prompt == "late" and turn < 3:
                return "no object" if turn == 1 else json.dumps(sound | {"value": "huge"})
            return json.dumps(sound | {"value": "huge"}) if prompt == "wrong" else "Well: {x} " + json.dumps(sound) + " as I said"

        return lambda prompts: [one(p) for p in prompts]

    rows = spark.createDataFrame([(p, "a", "b", "c") for p in ("good", "late", "wrong", "down")] + [("good", "a", "INSUFFICIENT_INFORMATION.", "c")], "prompt string, golden string, memory string, parametric string").coalesce(1)
    out = judges.label_verdicts(rows, factory, open_requests=1)
    got = {(r.prompt, r.memory): r for r in out.collect()}
    assert len(got) == out.count() == 5
    first = got["good", "b"]
    assert (first.verdict.gold, first.verdict.memory, first.verdict.value, first.verdict.parametric, first.error, first.requests) == (1.0, 0.5, 1.0, 0.0, None, 1)
    assert got["good", "INSUFFICIENT_INFORMATION."].verdict.memory == 0.0
    assert (got["late", "b"].error, got["late", "b"].requests, got["late", "b"].verdict.value) == (None, 3, 1.0)
    assert (got["wrong", "b"].error, got["wrong", "b"].verdict) == ("label", None)
    assert got["down", "b"].error == "RuntimeError: down" and got["down", "b"].verdict is None
    with open(log) as f:
        asked = f.read().split()
    assert {p: asked.count(p) for p in set(asked)} == {"good": 2, "late": 3, "wrong": 3, "down": 3}


def test_edit_scores_are_checked(spark):
    def factory():
        scores = {"after_correctness": 0.9, "groundedness": 1, "action_quality": 0.5, "memory_quality": 0.5, "retention_correctness": [1, 0.5]}
        return lambda prompts: [json.dumps(scores) for _ in prompts]

    rows = spark.createDataFrame([("p", "yes", ["a", "insufficient_information"]), ("q", "yes", ["a"])], "prompt string, after_answer string, protected_answers array<string>")
    got = {r.prompt: r for r in judges.edit_verdicts(rows, factory).collect()}
    assert got["p"].error is None and got["p"].verdict.after_correctness == 0.9 and got["p"].verdict.retention == [1.0, 0.0]
    assert got["q"].error == "length" and got["q"].requests == 3


def test_what_is_new_goes_into_the_cache(spark):
    cache = spark.createDataFrame([("k1", "old")], "key string, result string")
    rows = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2"), (4, "bad"), (5, None), (6, None)], "id int, key string")
    asked = []

    def ask(missing):
        asked.append(sorted(r.id for r in missing.collect()))
        return missing.select("key", F.when(F.col("key") != "bad", F.concat(F.lit("new "), F.length("key").cast("string"))).alias("result"), F.when(F.col("key") == "bad", "no").alias("error"))

    out, after = providers.through_cache(rows, cache, ask)
    got = {r.id: (r.key, r.result, r.error) for r in out.collect()}
    assert got == {1: ("k1", "old", None), 2: ("k2", "new 2", None), 3: ("k2", "new 2", None), 4: ("bad", None, "no"), 5: (None, "new 36", None), 6: (None, "new 36", None)}
    assert {r.key: r.result for r in after.collect()} == {"k1": "old", "k2": "new 2"}
    assert len(asked[0]) == 2 and asked[1] == [5, 6]
    again, _ = providers.through_cache(rows.where("id <= 3"), after, ask)
    assert again.where("result is null").count() == 0 and asked[2:] == [[], []]


def test_the_hook_of_edits_scores_each_stage(spark):
    act = lambda op, targets, content: json.dumps({"operation": op, "targets": targets, "content": content})
    solutions = {
        1: "Sure: " + act("add", [], "a new fact"), 2: act("merge", [0, 1], "both"), 3: act("delete", [1], ""), 4: act("noop", [], ""),
        5: "no action", 6: act(3, [], ""), 7: act("add", ["0"], "x"), 8: act("move", [], ""), 9: act("merge", [2], "x"), 10: act("delete", [0, 0], ""),
        11: act("add", [], "word " * 129), 12: act("add", [], "judge is down"), 13: act("add", [], "left out"), 14: act("delete", [0], ""), 15: None,
    }
    rows = spark.createDataFrame(list(solutions.items()), "id int, solution string")
    context = spark.createDataFrame([(k, ["m0", "m1"]) for k in solutions if k != 14], "id int, neighbourhood array<string>")
    seen = {}

    def judge(valid):
        seen.update({r.id: (r.operation, r.target_ids, r.content) for r in valid.collect()})
        marks = valid.where("id <> 13").select("id", (F.col("id") == 12).alias("judge_error"))
        one = {"before": 0.2, "after": 0.9, "groundedness": 0.9, "action_quality": 0.8, "memory_quality": 0.8, "growth": 0.1, "shrink": 0.0}
        return marks.select("*", *(F.lit(x).alias(n) for n, x in one.items()), F.array(F.lit(1.0)).alias("retention"))

    got = {r.id: r for r in rewards.compute_builder_score(rows, context, judge).collect()}
    assert seen == {1: ("add", [], "a new fact"), 2: ("merge", ["m0", "m1"], "both"), 3: ("delete", ["m1"], None), 4: ("noop", [], None), 12: ("add", [], "judge is down"), 13: ("add", [], "left out")}
    stages = {1: "scored", 2: "scored", 3: "scored", 4: "scored", 5: "schema_invalid", 6: "schema_invalid", 7: "schema_invalid", 8: "constraint_invalid", 9: "constraint_invalid", 10: "constraint_invalid", 11: "action_invalid", 12: "judge_unavailable", 13: "judge_unavailable", 14: "constraint_invalid", 15: "schema_invalid"}
    assert {k: r.stage for k, r in got.items()} == stages
    assert (got[5].score, got[8].score, got[11].score, got[12].score, got[12].reward_available) == (-1.0, -0.8, -0.7, 0.0, 0.0)
    p = rewards.BuilderParams()
    assert got[1].score == round(p.gain * 0.7 + p.quality_weight * 0.8 - p.growth * 0.1, 6) and got[1].commit_valid == 1.0
