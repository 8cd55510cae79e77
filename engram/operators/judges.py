"""Answerers and judges: prompts go out in tasks, answers come back as columns and are checked there.

``factory`` is a provider's, as in ``sources.providers``: called once a task, for a function from a list of prompts (a
list of turns, role and content) to a list of texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import jsonx, templates
from engram.operators import checks
from engram.session import checkpointed
from engram.sources import providers

#: The text that stands for no answer.
ABSTAINED = "INSUFFICIENT_INFORMATION"


def answered(rows: DataFrame, context: Column, factory, system: str = "", open_requests: int = 1) -> DataFrame:
    """``rows`` (question and more) with answer, error, requests of an answerer who sees ``context``.

    Without a context (null) there is nothing to ask: the answer is the abstention, and no request is made.
    """
    asked = rows.withColumn("_prompt", F.when(context.isNotNull(), templates.answer_prompt(F.col("question"), context, system)))
    out = providers.with_results(asked, "_prompt", factory, "string", batch=1, open_requests=open_requests, skip_null=True)
    answer = F.when(F.col("_prompt").isNull(), ABSTAINED).otherwise(F.trim("result"))
    return out.withColumn("answer", answer).drop("_prompt", "result")


def answered_from_memories(rows: DataFrame, factory, system: str = "", open_requests: int = 1) -> DataFrame:
    """``answered`` from memories (array of id, time_span, content); none, or null, is no context."""
    return answered(rows, F.when(F.size("memories") > 0, templates.memory_block(F.col("memories"))), factory, system, open_requests)


def answered_from_sources(rows: DataFrame, factory, system: str = "", open_requests: int = 1) -> DataFrame:
    """``answered`` from sources (array of source_id, chat_time, role, content); an empty context is asked all the same."""
    return answered(rows, F.coalesce(templates.source_block(F.col("sources")), F.lit("")), factory, system, open_requests)


def judged(rows: DataFrame, factory, required: tuple[str, ...], check, attempts: int = 3, open_requests: int = 1) -> DataFrame:
    """``rows`` (prompt and more) with verdict, error and requests.

    Of a judge's text the first JSON object with the ``required`` keys counts; ``check`` makes a verdict of it, a struct with
    error.  Rows without a sound verdict are asked again, all together, up to ``attempts`` times; the last error
    stays (that of the request, object if there is none in the text, or the check's) and the verdict is null then.
    """
    left, done = rows, []
    for turn in range(1, attempts + 1):
        said = providers.with_results(left, "prompt", factory, "string", batch=1, open_requests=open_requests).withColumn("_response", jsonx.first_object(required)("result"))
        seen = said.withColumn("verdict", check(F.col("_response")))
        error = F.coalesce("error", F.when(F.col("_response").isNull(), "object").otherwise(F.col("verdict.error")))
        out = checkpointed(seen.withColumn("error", error).withColumn("requests", F.lit(turn)).drop("result", "_response"))
        sound = F.col("error").isNull()
        done.append(out.where(sound))
        if turn == attempts:
            done.append(out.where(~sound).withColumn("verdict", F.lit(None).cast(out.schema["verdict"].dataType)))
        else:
            left = out.where(~sound).select(*(f"`{c}`" for c in rows.columns))
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, done)


def label_verdicts(rows: DataFrame, factory, parametric: bool = True, attempts: int = 3, open_requests: int = 1) -> DataFrame:
    """``judged`` by labels: ``rows`` also have golden, memory and, if it counts, parametric (answers)."""
    other = F.col("parametric") if parametric else None
    names = ("gold_correctness", "memory_correctness", "value") + ("parametric_correctness",) * parametric
    return judged(rows, factory, names, lambda r: checks.label_judgement(r, F.col("golden"), F.col("memory"), other), attempts, open_requests)


def edit_verdicts(rows: DataFrame, factory, attempts: int = 3, open_requests: int = 1) -> DataFrame:
    """``judged`` by scores of an edit: ``rows`` also have after_answer and protected_answers (array)."""
    names = (*checks.JUDGE_SCORES, "retention_correctness")
    return judged(rows, factory, names, lambda r: checks.edit_judgement(r, F.col("after_answer"), F.col("protected_answers")), attempts, open_requests)
