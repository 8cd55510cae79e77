"""One round of question and memory work as tables: observations, outcomes, ledgers, and the loop over rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text
from engram.operators import datasets, memory
from engram.session import checkpointed
from engram.sources import graphs


def target_context(mode: Column, evidence: Column, dimension: Column) -> Column:
    """What a question writer sees of a route: evidence memories, and the dimension of a comparison only."""
    return F.struct(F.transform(evidence, lambda n: n["memory"]).alias("target"), F.when(mode == "comparison", dimension).alias("dimension"))


def observation_query(evidence: Column) -> Column:
    """The text to retrieve a route's memory neighbourhood by."""
    return F.array_join(F.transform(evidence, lambda n: n["memory"]), "\n")


def indexed_neighbourhood(nodes: Column) -> Column:
    """Neighbours as an edit writer addresses them: by place."""
    return F.transform(nodes, lambda n, i: F.struct(i.alias("index"), n["content"].alias("content")))


def defended(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """``rows`` (question_id, correctness, error) with outcome: success, pending (to be edited for) or unavailable."""
    c = F.col("correctness")
    return rows.withColumn("outcome", F.when(F.col("error").isNotNull() | c.isNull(), "unavailable").when(c >= least, "success").otherwise("pending"))


def committed(rows: DataFrame) -> DataFrame:
    """``rows`` (question_id, commit_valid, score, n_retrieved) with outcome and pool.

    An edit is kept if it is valid and scores above zero; a question whose answer then retrieves nothing still waits.
    """
    keep = F.coalesce(F.col("commit_valid") & (F.col("score") > 0), F.lit(False))
    outcome = F.when(~keep, "discarded").when(F.col("n_retrieved") > 0, "committed").otherwise("unsupported")
    return rows.withColumn("outcome", outcome).withColumn("pool", F.when(F.col("outcome") == "committed", "success").otherwise("high_priority"))


def round_counters(rows: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Outcomes of a round: counts by case; with ``edits`` (of ``committed``, and case_id) also committed and discarded ones."""
    out = rows.groupBy("case_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "pending", "unavailable")))
    if edits is None:
        return out
    done = edits.groupBy("case_id").agg(F.count_if(F.col("outcome") == "committed").alias("committed"), F.count_if(F.col("outcome") != "committed").alias("discarded"))
    return out.join(done, "case_id", "left").fillna(0, ["committed", "discarded"])


def attributed(rows: DataFrame, ask, least: float = 0.8) -> DataFrame:
    """``rows`` (question_id, node_ids in rank order and more) with support: the nodes that the answer needs, in that order.

    ``ask(trials)`` judges question_id, question and node_ids as ``evaluated``'s judge does.
    """
    found = memory.needed(rows.withColumn("_all", F.col("node_ids")), lambda trials: ask(trials.select("question_id", "question", "node_ids")), least)
    return found.select(*(F.col("_all").alias(c) if c == "node_ids" else F.col(c) for c in rows.columns), "support")


def evaluated(questions: DataFrame, retrieve, judge, least: float = 0.8) -> DataFrame:
    """``questions`` (question_id, question) with node_ids (in rank order), correctness, error, outcome and support.

    ``retrieve(questions)`` gives question_id, id, rank; ``judge(rows)`` gives question_id, correctness, error from
    question_id, question and node_ids.  A question that retrieves nothing isn't shown to the judge: its correctness is 0.
    Of a success, support has the nodes that it needs (``memory.support`` by the same judge); others have none.
    """
    hits = retrieve(questions).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"]).alias("node_ids"))
    both = checkpointed(questions.join(hits, "question_id", "left"))
    marks = judge(both.where("node_ids is not null").select("question_id", "question", "node_ids")).select("question_id", F.col("correctness").alias("_c"), F.col("error").alias("error"))
    out = both.join(marks, "question_id", "left").withColumn("correctness", F.when(F.col("node_ids").isNull(), 0.0).otherwise(F.col("_c"))).drop("_c")
    out = checkpointed(defended(out, least))
    needed = attributed(out.where("outcome = 'success'"), judge, least).select("question_id", "support")
    return out.join(needed, "question_id", "left")


def commit_round(nodes: DataFrame, pending: DataFrame, actions: DataFrame, retrieve, judge=None, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(nodes after the round's edits, outcomes) of one edit a case.

    ``pending``: case_id, question_id, question, commit_valid, score; ``actions``: as for ``store.apply_actions``;
    ``retrieve(pending, nodes)`` gives case_id, question_id, id, rank over the nodes as they would be.  Edits that are valid and score
    above 0 are tried; if the question then retrieves a memory the edit stays and its question is bound to what it needs of
    it, else the case's nodes stay as they were and the question waits.  ``judge(rows, nodes)`` gives question_id and
    correctness of question_id, question, node_ids, by which that is found; without one the question is bound to all.
    Here a question_id of the judge is the struct of case_id and question_id.
    """
    from engram.operators import store

    good = pending.where(F.col("commit_valid") & (F.col("score") > 0))
    tried = checkpointed(store.apply_actions(nodes, actions.join(good.select("case_id", "question_id"), ["case_id", "question_id"], "left_semi")))
    hits = checkpointed(retrieve(good, tried).groupBy("case_id", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"]).alias("node_ids")))
    if judge is not None:
        one = hits.join(pending.select("case_id", "question_id", "question"), ["case_id", "question_id"]).select(F.struct("case_id", "question_id").alias("question_id"), "question", "node_ids")
        found = attributed(one, lambda trials: judge(trials, tried), least)
        hits = found.select("question_id.case_id", "question_id.question_id", "node_ids", "support")
    else:
        hits = hits.withColumn("support", F.col("node_ids"))
    outcomes = checkpointed(committed(pending.join(hits, ["case_id", "question_id"], "left").withColumn("n_retrieved", F.coalesce(F.size("node_ids"), F.lit(0)))))
    kept = outcomes.where("outcome = 'committed'")
    after = tried.join(kept.select("case_id"), "case_id", "left_semi").unionByName(nodes.join(kept.select("case_id"), "case_id", "left_anti"))
    binds = outcomes.select("case_id", "question_id", F.lit(0).alias("seq"), F.when(F.col("outcome") == "committed", F.col("support")).otherwise(F.array().cast("array<string>")).alias("node_ids"))
    return store.bind_questions(after, binds), outcomes


def frozen_contexts(routes: DataFrame, nodes: DataFrame, ledger: DataFrame, versions: DataFrame) -> DataFrame:
    """``routes`` (case_id, route and more) with what a reward may look at later: memory_version, memory_nodes and
    prior_questions (question, answer in ledger order), as they are now."""
    held = nodes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in nodes.columns if c not in ("case_id", "id"))))).alias("memory_nodes"))
    prior = ledger.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question", "answer"))), lambda x: x.dropFields("place")).alias("prior_questions"))
    return routes.join(versions, "case_id", "left").join(held, "case_id", "left").join(prior, "case_id", "left")


def thawed_nodes(contexts: DataFrame) -> DataFrame:
    """case_id, route and the memory nodes that ``frozen_contexts`` holds, a row each."""
    return contexts.select("case_id", "route", F.inline("memory_nodes"))


def guarded(routes: DataFrame) -> DataFrame:
    """``routes`` without the records' questions and answers, which must not reach the question writer."""
    return routes.drop("question", "answer")


def question_id(route: Column, question: Column) -> Column:
    return text.short_hash(route, question, sep="\n")


def capability_rows(candidates: DataFrame) -> DataFrame:
    """Ledger rows of ``candidates`` (route, mode, question, answer, source_ids, version)."""
    return candidates.select(question_id(F.col("route"), F.col("question")).alias("question_id"), "question", F.col("route").alias("route_id"), F.col("mode").alias("attack_mode"), F.col("answer").alias("oracle_answer"), F.col("source_ids").alias("oracle_source_ids"), F.lit(False).alias("passed"), F.col("version").alias("verified_version"))


def evidence_rows(candidates: DataFrame) -> DataFrame:
    """question_id, source_id, place: one row for each source a candidate's answer rests on."""
    return candidates.select(question_id(F.col("route"), F.col("question")).alias("question_id"), F.posexplode("source_ids").alias("place", "source_id"))


def protected_rows(capability: DataFrame) -> DataFrame:
    """question_id, question, canonical_answer: what an edit writer sees of ledger rows (of ``capability_rows``)."""
    return capability.select("question_id", "question", F.col("oracle_answer").alias("canonical_answer"))


def replayed(high_priority: DataFrame, success: DataFrame, archive: DataFrame, most: int = 4) -> DataFrame:
    """case_id, question_id, place: waiting questions, then the oldest answered ones, that the archive has."""
    known = lambda df: df.join(archive.select("case_id", "question_id"), ["case_id", "question_id"], "left_semi")
    both = datasets.priority_first(known(high_priority).withColumnRenamed("question_id", "item"), known(success).withColumnRenamed("question_id", "item"), most)
    return both.withColumnRenamed("item", "question_id")


def kept_questions(linked: DataFrame, pool: DataFrame, archive: DataFrame, most: int = 4) -> DataFrame:
    """case_id, question_id, place: questions that an edit must not break.  ``linked`` (case_id, question_id, seq) to its
    targets come first, then the ``most`` first of the success ``pool``, each once; those the archive lacks are left out."""
    early = pool.withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))).where(F.col("_k") <= most)
    part = lambda df, p: df.select("case_id", "question_id", F.struct(F.lit(p).alias("p"), F.col("seq").cast("long").alias("seq")).alias("turn"))
    both = part(linked, 0).unionByName(part(early, 1)).groupBy("case_id", "question_id").agg(F.min("turn").alias("turn"))
    known = both.join(archive.select("case_id", "question_id"), ["case_id", "question_id"], "left_semi")
    return known.select("case_id", "question_id", F.row_number().over(Window.partitionBy("case_id").orderBy("turn", "question_id")).alias("place"))


def run_rounds(spark: SparkSession, folder: str, state: dict[str, DataFrame], step: Callable[[dict[str, DataFrame], int], dict[str, DataFrame]], rounds: int) -> dict[str, DataFrame]:
    """Apply ``step`` to the state tables round by round, each from the checkpoint of the one before.

    It goes on from the last whole checkpoint, and ends when the table ``cases``, if there is one, has no active case.
    """
    found = graphs.read_checkpoint(spark, folder)
    state = found or state
    done = 0 if not found else spark.read.schema("version int").json(f"{folder}/pointers").agg(F.max("version")).first()[0]
    for number in range(done + 1, done + rounds + 1):
        if "cases" in state and state["cases"].where("not stopped").isEmpty():
            break
        graphs.write_checkpoint(step(state, number), folder, number)
        state = graphs.read_checkpoint(spark, folder)
    return state
