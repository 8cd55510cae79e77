"""The memory store as tables: what one action of each case does to its nodes, ledgers and links.

Nodes: the columns of ``NODE``.  Every operator takes tables and returns new ones, so a
trial on a copy needs no copying.  All cases go at once, keyed by case_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text

#: Schema of a memory node.
NODE = "case_id long, id string, content string, status string, provenance array<string>, source_ids array<string>, linked_questions array<string>, tags array<string>, time_span struct<start:string,end:string>, token_count int, created_version long, updated_version long"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _none() -> Column:
    return F.array().cast("array<string>")


def new_id(case: Column, version: Column, content: Column) -> Column:
    """A memory's id, the same whenever the work is done again."""
    return text.short_hash(case.cast("string"), version.cast("string"), content)


def _refuse(rows: DataFrame, what: str) -> None:
    bad = rows.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new`` ones (the same columns, created_version given), active; an id that is there already is an error."""
    _refuse(new.select("case_id", "id").intersect(nodes.select("case_id", "id")), "memory nodes exist")
    return nodes.unionByName(new.withColumn("status", F.lit("active")).withColumn("updated_version", F.col("created_version")))


def archive_nodes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``nodes`` with ``targets`` (case_id, id, version) archived; a target that isn't there is an error."""
    _refuse(targets.select("case_id", "id").exceptAll(nodes.join(targets.select("case_id", "id"), ["case_id", "id"], "left_semi").select("case_id", "id")), "no such memory nodes")
    last = targets.groupBy("case_id", "id").agg(F.max("version").alias("_at"))
    both = nodes.join(last, ["case_id", "id"], "left")
    gone = F.col("_at").isNotNull()
    return both.withColumn("status", F.when(gone, "archived").otherwise(F.col("status"))).withColumn("updated_version", F.coalesce("_at", "updated_version")).select(*COLUMNS)


def joined_lists(own: Column, targets: Column, targets_first: bool = False) -> Column:
    """The lists of an edit and its targets as one, each item at its first place."""
    rest = F.flatten(targets)
    return F.array_distinct(F.concat(rest, own) if targets_first else F.concat(own, rest))


def made_nodes(edits: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes that ``edits`` (case_id, version, content, question_id, provenance, source_ids, tags, time_span) make.

    ``targets``: case_id, version, pos and the lists of a target.  A new node has the edit's lists, then its targets',
    questions the other way round, and the edit's own time span alone.
    """
    lists = ["provenance", "source_ids", "linked_questions", "tags"]
    listed = lambda c: F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, _none()).alias("l")))).alias(f"_{c}")
    held = targets.groupBy("case_id", "version").agg(*map(listed, lists))  # each by itself: lists that aren't asked for are not moved
    both = edits.join(held, ["case_id", "version"], "left")
    of = lambda name: F.coalesce(F.transform(f"_{name}", lambda t: t["l"]), F.array().cast("array<array<string>>"))
    own = lambda name: F.coalesce(name, _none())
    question = F.when(F.coalesce("question_id", F.lit("")) != "", F.array("question_id")).otherwise(_none())
    return both.select(
        "case_id", new_id(F.col("case_id"), F.col("version"), F.col("content")).alias("id"), "content", F.lit("active").alias("status"),
        joined_lists(own("provenance"), of("provenance")).alias("provenance"), joined_lists(own("source_ids"), of("source_ids")).alias("source_ids"),
        joined_lists(question, of("linked_questions"), targets_first=True).alias("linked_questions"), joined_lists(own("tags"), of("tags")).alias("tags"),
        "time_span", text.token_count(F.col("content")).alias("token_count"), F.col("version").alias("created_version"), F.col("version").alias("updated_version"),
    )


def apply_actions(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Nodes after one action of each case.

    ``actions``: case_id, version (the one it makes), op, targets, content, question_id, provenance, source_ids, tags,
    time_span.  MERGE and DELETE archive their targets, ADD and MERGE make a node, NOOP does nothing.  Whether targets are
    active is the caller's business; one that doesn't exist is an error.
    """
    real = actions.where("op <> 'noop'")
    aimed = real.select("case_id", "version", "op", F.posexplode("targets").alias("pos", "id"))
    made = made_nodes(real.where("op in ('add', 'merge')"), aimed.join(nodes.select("case_id", "id", "provenance", "source_ids", "linked_questions", "tags"), ["case_id", "id"]))
    return archive_nodes(nodes, aimed.where("op in ('merge', 'delete')").select("case_id", "id", "version")).unionByName(made)


def bare(actions: DataFrame) -> DataFrame:
    """``actions`` (case_id, version, op, targets, content, tags) without a question, provenance or time span of their own."""
    return actions.select("case_id", "version", "op", "targets", "content", F.lit(None).cast("string").alias("question_id"), _none().alias("provenance"), _none().alias("source_ids"), "tags", F.lit(None).cast("struct<start:string,end:string>").alias("time_span"))


def compact(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """``apply_actions`` of ``bare`` actions."""
    return apply_actions(nodes, bare(actions))


def bind_questions(nodes: DataFrame, binds: DataFrame) -> DataFrame:
    """``nodes``, archived ones too, with links as the last of ``binds`` (case_id, question_id, seq, node_ids) has them.

    A question goes from every node that isn't its support, and is added to those that are and lack it; other links and
    versions stay as they are.
    """
    last = binds.groupBy("case_id", "question_id").agg(F.max_by(F.struct("node_ids", "seq"), "seq").alias("b")).select("case_id", "question_id", "b.seq", "b.node_ids")
    support = last.select("case_id", "question_id", "seq", F.explode("node_ids").alias("id")).distinct()
    links = nodes.select("case_id", "id", F.posexplode("linked_questions").alias("pos", "question_id"))
    # a support is at hand where its question's links are met, so links move once by question and once by node
    known = last.select("case_id", "question_id", "node_ids", F.lit(True).alias("_bound"))
    kept = links.join(known, ["case_id", "question_id"], "left").where("_bound is null or coalesce(array_contains(node_ids, id), false)")
    kept = kept.select("case_id", "id", "question_id", F.lit(0).alias("new"), F.col("pos").cast("long").alias("place"))
    both = kept.unionByName(support.select("case_id", "id", "question_id", F.lit(1).alias("new"), F.col("seq").cast("long").alias("place")))
    lists = both.groupBy("case_id", "id").agg(F.array_sort(F.collect_list(F.struct("new", "place", "question_id"))).alias("_l"))
    part = lambda new: F.transform(F.filter("_l", lambda x: x["new"] == new), lambda x: x["question_id"])
    lists = lists.select("case_id", "id", F.concat(part(0), F.array_except(part(1), part(0))).alias("_links"))
    return nodes.join(lists, ["case_id", "id"], "left").withColumn("linked_questions", F.coalesce("_links", _none())).select(*COLUMNS)


def capability_ledger(events: DataFrame) -> DataFrame:
    """The ledger after successes and failures: each question's last event, at the place where it first came.

    ``events``: case_id, question_id, seq, passed, node_ids, version.  A success without a supporting node is an error;
    a failure keeps neither support nor a verified version of its own.
    """
    _refuse(events.where("passed and size(coalesce(node_ids, array())) = 0").select("case_id", "question_id", "seq"), "successes without support")
    last = events.groupBy("case_id", "question_id").agg(F.max_by(F.struct("passed", "node_ids", "version"), "seq").alias("e"), F.min("seq").alias("place"))
    return last.select("case_id", "question_id", "place", "e.passed", F.when(F.col("e.passed"), F.col("e.node_ids")).otherwise(_none()).alias("supporting_node_ids"), F.when(F.col("e.passed"), F.col("e.version")).alias("verified_version"))


def advance_iteration(cases: DataFrame) -> DataFrame:
    return cases.withColumn("iteration", F.col("iteration") + 1)
