"""Versioned memory: edits folded from a change feed, queues, links, protected questions.

Edits of a case are sequential, cases are independent.  What a prefix sum can say
(versions, pools, links) is a window; the fold of nodes is joins, in rounds that double the depth of merging they reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import store
from engram.operators.store import new_id
from engram.session import checkpointed, small_side

LISTS = ["provenance", "source_ids", "linked_questions", "tags"]


def running_version(edits: DataFrame) -> DataFrame:
    """``edits`` (case_id, seq, op) with version: edits so far that change something."""
    w = Window.partitionBy("case_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return edits.withColumn("version", F.sum(F.when(F.col("op") != "noop", 1).otherwise(0)).over(w).cast("long"))


def merged_lists(merges: DataFrame, own: DataFrame, cut=checkpointed) -> DataFrame:
    """case_id, id and LISTS of all that each of ``merges`` (case_id, id, targets) rests on, itself included, in order.

    ``own``: case_id, id and LISTS of every node by itself.  A merge is a row with the ids that it rests on in two orders: before
    its targets (``down``), as most lists have it, and after them (``up``), as questions do; ``open`` are those that are merges
    still to be looked into.  A round puts the lists of these in their places, so that a row reaches twice as deep after it, and
    keeps an id at its first place: merges of merges n deep take about log2(n) rounds.  A row with nothing open is final.
    """
    key = ["case_id", "id"]
    is_merge = merges.select("case_id", F.col("id").alias("of"))
    inner = merges.select(*key, F.explode("targets").alias("of")).join(is_merge, ["case_id", "of"]).groupBy(*key).agg(F.collect_set("of").alias("open"))
    lists = {"down": F.array_distinct(F.concat(F.array("id"), "targets")), "up": F.array_distinct(F.concat("targets", F.array("id")))}
    rows = cut(merges.join(inner, key, "left").select(*key, *(c.alias(n) for n, c in lists.items()), F.coalesce("open", F.array().cast("array<string>")).alias("open")))
    done = []
    while True:
        done.append(rows.where(F.size("open") == 0))
        going = rows.where(F.size("open") > 0)
        if going.isEmpty():
            break
        known = reduce(DataFrame.unionByName, done).unionByName(going).withColumnRenamed("id", "of")
        parts = known.join(small_side(going.select(*key, F.explode("open").alias("of"))), ["case_id", "of"]).groupBy(*key).agg(F.collect_list(F.struct("of", "down", "up", "open")).alias("parts"))
        put = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda n: F.coalesce(F.get(F.filter("parts", lambda x: x["of"] == n), 0)[c], F.array(n)))))
        opened = F.array_distinct(F.flatten(F.transform("parts", lambda x: x["open"])))
        rows = cut(going.drop("open").join(parts, key).select(*key, put("down").alias("down"), put("up").alias("up"), opened.alias("open")))
    placed = lambda c: F.array_sort(F.transform(c, lambda n, i: F.struct(n.alias("node"), i.alias("place"))))
    both = F.zip_with(placed("down"), placed("up"), lambda x, y: F.struct(x["node"].alias("node"), x["place"].alias("down"), y["place"].alias("up")))
    met = reduce(DataFrame.unionByName, done).select(*key, F.explode(both).alias("x")).select(*key, "x.*").join(own.withColumnRenamed("id", "node"), ["case_id", "node"])
    of = lambda c, place: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place, c))), lambda x: x[c])).alias(c)
    return met.groupBy(*key).agg(*(of(c, "up" if c == "linked_questions" else "down") for c in LISTS))


def fold_edits(edits: DataFrame, start: DataFrame | None = None, cut=checkpointed) -> DataFrame:
    """Memory nodes after all edits of each case: the same as ``store.apply_actions`` one by one, but all at once.

    ``edits``: case_id, seq, op, targets, content, question_id, provenance, source_ids, tags and, if there is one,
    time_span; ``start``: nodes to begin with.  Versions are a running sum; a node is archived if an edit aims at it,
    at the last such version.  Lists of merged nodes come from ``merged_lists``; no case is gathered anywhere.  Tables
    that are read again are cut by ``cut``.  A target that doesn't exist by then is an error.
    """
    if "time_span" not in edits.columns:
        edits = edits.withColumn("time_span", F.lit(None).cast("struct<start:string,end:string>"))
    before = start.groupBy("case_id").agg(F.max("updated_version").alias("_v0")) if start is not None else None
    real = running_version(edits).where("op <> 'noop'")
    real = cut(real if before is None else real.join(before, "case_id", "left").withColumn("version", F.col("version") + F.coalesce("_v0", F.lit(0))).drop("_v0"))
    adds = real.where("op in ('add', 'merge')").withColumn("id", new_id(F.col("case_id"), F.col("version"), F.col("content")))
    aimed = real.select("case_id", "version", "op", F.posexplode("targets").alias("pos", "id"))
    known = adds.select("case_id", "id", F.col("version").alias("since"))
    if start is not None:
        known = known.unionByName(start.select("case_id", "id", F.lit(0).cast("long").alias("since")))
    store._refuse(aimed.join(known, ["case_id", "id"], "left").where("since is null or since >= version").select("case_id", "version", "id"), "edits aim at memory nodes that don't exist")
    merges = adds.where(F.size(F.coalesce("targets", F.array().cast("array<string>"))) > 0).select("case_id", "id", "targets")
    nothing = aimed.limit(0).select("*", *(F.array().cast("array<string>").alias(c) for c in LISTS))
    done = store.made_nodes(adds, nothing)
    done = cut(done if start is None else done.unionByName(start))
    held = merged_lists(merges, done.select("case_id", "id", *LISTS), cut).withColumnsRenamed({c: f"_{c}" for c in LISTS})
    done = done.join(held, ["case_id", "id"], "left").withColumns({c: F.coalesce(F.array_distinct(f"_{c}"), c) for c in LISTS})
    archived = aimed.where("op in ('merge', 'delete')").groupBy("case_id", "id").agg(F.max("version").alias("_at"))
    gone = F.col("_at").isNotNull()
    out = done.join(archived, ["case_id", "id"], "left").withColumn("status", F.when(gone, "archived").otherwise(F.col("status")))
    return out.withColumn("updated_version", F.coalesce("_at", "updated_version")).select(*store.COLUMNS)


def active_tokens(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("case_id").agg(F.coalesce(F.sum(F.when(F.col("status") == "active", F.col("token_count"))), F.lit(0)).cast("long").alias("active_tokens"))


def size_change(before: Column, after: Column, evidence_tokens: Column) -> tuple[Column, Column]:
    """(growth, shrink), each from 0 to 1."""
    part = lambda up, base: F.least(F.lit(1.0), F.greatest(F.lit(0), up) / F.greatest(F.lit(1), base))
    return part(after - before, evidence_tokens), part(before - after, before)


def time_hull(times: Column) -> Column:
    """(start, end) of time texts by text order; null if there are none."""
    real = F.filter(times, lambda t: t.isNotNull())
    return F.when(F.size(real) > 0, F.struct(F.array_min(real).alias("start"), F.array_max(real).alias("end")))


def latest(events: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last event of each key (upsert), with first_seq: its place from when the key first came."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last"), F.min(order).alias("first_seq")).select(*key, "last.*", "first_seq")


def pool_membership(events: DataFrame) -> DataFrame:
    """case_id, question_id, pool, entered: the queue each question is in and since when without a break.

    ``events``: case_id, question_id, seq, pool.
    """
    w = Window.partitionBy("case_id", "question_id").orderBy("seq")
    moved = F.coalesce((F.col("pool") != F.lag("pool").over(w)).cast("int"), F.lit(1))
    islands = events.withColumn("island", F.sum(moved).over(w))
    stays = islands.groupBy("case_id", "question_id", "island").agg(F.first("pool").alias("pool"), F.min("seq").alias("entered"))
    last = F.max("island").over(Window.partitionBy("case_id", "question_id"))
    return stays.withColumn("last", last).where("island = last").select("case_id", "question_id", "pool", "entered")


def question_links(binds: DataFrame) -> DataFrame:
    """case_id, node_id, linked_questions: a question links only the nodes of its last binding.

    ``binds``: case_id, question_id, seq, node_ids.
    """
    now = latest(binds, ["case_id", "question_id"]).select("case_id", "question_id", "seq", F.explode("node_ids").alias("node_id"))
    return now.groupBy("case_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "question_id"))), lambda x: x["question_id"]).alias("linked_questions"))


def protected_questions(capabilities: DataFrame, retrieved: DataFrame, most: int = 3) -> DataFrame:
    """case_id, question_id, rank: passed questions linked to a retrieved node, or any passed one where none is; newest first.

    ``capabilities``: case_id, question_id, seq, passed, node_ids; ``retrieved``: case_id, node_id.
    """
    passed = capabilities.where("passed").select("case_id", "question_id", "seq", "node_ids")
    met = passed.select("case_id", "question_id", F.explode("node_ids").alias("node_id")).join(retrieved, ["case_id", "node_id"], "left_semi").select("case_id", "question_id", F.lit(1).alias("linked")).distinct()
    each = passed.join(met, ["case_id", "question_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    any_linked = F.max("linked").over(Window.partitionBy("case_id"))
    chosen = each.withColumn("any_linked", any_linked).where("linked = any_linked")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("seq").desc()))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= most).select("case_id", "question_id", "rank")


def support(hits: DataFrame, ask, least: float = 0.8) -> DataFrame:
    """question_id, rank, node_id: those of ``hits`` that the answer needs, by backward elimination.

    From the last rank up a node goes if the question is still answered without it; the last node never does.  All questions
    take the step together: ``ask(trials)`` gets question_id and node_ids of every trial of a rank at once and gives question_id
    and correctness.  A node goes at ``least`` or more; one whose trial has no valid judgement (null, or no row) stays.
    There are as many rounds as the longest list of hits.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda h: h["node_id"])
    found = needed(hits.groupBy("question_id").agg(order.alias("node_ids")), ask, least)
    return hits.select("question_id", "rank", "node_id").join(found.select("question_id", F.explode("support").alias("node_id")), ["question_id", "node_id"], "left_semi").select("question_id", "rank", "node_id")


def needed(rows: DataFrame, ask, least: float = 0.8) -> DataFrame:
    """``rows`` (question_id, node_ids in rank order and more) with support in place of node_ids, as in the function above.

    A row is written as long as it has a node to try, with the nodes it still has and how many of them are untried; ``ask``
    gets its other columns too.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    state = rows.withColumn("support", F.array_distinct("node_ids")).drop("node_ids").withColumn("untried", size("support"))
    trying, done = (F.col("untried") > 0) & (size("support") > 1), []
    while True:
        state = checkpointed(state)
        done.append(state.where(~trying).drop("untried"))
        going = state.where(trying)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        node = F.element_at("support", F.col("untried"))
        rest = F.filter("support", lambda n: n != node)
        marks = ask(going.withColumn("node_ids", rest).drop("support", "untried")).select("question_id", F.col("correctness").alias("_mark"))
        gone = F.coalesce(F.col("_mark") >= least, F.lit(False))
        state = going.join(marks, "question_id", "left").withColumn("support", F.when(gone, rest).otherwise(F.col("support"))).withColumn("untried", F.col("untried") - 1).drop("_mark")
