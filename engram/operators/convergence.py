"""When to stop: streaks, saturation, compaction candidates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaks(rounds: DataFrame, patience: int = 2) -> DataFrame:
    """``rounds`` (case_id, round, saturated) with streak, and stopped once it reaches ``patience``."""
    w = Window.partitionBy("case_id").orderBy("round")
    island = F.sum(F.when(F.col("saturated"), 0).otherwise(1)).over(w)
    streak = F.sum(F.when(F.col("saturated"), 1).otherwise(0)).over(Window.partitionBy("case_id", "_island").orderBy("round"))
    return rounds.withColumn("_island", island).withColumn("streak", streak.cast("long")).drop("_island").withColumn("stopped", F.col("streak") >= patience)


def active_cases(cases: DataFrame, stopped: DataFrame) -> DataFrame:
    return cases.join(stopped.where("stopped").select("case_id").distinct(), "case_id", "left_anti")


def saturation(fresh: DataFrame, waiting: DataFrame, cases: DataFrame | None = None, least: int = 4) -> DataFrame:
    """case_id, saturated: enough fresh questions, all judged, none open, nothing waiting.

    ``fresh``: case_id, available, resolved; ``waiting``: case_id of questions in the high-priority queue.  With ``cases``
    (case_id, active_nodes) every case has a row, one without fresh questions too, and builder_saturated says whether the
    builder has nothing to compact: the questions are saturated and no node is active.
    """
    counted = fresh.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_and("available").alias("judged"), F.count_if(~F.col("resolved")).alias("open"))
    queued = waiting.groupBy("case_id").agg(F.count("*").alias("queued"))
    both = (counted if cases is None else cases.join(counted, "case_id", "left")).join(queued, "case_id", "left")
    saturated = F.coalesce((F.col("n") >= least) & F.col("judged") & (F.col("open") == 0) & F.col("queued").isNull(), F.lit(False))
    out = both.withColumn("saturated", saturated)
    return out.select("case_id", "saturated") if cases is None else out.select("case_id", "saturated", (F.col("saturated") & (F.col("active_nodes") == 0)).alias("builder_saturated"))


def compaction_candidates(nodes: DataFrame, most: int = 8) -> DataFrame:
    """case_id, place, ids: pairs of a case's active nodes that share a tag, then other pairs, then single nodes; ``most`` in all.

    ``nodes``: case_id, pos, id, tags.  Pairs come in order of both places, so the first ``most`` of either kind
    have a first place among the first few or share a tag; only such rows are joined.
    """
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))
    placed = nodes.withColumn("r", rank)
    tags = placed.select("case_id", "r", "id", F.explode(F.array_distinct("tags")).alias("tag"))
    # a first node's partners by tag: the next `most` holders of each tag are enough
    turn = F.row_number().over(Window.partitionBy("case_id", "tag").orderBy("r"))
    held = tags.withColumn("t", turn)
    x, y = held.alias("x"), held.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("t0", F.col("t") - F.col("step")).alias("y")
    tagged = x.join(y, (F.col("x.case_id") == F.col("y.case_id")) & (F.col("x.tag") == F.col("y.tag")) & (F.col("x.t") == F.col("y.t0"))).select(F.col("x.case_id").alias("case_id"), F.col("x.r").alias("ra"), F.col("y.r").alias("rb"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0).alias("kind")).distinct()
    # untagged pairs: the first nodes with any later one, enough for `most` even if some share tags
    head = placed.where(F.col("r") <= 2 * most + 1).select("case_id", "r", "id", "tags")
    p, q = head.alias("p"), head.alias("q")
    plain = p.join(q, (F.col("p.case_id") == F.col("q.case_id")) & (F.col("p.r") < F.col("q.r"))).where(~F.coalesce(F.arrays_overlap("p.tags", "q.tags"), F.lit(False))).select(F.col("p.case_id").alias("case_id"), F.col("p.r").alias("ra"), F.col("q.r").alias("rb"), F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.lit(1).alias("kind"))
    pairs = tagged.unionByName(plain).select("case_id", "kind", "ra", "rb", F.array("a", "b").alias("ids"))
    singles = head.select("case_id", F.lit(2).alias("kind"), F.col("r").alias("ra"), F.lit(0).alias("rb"), F.array("id").alias("ids"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("kind", "ra", "rb"))
    return pairs.unionByName(singles).withColumn("place", place).where(F.col("place") <= most).select("case_id", "place", "ids")


def first_compaction(candidates: DataFrame, drop: float = 0.05, least: float = 0.8) -> DataFrame:
    """The first candidate of each case that shrinks memory and keeps its protected questions.

    ``candidates``: case_id, place, valid, tokens_before, tokens_after, protected (array of before, after).
    """
    kept = F.forall("protected", lambda x: (x["after"] >= least) & (x["before"] - x["after"] <= drop))
    passing = candidates.where(F.col("valid") & (F.col("tokens_after") < F.col("tokens_before")) & kept)
    return passing.groupBy("case_id").agg(F.min("place").alias("place"))
