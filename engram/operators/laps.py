"""Routes drawn in laps: each lap draws at most one route of every mode for every case, from what the laps before left.

State is the routes drawn so far: a node's visits weigh it down (1 / (1 + visits)), a signature is never drawn twice, and a
mode without an unseen route gives none.  A case ends with its last wanted route or with a lap that added nothing.  All cases
go at once.  Modes follow one another within a lap, since each sees the visits of the one before; a lap's draws are written
before the next lap reads them.

Facts and temporal pairs are candidates one by one.  Pairs to compare are never formed: facts of a topic and dimension are
counted by their visits, a pair of such counts is drawn by its number of pairs times their weight, and the drawn place in it
is turned into two facts by their ranks.  Topics are drawn evenly, their facts by weight.  These two kinds may come
out as seen routes, and are then drawn again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text
from engram.operators import datasets, graph
from engram.session import checkpointed, tabled

#: Draws at a time of a route that may be a seen one, and how often their number doubles before a lap goes without.
ATTEMPTS, TRIES = 8, 7
#: Rows of state (routes, their nodes) up to which it is broadcast, so that candidates stay where they are.
NEAR_ROWS = 1 << 17
ROUTE = "case_id long, lap int, mode string, dimension string, walk array<string>, evidence array<string>, signature string"


class Candidates(NamedTuple):
    single: DataFrame  # case_id, dimension, walk, evidence, signature
    temporal: DataFrame
    topics: DataFrame  # case_id, topic, n_facts, facts
    members: DataFrame  # case_id, topic, dimension, fact
    totals: DataFrame  # case_id, mode, total: different routes of a mode
    places: DataFrame | None = None  # case_id, topic, place (from 0)
    counts: DataFrame | None = None  # case_id, topic, dimension, n: of members, where they make pairs


def _same(df: DataFrame) -> DataFrame:
    return df


def _signed(rows: DataFrame, mode: str) -> DataFrame:
    return rows.withColumn("signature", graph.walk_signature(F.col("case_id").cast("string"), F.lit(mode), F.col("dimension"), F.col("walk")))


def compared_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """case_id, topic, dimension, fact of active facts under a topic."""
    dims = text.comparison_dimensions(text.node_text(F.col("key"), F.col("memory"), F.col("tags")))
    facts = nodes.where("type = 'fact' and status = 'activated'").select("case_id", F.col("id").alias("fact"), F.explode(dims).alias("dimension"))
    return graph.active_topic_facts(edges, nodes).join(facts, ["case_id", "fact"]).select("case_id", "topic", "dimension", "fact")


def pair_classes(members: DataFrame, visits: DataFrame) -> DataFrame:
    """case_id, topic, dimension, low, high, n_low, n_high, pairs: how many pairs have facts of so many visits.

    ``members``: of ``compared_facts``; ``visits``: case_id, node_id, visits.  Rows grow with the different visit counts
    of a topic and dimension, not with its facts.
    """
    counted = members.join(visits.withColumnRenamed("node_id", "fact"), ["case_id", "fact"], "left").groupBy("case_id", "topic", "dimension", F.coalesce("visits", F.lit(0)).cast("long").alias("v")).agg(F.count("*").alias("n"))
    side = lambda name: counted.withColumnsRenamed({"v": name, "n": f"n_{name}"})
    both = side("low").join(side("high"), ["case_id", "topic", "dimension"]).where("low <= high")
    pairs = F.when(F.col("low") == F.col("high"), F.expr("n_low * (n_low - 1) div 2")).otherwise(F.col("n_low") * F.col("n_high"))
    return both.withColumn("pairs", pairs).where("pairs > 0")


def unranked(place: Column, n_low: Column, n_high: Column, same: Column) -> tuple[Column, Column]:
    """The ranks (from 0) of the ``place``-th pair: of two different ones of n_low, or of one of n_low and one of n_high."""
    root = F.floor((F.sqrt(8.0 * place + 1) + 1) / 2).cast("long")  # pairs (a, b), a < b, in order of b: b (b - 1) / 2 come before b
    before = lambda b: F.shiftright(b * (b - 1), 1)
    b = F.when(before(root) > place, root - 1).when(before(root + 1) <= place, root + 1).otherwise(root)
    rest = F.pmod(place, n_high)
    return F.when(same, place - before(b)).otherwise(((place - rest) / n_high).cast("long")), F.when(same, b).otherwise(rest)


def candidates(edges: DataFrame, nodes: DataFrame, least: int = 2, most: int = 3) -> Candidates:
    """Facts and their texts are read once, and topics hold their facts: all else is taken from these two tables."""
    none = F.lit(None).cast("string")
    single = _signed(graph.read_facts(nodes).withColumns({"dimension": none, "walk": F.array("id")}), "single_fact")
    facts = tabled(single.withColumn("signature", F.when(F.col("active"), F.col("signature"))).drop("dimension", "walk"))
    single = facts.where("active").select("case_id", none.alias("dimension"), F.array("id").alias("walk"), F.array("id").alias("evidence"), "signature")
    pairs = graph.changes(edges, facts).distinct().select("case_id", "dimension", F.array("source", "target").alias("walk"))
    temporal = tabled(_signed(pairs.withColumn("evidence", F.col("walk")), "temporal_evolution"))
    filled = tabled(graph.filled_topics(edges, nodes, facts).withColumn("n_facts", F.size("facts").cast("long")).where("n_facts > 1"))
    topics = filled.where(F.col("n_facts") >= max(2, least)).select("case_id", "topic", "n_facts", F.col("facts.fact").alias("facts"))
    places = tabled(topics.select("case_id", "topic", (F.row_number().over(Window.partitionBy("case_id").orderBy("topic")) - 1).alias("place")))
    members = filled.select("case_id", "topic", F.inline("facts")).select("case_id", "topic", F.explode("dimensions").alias("dimension"), "fact")
    counts = tabled(members.groupBy("case_id", "topic", "dimension").agg(F.count("*").alias("n")).where("n > 1"))
    n = F.col("n_facts").cast("double")
    ways = sum((F.when(n >= k, F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - i))).otherwise(0.0) for k in range(max(2, least), most + 1)), F.lit(0.0))
    two = counts.select("case_id", F.lit("comparison").alias("mode"), F.expr("double(n * (n - 1) div 2)").alias("total"))
    each = lambda df, mode: df.select("case_id", F.lit(mode).alias("mode"), F.lit(1.0).alias("total"))
    every = each(single, "single_fact").unionByName(each(temporal, "temporal_evolution")).unionByName(topics.select("case_id", F.lit("same_topic").alias("mode"), ways.alias("total"))).unionByName(two)
    totals = checkpointed(every.groupBy("case_id", "mode").agg(F.sum("total").alias("total")).where("total > 0"))
    return Candidates(single, temporal, topics, members, totals, places, counts)


def _least(rows: DataFrame, by: list[str], ties: list[str], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The row of least ``k`` of each group, and of least ``ties`` where keys are equal: numbers are compared before any
    row is held, which takes no sort."""
    least = rows.groupBy(*by).agg(F.min("k").alias("least"))
    few = rows.join(near(least), by).where("k = least")
    return few.groupBy(*by).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in [*by, "k"])), F.struct(*ties)).alias("r")).select(*by, "r.*")


def _listed(cands: DataFrame, cases: DataFrame, past: DataFrame, visits: DataFrame, seed: int, near: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """One candidate of each case by weight; ``near`` marks what is small."""
    left = cands.join(near(cases), "case_id", "left_semi").join(near(past), ["case_id", "signature"], "left_anti")
    met = cands.select("case_id", "signature", F.explode("evidence").alias("node_id")).join(near(visits), ["case_id", "node_id"]).groupBy("case_id", "signature").agg(F.sum("visits").alias("visits"))
    key = datasets.weighted_order(seed, datasets.visit_weight(F.col("visits")), "case_id", "signature")
    keyed = left.join(near(met), ["case_id", "signature"], "left").withColumn("k", key).drop("visits")
    return _least(keyed, ["case_id"], ["signature"], near).select(*cands.columns)


def _topic_draws(cands: Candidates, tries: DataFrame, visits: DataFrame, seed: int, least: int, most: int, near: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """case_id, attempt, dimension, walk, evidence: facts of a topic drawn evenly."""
    sizes = cands.places.groupBy("case_id").agg((F.max("place") + 1).alias("n_topics"))
    place = F.floor(datasets.uniform(seed, "case_id", "attempt") * F.col("n_topics")).cast("int")
    at = tries.join(near(sizes), "case_id").select("case_id", "attempt", place.alias("place"))
    named = cands.places.join(near(at), ["case_id", "place"]).select("case_id", "attempt", "topic")
    chosen = cands.topics.join(near(named), ["case_id", "topic"])
    facts = chosen.select("case_id", "attempt", "topic", "n_facts", F.explode("facts").alias("fact")).join(near(visits.withColumnRenamed("node_id", "fact")), ["case_id", "fact"], "left")
    size = datasets.draw_size(seed + 1, least, F.least(F.lit(most), F.col("n_facts")), "case_id", "attempt")
    drawn = datasets.weighted_sample(facts, ["case_id", "attempt"], "fact", size, seed + 2, datasets.visit_weight(F.col("visits")))
    routes = drawn.groupBy("case_id", "attempt", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "fact"))), lambda x: x["fact"]).alias("evidence"))
    return routes.select("case_id", "attempt", F.lit(None).cast("string").alias("dimension"), graph.topic_walk(F.col("topic"), F.col("evidence")).alias("walk"), "evidence")


def _classes(cands: Candidates, cases: DataFrame, visits: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pair_classes`` of the cases; facts are counted again only under topics where one was visited."""
    group = ["case_id", "topic", "dimension"]
    members = cands.members.join(near(cases), "case_id", "left_semi")
    if cands.counts is None:
        return pair_classes(members, visits)
    met = checkpointed(members.join(near(visits.withColumnRenamed("node_id", "fact")), ["case_id", "fact"], "left_semi").select(*group).distinct())
    again = checkpointed(pair_classes(members.join(near(met), group, "left_semi"), visits))
    rest = cands.counts.join(near(cases), "case_id", "left_semi").join(near(met), group, "left_anti")
    no = F.lit(0).cast("long")
    rest = rest.select(*group, no.alias("low"), no.alias("high"), F.col("n").alias("n_low"), F.col("n").alias("n_high"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return rest.unionByName(again)


def _pair_draws(cands: Candidates, tries: DataFrame, visits: DataFrame, seed: int, near: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """case_id, attempt, dimension, walk, evidence: pairs drawn by weight without forming them."""
    classes = _classes(cands, tries.select("case_id").distinct(), visits, near)
    some = F.nullif("pairs", F.lit(0))  # keys may be judged before classes without pairs are left out
    key = datasets.weighted_order(seed, some / (1 + F.col("low") + F.col("high")), "case_id", "attempt", "topic", "dimension", "low", "high")
    one = _least(classes.join(near(tries), "case_id").withColumn("k", key), ["case_id", "attempt"], ["topic", "dimension", "low", "high"], near)
    place = F.least(F.floor(datasets.uniform(seed + 1, "case_id", "attempt") * F.col("pairs")).cast("long"), F.col("pairs") - 1)
    i, j = unranked(F.col("place"), F.col("n_low"), F.col("n_high"), F.col("low") == F.col("high"))
    at = checkpointed(one.withColumn("place", place).withColumns({"i": i.cast("long"), "j": j.cast("long")}))
    chosen = at.select("case_id", "topic", "dimension").distinct()
    known = cands.members.join(near(chosen), ["case_id", "topic", "dimension"], "left_semi").join(near(visits.withColumnRenamed("node_id", "fact")), ["case_id", "fact"], "left").withColumn("v", F.coalesce("visits", F.lit(0)).cast("long"))
    known = known.withColumn("r", (F.row_number().over(Window.partitionBy("case_id", "topic", "dimension", "v").orderBy("fact")) - 1).cast("long"))
    side = lambda v, r, name: known.select("case_id", "topic", "dimension", F.col("v").alias(v), F.col("r").alias(r), F.col("fact").alias(name))
    both = at.join(side("low", "i", "x"), ["case_id", "topic", "dimension", "low", "i"]).join(side("high", "j", "y"), ["case_id", "topic", "dimension", "high", "j"])
    a, b = F.least("x", "y"), F.greatest("x", "y")
    return both.select("case_id", "attempt", "dimension", F.array(a, "topic", b).alias("walk"), F.array(a, b).alias("evidence"))


def _redrawn(draw, cases: DataFrame, past: DataFrame, mode: str, seed: int) -> DataFrame:
    """The first unseen draw of each case: ``draw(tries, seed)``, again and with twice the attempts for those that had none."""
    waiting, found = cases, None
    for n in range(TRIES):
        tries = waiting.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS << n))))
        drawn = _signed(draw(tries, seed + 10 * n), mode).join(past, ["case_id", "signature"], "left_anti")
        first = drawn.groupBy("case_id").agg(F.min_by(F.struct("dimension", "walk", "evidence", "signature"), "attempt").alias("r")).select("case_id", "r.*")
        found = checkpointed(first if found is None else found.unionByName(first))
        waiting = waiting.join(found, "case_id", "left_anti")
        if waiting.isEmpty():
            break
    return found


def lap_routes(edges: DataFrame, nodes: DataFrame, count: int, seed: int = 0, visits: DataFrame | None = None, seen: DataFrame | None = None, least: int = 2, most: int = 3) -> DataFrame:
    """``count`` routes of each case, or as many as it has: case_id, lap (from 1), mode, dimension, walk, evidence, signature.

    ``visits`` (case_id, node_id, visits) and ``seen`` (case_id, signature) are what earlier runs left.
    """
    spark = nodes.sparkSession
    cands = candidates(edges, nodes, least, most)
    routes = checkpointed(spark.createDataFrame([], ROUTE))
    few = lambda df, n: df.limit(n + 1).count() <= n
    small = few(cands.totals, NEAR_ROWS // (count * max(2, most))) and all(df is None or few(df, NEAR_ROWS) for df in (visits, seen))
    near = F.broadcast if small else _same
    for lap in range(1, count + 1):
        for k, mode in enumerate(datasets.MODES):
            had = routes.groupBy("case_id").agg(F.count("*").alias("had"), F.count_if(F.col("mode") == mode).alias("of_mode"), F.max("lap").alias("last"))
            may = f"coalesce(had, 0) < {count} and coalesce(last, 0) >= {lap - 1} and coalesce(of_mode, 0) < total"
            cases = checkpointed(cands.totals.where(F.col("mode") == mode).join(near(had), "case_id", "left").where(may).select("case_id"))
            if cases.isEmpty():
                continue
            past = routes.select("case_id", "signature")
            past = past if seen is None else past.unionByName(seen.select("case_id", "signature"))
            now = datasets.visit_counts(routes)
            now = now if visits is None else now.unionByName(visits.select("case_id", "node_id", "visits")).groupBy("case_id", "node_id").agg(F.sum("visits").alias("visits"))
            at = seed * 1_000_003 + 1000 * (lap * len(datasets.MODES) + k)
            if mode == "same_topic":
                drawn = _redrawn(lambda tries, s, now=now: _topic_draws(cands, tries, now, s, least, most, near), cases, past, mode, at)
            elif mode == "comparison":
                drawn = _redrawn(lambda tries, s, now=now: _pair_draws(cands, tries, now, s, near), cases, past, mode, at)
            else:
                drawn = _listed(cands.single if mode == "single_fact" else cands.temporal, cases, past, now, at, near)
            drawn = drawn.select("case_id", F.lit(lap).alias("lap"), F.lit(mode).alias("mode"), "dimension", "walk", "evidence", "signature")
            routes = checkpointed(routes.unionByName(drawn))
        if routes.where(F.col("lap") == lap).isEmpty():
            break
    return routes
