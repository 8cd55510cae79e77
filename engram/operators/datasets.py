"""Sampling, interleaving, splits and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ["single_fact", "same_topic", "temporal_evolution", "comparison"]


def mode_order(mode: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MODES)), mode)


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that seed and keys fix, wherever it is computed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)


def weighted_order(seed: int, weight: Column, *keys: str) -> Column:
    """Ascending order of exponential keys: its prefixes are weighted samples without replacement."""
    return -F.log(uniform(seed, *keys)) / weight


def weighted_sample(rows: DataFrame, by: list[str], key: str, k: int | Column, seed: int, weight: Column | None = None) -> DataFrame:
    """At most k rows of each group, by weight (1 / (1 + visits) for routes)."""
    order = weighted_order(seed, weight if weight is not None else F.lit(1.0), *by, key)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
    return rows.withColumn("draw", rank).where(F.col("draw") <= k)


def visit_weight(visits: Column) -> Column:
    return 1 / (1 + F.coalesce(visits, F.lit(0)))


def visit_counts(routes: DataFrame) -> DataFrame:
    """case_id, node_id, visits from ``routes`` (case_id, evidence)."""
    return routes.select("case_id", F.explode("evidence").alias("node_id")).groupBy("case_id", "node_id").agg(F.count("*").alias("visits"))


def draw_size(seed: int, least: int, most: Column, *keys: str) -> Column:
    """A whole number from max(2, least) to ``most``, each equally likely; 2 at least."""
    low = max(2, least)
    return F.lit(low) + F.floor(uniform(seed, *keys) * F.greatest(F.lit(1), most - low + 1)).cast("int")


def unseen(routes: DataFrame, seen: DataFrame) -> DataFrame:
    return routes.join(seen, "signature", "left_anti")


def round_robin(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (case_id, mode, seq) in laps of one for each mode, modes in their order, ``count`` for each case."""
    lap = F.row_number().over(Window.partitionBy("case_id", "mode").orderBy("seq"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("lap", mode_order(F.col("mode"))))
    few = rows.withColumn("lap", lap).where(F.col("lap") <= count)  # a mode can't give more
    return few.withColumn("place", place).where(F.col("place") <= count)


def priority_first(high: DataFrame, fresh: DataFrame, count: int) -> DataFrame:
    """case_id, item, place: waiting items before fresh ones, ``count`` for each case."""
    both = high.select("case_id", "item", "seq", F.lit(0).alias("p")).unionByName(fresh.select("case_id", "item", "seq", F.lit(1).alias("p")))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("p", "seq"))
    return both.withColumn("place", place).where(F.col("place") <= count).select("case_id", "item", "place")


def val_size(n: Column, fraction: float) -> Column:
    """At least one and not all; a single row trains."""
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.bround(n * fraction).cast("int")), n.cast("int") - 1))


def stratified_split(rows: DataFrame, fraction: float = 0.1, seed: int = 0, strict: bool = False) -> DataFrame:
    """``rows`` (id, mode) with split (train or val), drawn within each mode.

    Ranks are taken within shards of a mode and sizes dealt to the shards in turn, so a mode
    that holds most rows is no single task's.  ``strict`` gives a lone row to both splits.
    """
    shards = 32
    sharded = rows.withColumn("_u", uniform(seed, "mode", "id")).withColumn("_shard", F.floor(F.col("_u") * shards).cast("int"))
    sizes = sharded.groupBy("mode", "_shard").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("mode")
    before = F.sum("_n").over(w.orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = sizes.select("mode", "_shard", before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("mode", "_shard").orderBy("_u", "id"))
    ranked = sharded.join(F.broadcast(sizes), ["mode", "_shard"]).withColumn("_rank", rank)  # modes x shards rows
    out = ranked.withColumn("split", F.when(F.col("_rank") <= val_size(F.col("_all"), fraction), "val").otherwise("train"))
    out = out.drop("_u", "_shard", "_before", "_rank")
    if strict:
        out = out.unionByName(out.where("_all = 1").withColumn("split", F.lit("val")))
    return out.drop("_all")


def shuffled(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``rows`` in an order that only seed and key fix."""
    return rows.orderBy(uniform(seed, key), key)


def random_split(rows: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """``rows`` (id) with split, drawn as one group; for rows that have no mode.  A lone row is in both splits."""
    return stratified_split(rows.withColumn("mode", F.lit("all")), fraction, seed, strict=True).drop("mode")


def mode_histogram(records: DataFrame) -> DataFrame:
    """place, mode, n of the modes that ``records`` (extra_info.route.attack_mode) have, in their order; records without one don't count."""
    found = records.select(F.col("extra_info.route.attack_mode").alias("mode")).where("mode is not null")
    return found.groupBy("mode").agg(F.count("*").alias("n")).select(mode_order(F.col("mode")).alias("place"), "mode", "n").orderBy("place")


def funnel(rows: DataFrame) -> DataFrame:
    """Counts for each mode of ``rows`` (mode, attempted, fits, selected)."""
    return rows.groupBy("mode").agg(F.count("*").alias("sampled"), *(F.count_if(F.col(c)).alias(c) for c in ("attempted", "fits", "selected")))


def training_records(rows: DataFrame, source: str, ability: str) -> DataFrame:
    """The five columns of a training file from ``rows`` (system, payload as struct, truth, extra as struct)."""
    user = F.concat(F.to_json("payload", {"ignoreNullFields": "false"}), F.lit("\n\n/no_think"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(turn("system", F.col("system")), turn("user", user)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("truth").alias("ground_truth")).alias("reward_model"),
        F.col("extra").alias("extra_info"),
    )
