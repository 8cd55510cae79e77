"""Readers and writers: graph JSON, question records, checkpoints, traces, training files."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "id string, user_name string, type string, status string, memory_type string, key string, memory string, background string, tags array<string>, confidence double, version int, created_at string, updated_at string, sources array<string>"
EDGE = "source string, target string, type string, properties string"
RECORD = "question_id string, question_type string, question string, answer string, question_date string"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph JSON files: {version, nodes, edges, stats}."""
    graph = spark.read.schema(f"version string, nodes array<struct<{_nested(NODE)}>>, edges array<struct<{_nested(EDGE)}>>").option("multiLine", True).json(path)
    return graph.selectExpr("inline(nodes)").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "sources")}), graph.selectExpr("inline(edges)")


def _nested(schema: str) -> str:
    return ", ".join(part.replace(" ", ":", 1) for part in schema.split(", "))


def node_scan(nodes: DataFrame, users: list[str]) -> DataFrame:
    """The users' nodes without embeddings, by user, creation and id."""
    extra = [c for c in nodes.columns if "embedding" in c]
    return nodes.where(F.col("user_name").isin(users)).drop(*extra).orderBy("user_name", "created_at", "id")


def edge_scan(edges: DataFrame, nodes: DataFrame, users: list[str]) -> DataFrame:
    """Edges between nodes of the users, of one or of two of them."""
    ids = nodes.where(F.col("user_name").isin(users)).select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type", "properties").orderBy("source", "target", "type")


def case_users(spark: SparkSession, version: str, n: int) -> DataFrame:
    return spark.range(n).select(F.format_string(f"lme_exper_user_{version}_%d", "id").alias("user_name"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Question records with case_index, their position: a JSON array, an object with ``data``, or one JSON object a line.

    All files of a folder are numbered as one, in the order of their names.  Lines are read as lines; only a document that
    is one array or object is read whole, as JSON has to be.  Anything else is an error.
    """
    first = F.ltrim("value")
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(first.alias("v")).first()
    if head is None:
        return spark.createDataFrame([], f"case_index long, {RECORD}")
    kinds = f"array<struct<{_nested(RECORD)}>>"
    line = F.from_json(F.lit(head.v), "data string, question string")
    one = spark.range(1).select(line.alias("r"), F.try_parse_json(F.lit(head.v)).isNotNull().alias("whole")).first()
    if head.v.startswith("{") and one.whole and one.r.data is None:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
        return _numbered(lines.withColumn("r", F.from_json("value", RECORD))).select("case_index", "r.*")
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"), F.lit(0).alias("_from"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kinds)).otherwise(F.from_json(F.get_json_object("value", "$.data"), kinds))
    wrong = F.raise_error(F.lit("neither a list of records, nor an object with data, nor lines")).cast(kinds)
    return _numbered(raw.select("_file", "_from", F.posexplode(F.coalesce(listed, wrong)).alias("_at", "r"))).select("case_index", "r.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with case_index from 0 in the order of ``_file``, ``_from`` (where a split of it begins) and ``_at``: counts of
    splits are summed (one row each), and rows are ranked within their own."""
    counts = rows.groupBy("_file", "_from").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_from")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_file", "_from").orderBy("_at"))
    return rows.withColumn("_k", place).join(before, ["_file", "_from"]).withColumn("case_index", F.col("_before") + F.col("_k") - 1)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> None:
    """A graph for exchange: JSON lines of nodes and of edges in folders of their own, and one line with version and counts.

    Nothing is gathered; ``write_graph_document`` writes the single document of a small graph.
    """
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps({"version": version, "stats": graph_stats(nodes, edges)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> dict:
    relations = {r.type: r.n for r in edges.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").toLocalIterator()}
    return {"num_users": nodes.select("user_name").distinct().count(), "num_nodes": nodes.count(), "num_edges": edges.count(), "relation_counts": relations}


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``write_graph``."""
    return spark.read.schema(NODE).json(f"{path}/nodes"), spark.read.schema(EDGE).json(f"{path}/edges")


def write_graph_document(nodes: DataFrame, edges: DataFrame, path: str, version: str, most: int = 100_000) -> None:
    """A graph of at most ``most`` nodes and edges as one JSON document; a larger one is an error."""
    stats = graph_stats(nodes, edges)
    if stats["num_nodes"] + stats["num_edges"] > most:
        raise ValueError(f"{stats['num_nodes']} nodes and {stats['num_edges']} edges are too many for one document; use write_graph")
    side = lambda df: df.agg(F.collect_list(F.struct(*df.columns)).alias("x"))
    doc = side(nodes).select(F.col("x").alias("nodes")).crossJoin(side(edges).select(F.col("x").alias("edges")))
    out = doc.select(F.to_json(F.struct(F.lit(version).alias("version"), "nodes", "edges", F.parse_json(F.lit(json.dumps(stats))).alias("stats")), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    out.coalesce(1).write.mode("overwrite").text(path)


def write_checkpoint(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """State tables under a version of their own; the pointer is written last, so a reader never sees half of one."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark.createDataFrame([(version, ",".join(tables))], "version int, tables string").coalesce(1).write.mode("append").json(f"{folder}/pointers")


def read_checkpoint(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last whole version; none if there is no checkpoint."""
    try:
        pointers = spark.read.schema("version int, tables string").json(f"{folder}/pointers")
        last = pointers.orderBy(F.col("version").desc()).first()
    except AnalysisException:
        return {}
    return {name: spark.read.parquet(f"{folder}/v{last.version}/{name}") for name in last.tables.split(",")} if last else {}


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path with the largest number after global_step_, by number and not by text; an error if there is none."""
    step = F.regexp_extract("path", r"global_step_(\d+)/?$", 1)
    last = F.max_by("path", step.cast("long"))
    return paths.where(step != "").agg(F.coalesce(last, F.raise_error(F.lit("no global_step_ checkpoint"))).alias("path"))


def append_trace(rows: DataFrame, path: str) -> None:
    """One JSON object a row, nulls written."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_training(records: DataFrame, split: DataFrame, folder: str) -> dict:
    """Records by split (id, split) as Parquet folders train and val; an error if there are none, or none in a split.

    Gives {split: rows} and, where records have extra_info.route.attack_mode, {"modes": {split: {mode: rows}}} besides.
    """
    both = records.join(split, "id")
    nested = "extra_info.route.attack_mode"
    try:
        both.select(nested).schema  # noqa: B018 - analysed, not run
        mode = F.col(nested)
    except AnalysisException:
        mode = F.lit(None).cast("string")
    sizes, modes = {"train": 0, "val": 0}, {"train": {}, "val": {}}
    for r in both.groupBy("split", mode.alias("mode")).agg(F.count("*").alias("n")).collect():  # two rows a mode
        sizes[r.split] += r.n
        if r.mode is not None:
            modes[r.split][r.mode] = r.n
    if not all(sizes.values()):
        raise ValueError(f"no training records in a split: {sizes}")
    for part in sizes:
        both.where(F.col("split") == part).drop("split", "id").write.mode("overwrite").parquet(f"{folder}/{part}.parquet")
    return sizes | {"modes": modes}
