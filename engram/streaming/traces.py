"""Extensions beyond the batch operators: reward traces and edit feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_traces(spark: SparkSession, path: str, schema: str, most_files: int = 100) -> DataFrame:
    """JSON traces as they are appended."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(path)


def windowed_rewards(traces: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by stage and window; rows later than ``late`` are dropped with the window's state."""
    return traces.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n"), F.sum("score").alias("score")).select(F.col("window.start").alias("start"), "stage", "n", "score")


def running_versions(edits: DataFrame) -> DataFrame:
    """case_id, version: edits so far that change something, kept as state for each case."""
    return edits.groupBy("case_id").agg(F.sum(F.when(F.col("op") != "noop", 1).otherwise(0)).alias("version"))
