"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, where the session doesn't say: texts may be long, and a batch is held whole on either side.
BATCH_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a shared or local path), in batches
    of few rows.  On a cluster without that path, submit the package with ``--py-files`` instead."""
    if spark.conf.get(_ROWS) == "10000":  # Spark's own
        spark.conf.set(_ROWS, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, shared by driver and executors.  Only a local session may leave it out."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="engram-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of spark.checkpoint.dir, its lineage cut.  Only a local session may leave the folder out."""
    _shared(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: for large tables that are read several times, or in part."""
    path = f"{_shared(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, a plain read of files, dealt to all cores if it comes in fewer partitions: one row group can't be split,
    and work on its texts would stay in one task.  Larger inputs have partitions enough and are not moved."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def small_side(df: DataFrame, most_rows: int = 1 << 17) -> DataFrame:
    """``df``, narrow and cheap to read, marked for broadcast if it has at most ``most_rows`` rows; a larger one joins by shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
