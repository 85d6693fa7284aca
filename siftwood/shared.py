"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the context's checkpoint folder. Without either a local session gets a temporary one; on a cluster that is an error, as executors cannot see the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "siftwood-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def place(spark: SparkSession, stem: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{stem}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, with a plan that starts there, and still there when an executor is lost."""
    path = place(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Arrow batches of so few rows, unless fewer are set, for whole pages: a task's Python holds a batch, its strings and its results at once, and a page may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, rows) if now > 0 else rows))
