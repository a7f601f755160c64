"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensured(spark: SparkSession) -> str:
    """The checkpoint folder of the session. spark.checkpoint.dir holds; only where none is set in a session on one machine, as in tests, a local folder is."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared checkpoint folder. rows: as few partitions as hold so many rows each, so that a small table makes few shuffle files."""
    _ensured(df.sparkSession)
    out = df.checkpoint()
    return out if rows is None else out.coalesce(max(1, -(-out.count() // rows)))


def stage_folder(spark: SparkSession) -> str:
    """A new folder within the shared checkpoint folder."""
    return f"{_ensured(spark).rstrip('/')}/{uuid.uuid4().hex}"
