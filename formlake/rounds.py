"""Tables that rounds work on: written to the folder that all executors share, so a round does not carry the plans of those before it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed in spark.checkpoint.dir. Only a session on one machine without that setting, as in tests, gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="rounds-"))
    return df.checkpoint()
