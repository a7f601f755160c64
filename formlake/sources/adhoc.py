"""Free SQL over named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ask(spark: SparkSession, frames: dict[str, DataFrame], sql: str) -> DataFrame:
    """The result of an SQL text whose tables are the given frames; the views last no longer than the parse."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
