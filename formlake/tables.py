"""Access to the tables of a data folder, by any path that Spark's readers can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
