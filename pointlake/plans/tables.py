"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
