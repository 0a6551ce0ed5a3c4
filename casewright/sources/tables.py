"""Reading the tables of one data folder, by whatever path Spark itself understands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (a local path or any Hadoop URI)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
