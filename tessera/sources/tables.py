"""Readers of the engine's input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder, on any file system that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
