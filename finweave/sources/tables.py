"""Parquet tables of the platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make tables visible to ``spark.sql`` under their own names."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
