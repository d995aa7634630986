"""Reading and writing the layers of the lake: JSON landing files, partitioned Parquet tables, JDBC history."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave import schemas

BATCH = "_batch_date"


def setting(name: str, environment: Mapping[str, str] | None = None, default: str | None = None) -> str:
    """A setting of the environment; without a default a missing one raises."""
    value = (os.environ if environment is None else environment).get(name) or default
    if value is None:
        raise ValueError(f"{name} is not set")
    return value


def lake_path(container: str, account: str, path: str) -> str:
    """Address of a folder in a storage account's file system."""
    return f"abfss://{container}@{account}.dfs.core.windows.net/{path.lstrip('/')}"


def scan_raw(spark: SparkSession, folder: str, batch_date: str, raw_format: str = "json", safe: bool = True) -> DataFrame:
    """One day's landing files under the bronze schema.

    With ``safe`` a record that doesn't parse keeps its text in _corrupt_record and isn't lost among all-null rows. Parquet is read as it is.
    """
    path = f"{folder}/date={batch_date}/"
    if raw_format == "parquet":
        return spark.read.schema(schemas.BRONZE).parquet(path)
    reader = spark.read.schema(schemas.BRONZE_SAFE if safe else schemas.BRONZE).option("mode", "PERMISSIVE").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss")
    return (reader.option("columnNameOfCorruptRecord", schemas.CORRUPT) if safe else reader).json(path)


def scan_batch(spark: SparkSession, path: str, batch_date: str) -> DataFrame:
    """One batch of a layer; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col(BATCH) == F.lit(batch_date).cast("date"))


def from_records(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Records in memory; keys that a record lacks are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def with_metadata(df: DataFrame, batch_date: str, environment: str, at) -> DataFrame:
    """Where and when rows came in; the source path is null for rows that don't come from files."""
    source = F.col("_metadata.file_path") if df.inputFiles() else F.lit(None).cast("string")
    return df.withColumns({"_ingestion_timestamp": at, BATCH: F.lit(batch_date).cast("date"), "_environment": F.lit(environment), "_source_path": source})


def append(df: DataFrame, path: str, strict: T.StructType | None = None) -> None:
    """Append to a table partitioned by batch date; with ``strict`` names and types must be exactly these."""
    if strict is not None:
        have, want = {(f.name, f.dataType) for f in df.schema.fields}, {(f.name, f.dataType) for f in strict.fields}
        if have != want:
            raise ValueError(f"schema differs: {sorted(str(x) for x in have ^ want)}")
    df.write.mode("append").partitionBy(BATCH).parquet(path)


def clustered(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Rows ranged and sorted by a column, so that file statistics skip most files of a range query."""
    ranged = df.repartitionByRange(partitions, column) if partitions else df.repartitionByRange(column)
    return ranged.sortWithinPartitions(column)


def register(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING PARQUET LOCATION '{path}'")


def batch_count(spark: SparkSession, path: str, batch_date: str) -> int:
    """Rows of a batch as they were written."""
    return scan_batch(spark, path, batch_date).count()


def append_history(df: DataFrame, url: str, table: str = "risk_scores_history", **options: str) -> bool:
    """Append scores over JDBC; without a URL nothing is written."""
    if not url:
        return False
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
    return True
