"""The hourly velocity rule and the record layers on a stream; an addition, for the batch queries have no stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finweave.functions import rules
from finweave.plans.records import lake_scored


def transactions(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of transactions as they arrive in a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def velocity_alerts(stream: DataFrame, least: int = 50, late: str = "2 hours") -> DataFrame:
    """Accounts with more than ``least`` completed transactions in a clock hour, counted until the watermark passes the hour.

    Each transaction_id counts once while the watermark remembers it; rows later than that are dropped.
    """
    done = stream.where("status = 'COMPLETED' and source_account_id is not null and transaction_timestamp is not null")
    once = done.withWatermark("transaction_timestamp", late).dropDuplicates(["transaction_id", "transaction_timestamp"])
    hours = once.groupBy(F.window("transaction_timestamp", "1 hour"), "source_account_id").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("total_amount"))
    return hours.where(F.col("txn_count") > least).select(F.col("window.start").alias("hour_bucket"), "source_account_id", "txn_count", "total_amount")


def score_batches(records: DataFrame, gold: str, quarantine: str, checkpoint: str, at: datetime) -> StreamingQuery:
    """Check, flag and score each micro-batch; both outputs are named by the batch, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = rules.lake_flags(rules.lake_quality(rules.normalize_lake(batch), at))
        good, bad = rules.split(rows, safe=True)
        lake_scored(good).write.mode("overwrite").parquet(f"{gold}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
