"""Aggregation under skew: compact states are built before any join or roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states(df: DataFrame, keys: list[str], amount: str, time: str) -> DataFrame:
    """Count, total and last time per key: ``n``, ``total``, ``last_at``.

    Partial aggregation runs in every input task, so a key with a third of all rows reaches
    the shuffle as one state per task. A null key is a group of its own; null amounts count as rows
    but add nothing (a group with only null amounts has total 0); an empty input gives no group.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,4)").alias("total"),
        F.max(time).alias("last_at"),
    )


def multiplicities(df: DataFrame, key: str, group: list[str]) -> DataFrame:
    """The other side of the join, compacted: rows per join key and roll-up group, ``m``."""
    return df.groupBy(key, *group).agg(F.count(F.lit(1)).alias("m"))


def join_rollup(left: DataFrame, right: DataFrame, key: str, group: list[str], extra: list[str], keep: bool = False) -> DataFrame:
    """Aggregate the join of two inputs from their states alone.

    Each of ``left``'s rows would meet ``m`` rows of ``right``, so counts and totals are multiplied by m and
    the latest time stays; then the states are rolled up to ``group`` and ``extra``. Keys without a
    partner and null keys drop out, as in the inner join this replaces; with ``keep`` they stay and count once, as in an outer join.
    """
    joined = left.join(right, key, "left").withColumn("m", F.coalesce("m", F.lit(1))) if keep else left.join(right, key)
    return joined.groupBy(*group, *extra).agg(
        F.sum(F.col("n") * F.col("m")).alias("n"),
        F.sum((F.col("total") * F.col("m")).cast("decimal(38,4)")).cast("decimal(38,4)").alias("total"),
        F.max("last_at").alias("last_at"),
    )


def sides(tx: DataFrame) -> DataFrame:
    """Each transaction once per side: account_id, side, amount, transaction_timestamp."""
    return tx.select(
        F.expr("stack(2, source_account_id, 'source', destination_account_id, 'destination') as (account_id, side)"),
        "amount",
        "transaction_timestamp",
    )


def heavy_accounts(account_states: DataFrame, share: float) -> DataFrame:
    """Accounts with at least ``share`` of all transactions of a side; null accounts count in the total only.

    The totals are two rows, one a side, which bounds the broadcast.
    """
    totals = account_states.groupBy("side").agg(F.sum("n").alias("all_n"))
    return (
        account_states.where(F.col("account_id").isNotNull())
        .join(F.broadcast(totals), "side")
        .where(F.col("n") >= F.col("all_n") * F.lit(share))
        .select("account_id", "side")
    )
