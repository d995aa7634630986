"""Trailing totals over a dense calendar by block decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Sums are held as hi * LANE + lo in units of 1/10000, so decimal(38,4) sums stay exact in 64-bit lanes.
LANE = 10**12
#: Accounts turned into a dense matrix at a time.
SLICE = 2000
EPOCH = date(1970, 1, 1)


def normalised(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    carry = np.floor_divide(lo, LANE)
    return hi + carry, lo - carry * LANE


def trailing(x: np.ndarray, length: int) -> np.ndarray:
    """Sums of the last ``length`` columns up to each column.

    Columns are cut into blocks of that length; a window is the suffix of one block and the prefix of the next,
    so each total takes one addition whatever the length.
    """
    rows, days = x.shape
    blocks = -(-days // length)
    padded = np.zeros((rows, blocks * length), x.dtype)
    padded[:, :days] = x
    cut = padded.reshape(rows, blocks, length)
    prefix = cut.cumsum(axis=2).reshape(rows, -1)
    suffix = cut[:, :, ::-1].cumsum(axis=2)[:, :, ::-1].reshape(rows, -1)
    out = prefix[:, :days].copy()
    day = np.arange(length, days)
    day = day[(day + 1) % length != 0]
    out[:, day] += suffix[:, day - length + 1]
    return out


def daily_totals(tx: DataFrame, account: str, time: str, amount: str, first: date, last: date) -> DataFrame:
    """One row per account with its active days and their totals in two lanes: account, d, hi, lo.

    The sum per account and day is combined before the shuffle; after it an account has at most one row a day.
    Rows with a null account, time or amount, or outside [first, last], are not usable.
    """
    start = (first - EPOCH).days
    day = (F.floor(F.unix_micros(time) / DAY_US) - start).cast("int")
    units = (F.sum(F.col(amount).cast("decimal(24,4)")) * 10000).cast("decimal(38,0)")
    return (
        tx.where(F.col(account).isNotNull() & F.col(amount).isNotNull())
        .select(F.col(account).alias("account"), day.alias("d"), amount)
        .where(F.col("d").between(0, (last - first).days))
        .groupBy("account", "d")
        .agg(units.alias("u"))
        .withColumn("hi", F.floor(F.col("u") / F.lit(Decimal(LANE))).cast("bigint"))
        .withColumn("lo", (F.col("u") - F.col("hi").cast("decimal(25,0)") * F.lit(Decimal(LANE))).cast("bigint"))
        .groupBy("account")
        .agg(F.collect_list(F.struct("d", "hi", "lo")).alias("days"))
    )


def _dense(batch: pa.RecordBatch, days: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lengths)
    d, h, l = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    hi, lo = np.zeros((2, len(lists), days), np.int64)
    hi[row, d], lo[row, d] = h, l
    return hi, lo


def trailing_totals(daily: DataFrame, first: date, last: date, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For every account and every calendar day the trailing totals: account, d, and hi_L, lo_L for each length L."""
    days = (last - first).days + 1
    schema = "account string, d int, " + ", ".join(f"hi_{n} bigint, lo_{n} bigint" for n in lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                hi, lo = _dense(batch, days)
                who = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), days)))
                out = [who, pa.array(np.tile(np.arange(days, dtype=np.int32), batch.num_rows))]
                for n in lengths:
                    out += [pa.array(a.ravel()) for a in normalised(trailing(hi, n), trailing(lo, n))]
                yield pa.RecordBatch.from_arrays(out, ["account", "d", *(f"{p}_{n}" for n in lengths for p in ("hi", "lo"))])

    return daily.mapInArrow(run, schema)


def peak_days(daily: DataFrame, first: date, last: date, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The latest day on which each trailing total is highest: account and peak_L, days after ``first``."""
    days = (last - first).days + 1
    schema = "account string, " + ", ".join(f"peak_{n} int" for n in lengths)

    def peak(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        top = hi == hi.max(axis=1, keepdims=True)
        low = np.where(top, lo, -1)
        top &= low == low.max(axis=1, keepdims=True)
        return (days - 1 - top[:, ::-1].argmax(axis=1)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                hi, lo = _dense(batch, days)
                out = [pa.array(peak(*normalised(trailing(hi, n), trailing(lo, n)))) for n in lengths]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["account", *(f"peak_{n}" for n in lengths)])

    return daily.mapInArrow(run, schema)


def amount_of(hi: str, lo: str):
    """The decimal that two lanes hold."""
    return ((F.col(hi).cast("decimal(19,0)") * F.lit(Decimal(LANE)) + F.col(lo)) / 10000).cast("decimal(34,4)")


def day_text(d: str, first: date):
    return F.date_format(F.date_add(F.lit(first), F.col(d)), "yyyy-MM-dd")


__all__ = ["daily_totals", "trailing_totals", "peak_days", "amount_of", "day_text", "trailing", "timedelta"]
