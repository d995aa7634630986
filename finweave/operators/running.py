"""Running totals and trailing counts by key without a window over all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Most rows of a key in one stretch of time, which one task sorts.
STRETCH_ROWS = 1_000_000


def stretch(df: DataFrame, key: str, micros) -> int:
    """A length of time in microseconds, a day or a part of it, in which no key has more than STRETCH_ROWS rows, as far as its rows of a day are spread.

    Counted once over all rows, combined before the shuffle.
    """
    most = df.groupBy(F.col(key).alias("k"), F.floor(micros / DAY_US).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = 1
    while most > STRETCH_ROWS * parts and parts < 86_400:
        parts *= 2
    return DAY_US // parts


def running(df: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Add ``running_total`` and ``running_count`` in order of (time, tie) within key.

    Sums run inside a stretch of a key's time line, a day or less as its load demands, and over the stretches' totals, so a window partition is a stretch or one row a
    stretch, however hot the key. A null value adds nothing; rows with a null key or time are left out.
    """
    kept = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = kept.withColumn("__day", F.floor(F.unix_micros(time) / stretch(kept, key, F.unix_micros(time))))
    inside = Window.partitionBy(key, "__day").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(key, "__day").agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    days = days.select(key, "__day", F.sum("__v").over(ahead).alias("__v"), F.sum("__n").over(ahead).alias("__n"))
    return (
        rows.withColumns({"__iv": F.sum(value).over(inside), "__in": F.count(F.lit(1)).over(inside)})
        .join(days, [key, "__day"])
        .withColumn("running_total", F.when(F.col("__iv").isNull() & F.col("__v").isNull(), F.lit(None)).otherwise(F.coalesce("__iv", F.lit(0)) + F.coalesce("__v", F.lit(0))))
        .withColumn("running_count", F.col("__in") + F.coalesce("__n", F.lit(0)))
        .drop("__day", "__v", "__n", "__iv", "__in")
    )


def trailing_count(df: DataFrame, key: str, time: str, row_id: str, days: int = 30) -> DataFrame:
    """(row_id, key, time, n): rows of the key in [time - days, time], each row itself included.

    A row is counted up to its own time and up to a probe set ``days`` earlier; the difference of the two is the count. Both are ranks
    inside a stretch of the key's time line plus the totals of those before. Rows with a null key or time are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(row_id).alias("id"), F.unix_micros(time).alias("t"))
    marks = rows.select("k", "id", "t", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(1).alias("one")), F.struct((F.col("t") - days * DAY_US).alias("at"), F.lit(0).alias("one")))).alias("m")).select("k", "id", "t", "m.at", "m.one")
    marks = marks.withColumn("day", F.floor(F.col("at") / stretch(rows, "k", F.col("t"))))
    upto = F.sum("one").over(Window.partitionBy("k", "day").orderBy("at", "one"))
    totals = marks.groupBy("k", "day").agg(F.sum("one").alias("s"))
    totals = totals.select("k", "day", F.coalesce(F.sum("s").over(Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    ranks = marks.withColumn("r", upto).join(totals, ["k", "day"]).select("k", "id", "t", ((F.col("r") + F.col("s")) * F.when(F.col("one") == 1, 1).otherwise(-1)).alias("r"))
    return ranks.groupBy("k", "id", "t").agg(F.sum("r").alias("n")).select(F.col("id").alias(row_id), F.col("k").alias(key), F.timestamp_micros("t").alias(time), "n")
