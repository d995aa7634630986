"""The standing version of records that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standing_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Of the rows with one ``key`` keep the one with the greatest ``version``, ``columns`` only.

    Keys are identifiers with few rows each, so the shuffle on them is even. Ties are broken by
    the other columns, greatest first, nulls last, which makes the result independent of row order.
    Rows with a null key have no identity to be matched on and are left out.
    """
    rest = [c for c in columns if c not in (key, version)]
    order = [F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in rest)]
    return (
        df.where(F.col(key).isNotNull())
        .select(key, version, *rest)
        .withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .where("__rank = 1")
        .select(*dict.fromkeys([key, *columns]))
    )
