"""Top-k per group and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows of rank 1..k in each group, numbered in ``rank``.

    The filter on the row number lets Spark keep k rows per group in every partition before the shuffle, so a group
    with a third of all rows arrives as k rows per partition.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def best_overall(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k best rows in ``rank`` order; only k rows per partition are merged."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
