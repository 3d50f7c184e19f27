"""Dedup and category stamping.

P1 keeps the first row per key in crawl order: row number 1 by the total order.
Spark plans that with a group limit before the shuffle, so a key holding a third of
all rows is reduced to one row per map task and never gathered in one task, and
columns that the query doesn't use are not read, let alone shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("bank", "source_id")


def first_seen(df: DataFrame, key=KEY, order: str = "ord") -> DataFrame:
    """First row per key by the total order column ``order`` (a struct)."""
    rest = [c for c in df.columns if c not in key]
    # The id comes first in the sort, as few rows share the first bytes of an id and many those of a source.
    by_order = Window.partitionBy(*reversed(key)).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("_nth", F.row_number().over(by_order)).where("_nth = 1").select(*key, *rest)


def key_duplicates(df: DataFrame, key=KEY) -> DataFrame:
    """Keys occurring more than once (the uniqueness check of the table)."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))
