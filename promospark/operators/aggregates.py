"""Stats, facets and coverage reports.

All are single-pass aggregates with map-side partial aggregation; facets scan
the table once (``stack`` to (facet, value) pairs, then ``distinct``), instead
of one scan per facet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def bank_stats(df: DataFrame) -> DataFrame:
    """A1: per bank total rows and active rows."""
    return df.groupBy("bank").agg(F.count(F.lit(1)).alias("total"),
                                  F.count_if(F.col("is_active")).alias("active"))


def facets(df: DataFrame) -> DataFrame:
    """A2+A3: sorted distinct values per facet, nulls out, inactive rows included.
    card_types contributes its non-empty elements."""
    scalar = df.select(F.expr(
        "stack(4, 'bank', bank, 'category', category, 'discount_type', discount_type, "
        "'merchant_name', merchant_name) AS (facet, value)"))
    cards = df.select(F.lit("card_types").alias("facet"), F.explode("card_types").alias("value"))
    both = scalar.unionByName(cards)
    return both.filter(F.col("value").isNotNull() & ((F.col("facet") != "card_types") | (F.col("value") != ""))) \
        .distinct()


def card_type_facet(df: DataFrame) -> DataFrame:
    """A3 alone: distinct non-empty card types."""
    return (df.select(F.explode("card_types").alias("card_type"))
            .filter(F.col("card_type").isNotNull() & (F.col("card_type") != "")).distinct())


def coverage(df: DataFrame) -> DataFrame:
    """A5: per bank (null -> 'unknown') rows, merchant missing, card types empty."""
    bank = F.coalesce(F.nullif(F.col("bank"), F.lit("")), F.lit("unknown"))
    merchant_missing = F.col("merchant_name").isNull() | (F.col("merchant_name") == "")
    cards_empty = F.col("card_types").isNull() | (F.size("card_types") == 0)
    return df.groupBy(bank.alias("bank")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(merchant_missing).alias("merchant_null"),
        F.count_if(cards_empty).alias("card_types_empty"))


def coverage_report(df: DataFrame) -> DataFrame:
    """Per-bank rows with percent texts, plus an 'ALL' grand-total row."""
    per_bank = coverage(df)
    total = per_bank.agg(F.lit("ALL").alias("bank"), F.sum("total").alias("total"),
                         F.sum("merchant_null").alias("merchant_null"),
                         F.sum("card_types_empty").alias("card_types_empty"))
    both = per_bank.unionByName(total)
    return both.select(
        "bank", F.col("total").cast("long").alias("total"),
        F.col("merchant_null").cast("long").alias("merchant_null"),
        F.col("card_types_empty").cast("long").alias("card_types_empty"),
        _pct(F.col("merchant_null"), F.col("total")).alias("merchant_null_pct"),
        _pct(F.col("card_types_empty"), F.col("total")).alias("card_types_empty_pct"))


def _pct(n, d):
    """Percent with one decimal. The double ``100 * n / d`` is rounded by its exact
    binary value, half to even; a dash for a zero denominator.

    Below 2^20 a double of at least 2^-5 is a whole number of 2^-57; that number is
    built from two exact parts as a decimal and compared with the middle between
    the neighbouring tenths. Smaller ratios are below the first middle."""
    p = F.lit(100.0) * n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))
    high = F.floor(p * float(1 << 20))
    low = F.floor((p * float(1 << 20) - high.cast("double")) * float(1 << 37))
    exact = high.cast("decimal(20,0)") * F.lit(1 << 37).cast("decimal(12,0)") + low.cast("decimal(20,0)")
    twice = (exact * F.lit(20).cast("decimal(2,0)")).cast("decimal(36,0)")  # in halves of a tenth
    unit = F.lit(1 << 57).cast("decimal(18,0)")
    q = F.floor(twice / (unit * F.lit(2).cast("decimal(1,0)"))).cast("long")
    middle = ((F.lit(2).cast("long") * q + 1).cast("decimal(12,0)") * unit).cast("decimal(36,0)")
    up = (twice > middle) | ((twice == middle) & (q % 2 == 1))
    q2 = q + F.when(up, 1).otherwise(0)
    text = F.concat((q2 / 10).cast("long").cast("string"), F.lit("."), (q2 % 10).cast("string"), F.lit("%"))
    return F.when(d == 0, F.lit("—")).otherwise(text)


def missing_merchant_samples(df: DataFrame, order_cols, n: int = 10) -> DataFrame:
    """Up to n trimmed non-empty titles per bank among rows missing a
    merchant, first in input order. Only missing-merchant rows enter the window."""
    bank = F.coalesce(F.nullif(F.col("bank"), F.lit("")), F.lit("unknown"))
    missing = (df.filter(F.col("merchant_name").isNull() | (F.col("merchant_name") == ""))
               .withColumn("bank", bank)
               .withColumn("title", F.trim(F.coalesce(F.col("title"), F.lit(""))))
               .filter(F.col("title") != ""))
    # row_number() <= n is planned with a per-task group limit before the
    # shuffle, so a bank holding most rows ships only n rows per task.
    w = Window.partitionBy("bank").orderBy(*order_cols)
    ranked = missing.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return ranked.select("bank", "title", F.col("_rank").alias("sample_rank"))


def low_coverage_banks(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Banks whose merchant-missing share is strictly above the threshold."""
    c = coverage(df)
    return c.filter((F.col("total") > 0) & (F.col("merchant_null") / F.col("total") > threshold))
