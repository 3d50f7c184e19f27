"""Promotion queries: filters, sort, paging, totals and display projections
(F1-F12, O1-O3, O5).

Filters are plain Column predicates ANDed together, so Catalyst pushes the
simple ones (bank, is_active, dates, spend) into the parquet scan and prunes
bank partitions. Sorting always ends in the unique ``id`` so pages never
overlap; paging is ``orderBy().offset().limit()`` which Spark plans as a
top-k (``TakeOrderedAndProject``) instead of a full sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTABLE = ("scraped_at", "title", "end_date", "created_at")


@dataclass
class PromotionFilter:
    bank: str | None = None
    category: str | None = None
    merchant_name: str | None = None
    discount_type: str | None = None
    card_type: str | None = None
    search: str | None = None
    is_active: bool | None = None          # None = both
    start_date_from: str | None = None
    start_date_to: str | None = None
    end_date_from: str | None = None
    end_date_to: str | None = None
    min_spend_min: float | None = None
    min_spend_max: float | None = None
    card_type_json_text: bool = False      # compat: match the JSON text of the list


def _contains_ci(col: Column, term: str) -> Column:
    """Case-insensitive substring with the user's % and _ acting as wildcards."""
    return col.ilike(f"%{term}%")


def predicate(f: PromotionFilter) -> Column:
    """AND of the active filters (empty/None parameters are ignored)."""
    conds = []
    if f.bank:
        conds.append(F.col("bank") == f.bank)
    if f.category:
        conds.append(F.col("category") == f.category)
    if f.merchant_name:
        conds.append(_contains_ci(F.col("merchant_name"), f.merchant_name))
    if f.discount_type:
        conds.append(F.col("discount_type") == f.discount_type)
    if f.card_type:
        if f.card_type_json_text:
            conds.append(_contains_ci(F.to_json(F.col("card_types")), f.card_type))
        else:
            term = f.card_type
            conds.append(F.exists(F.col("card_types"), lambda x: x.ilike(f"%{term}%")))
    if f.search:
        conds.append(_contains_ci(F.col("title"), f.search) | _contains_ci(F.col("description"), f.search))
    if f.is_active is not None:
        conds.append(F.col("is_active") == F.lit(f.is_active))
    if f.start_date_from:
        conds.append(F.col("start_date") >= F.lit(f.start_date_from).cast("date"))
    if f.start_date_to:
        conds.append(F.col("start_date") <= F.lit(f.start_date_to).cast("date"))
    if f.end_date_from:
        conds.append(F.col("end_date") >= F.lit(f.end_date_from).cast("date"))
    if f.end_date_to:
        conds.append(F.col("end_date") <= F.lit(f.end_date_to).cast("date"))
    if f.min_spend_min is not None:
        conds.append(F.col("minimum_spend") >= F.lit(float(f.min_spend_min)))
    if f.min_spend_max is not None:
        conds.append(F.col("minimum_spend") <= F.lit(float(f.min_spend_max)))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def filter_promotions(df: DataFrame, f: PromotionFilter) -> DataFrame:
    return df.filter(predicate(f))


def sort_columns(sort_by: str = "scraped_at", sort_order: str = "desc") -> list[Column]:
    """O1: unknown field sorts by scraped_at; only 'asc' is ascending. Nulls come
    first ascending and last descending; ``id`` breaks ties."""
    col = sort_by if sort_by in SORTABLE else "scraped_at"
    c = F.col(col).asc_nulls_first() if sort_order == "asc" else F.col(col).desc_nulls_last()
    return [c, F.col("id").asc()]


def page_of(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """O2: page >= 1, size 1..100; offset (page-1)*size."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be >= 1 and page_size within 1..100")
    ordered = df.orderBy(*order)
    if page > 1:
        ordered = ordered.offset((page - 1) * page_size)
    return ordered.limit(page_size)


def total_and_pages(df: DataFrame, page_size: int = 20) -> DataFrame:
    """O3/A4: total before paging and the page count (0 when empty)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(page_size)).cast("long").alias("pages"))


def query_promotions(df: DataFrame, f: PromotionFilter, sort_by: str = "scraped_at",
                     sort_order: str = "desc", page: int = 1, page_size: int = 20):
    """(page rows, total) for one request; both are lazy DataFrames."""
    filtered = filter_promotions(df, f)
    return (page_of(filtered, sort_columns(sort_by, sort_order), page, page_size),
            total_and_pages(filtered, page_size))


def by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is listed in ``ids`` (0 or 1 row per id)."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def list_by_bank(df: DataFrame, bank: str | None = None, active_only: bool = True) -> DataFrame:
    """rows of a bank, active only by default, newest first."""
    out = df
    if bank:
        out = out.filter(F.col("bank") == bank)
    if active_only:
        out = out.filter(F.col("is_active"))
    return out.orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id"))


def display_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """Latest N active promotions as display columns."""
    latest = df.filter(F.col("is_active")).orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id")).limit(n)
    return latest.select(
        "id", "bank",
        F.substring("title", 1, 40).alias("title_40"),
        F.coalesce(F.col("category"), F.lit("-")).alias("category_text"),
        F.when(F.col("discount_type").isNotNull(),
               F.concat(F.col("discount_type"), F.lit(": "), F.coalesce(F.col("discount_value"), F.lit("None"))))
        .otherwise(F.lit("-")).alias("discount_text"),
        F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("-")).alias("end_date_text"),
    )


def expiry_status(df: DataFrame, today: str) -> DataFrame:
    """Expired / expiring (within 7 days) / active / none against ``today``."""
    d = F.lit(today).cast("date")
    status = (F.when(F.col("end_date").isNull(), F.lit("none"))
              .when(F.col("end_date") < d, F.lit("expired"))
              .when(F.datediff(F.col("end_date"), d) <= 7, F.lit("expiring"))
              .otherwise(F.lit("active")))
    return df.select("id", "bank", "source_id", "end_date", status.alias("expiry_status"))
