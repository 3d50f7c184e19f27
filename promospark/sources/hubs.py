"""The hubs of each source, in crawl order, as a table that pages are joined to by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.sources.specs import AMEX_HUBS, BASE_URLS, KRUNGSRI_HUBS, KTC_HUBS, PROMOTION_URLS

MAIN = "main"


def hub_rows() -> list[tuple[str, str, int, str]]:
    """(bank, hub_slug, hub_ord, url): a listing page alone is the hub ``main``; KTC's categories follow its main page."""
    rows = [(bank, MAIN, 0, url) for bank, url in PROMOTION_URLS.items() if bank not in ("amex", "krungsri")]
    rows += [("ktc", slug, k, f"{PROMOTION_URLS['ktc']}/{slug}") for k, slug in enumerate(KTC_HUBS, 1)]
    rows += [("amex", slug, k, f"{BASE_URLS['amex']}/th-th/benefits/promotions/{slug}.html") for k, slug in enumerate(AMEX_HUBS)]
    rows += [("krungsri", slug, k, f"{BASE_URLS['krungsri']}/th/promotions/cards/{slug}") for k, slug in enumerate(KRUNGSRI_HUBS)]
    return rows


def hub_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hub_rows(), "bank string, hub_slug string, hub_ord int, url string")


def stamp_hubs(pages: DataFrame) -> DataFrame:
    """``pages`` (bank, url, ...) with hub_slug and hub_ord by address; a query, a fragment and a closing slash
    don't matter. Pages of no hub have a null hub_slug and stand behind the source's hubs.

    The table is a constant of a few rows, so it is broadcast whatever the pages' size."""
    hubs = hub_table(pages.sparkSession).select("hub_slug", "hub_ord", F.col("bank").alias("hub_bank"), F.col("url").alias("hub_url"))
    address = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    last = 1 + max(k for _, _, k, _ in hub_rows())
    return (pages.join(F.broadcast(hubs), (F.col("bank") == F.col("hub_bank")) & (address == F.col("hub_url")), "left")
            .drop("hub_bank", "hub_url").withColumn("hub_ord", F.coalesce("hub_ord", F.lit(last))))
