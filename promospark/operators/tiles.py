"""Tile extraction from page snapshots (S1, X1-X7), re-aimed as one Spark job.

A page snapshot table ``(bank, hub_slug, hub_ord, page_id, url, html)`` is
exploded into tiles with ``regexp_extract_all`` + ``arrays_zip`` +
``posexplode`` (document order kept as ``pos``); when the primary selector
finds no tile on a page, the fallback selector is used for that page (X2).
Slots are read from the tile markup, tags removed with the spec's joiner (X6)
and entities unescaped; the result has the generic tile columns read by
``operators.extract.normalize_tiles``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.sources.specs import SPECS

HTML_SOURCES = [s for s, spec in SPECS.items() if spec.kind == "html"]

# Named entities unescaped in slot text (the common five + nbsp).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


@dataclass(frozen=True)
class TileSelector:
    """Flat-markup tile selector: group 1 = link, group 2 = inner markup."""
    primary: str = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    fallback: str = r"<h1()>([^<]*)</h1>"


def page_snapshots(pages: DataFrame) -> DataFrame:
    """Pages as snapshots of the HTML sources (``page_id`` mod 5 picks the
    source; one hub per source)."""
    bank = F.element_at(F.array(*[F.lit(s) for s in HTML_SOURCES]),
                        (F.col("page_id") % len(HTML_SOURCES)).cast("int") + 1)
    return pages.select(bank.alias("bank"), F.lit("main").alias("hub_slug"), F.lit(0).alias("hub_ord"),
                        "page_id", "url", "html")


def strip_tags(col: Column, joiner: str = "") -> Column:
    """Remove tags, joining text nodes with ``joiner``."""
    return F.regexp_replace(col, "<[^>]*>", joiner)


def unescape(col: Column) -> Column:
    out = col
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def explode_tiles(snapshots: DataFrame, sel: TileSelector = TileSelector()) -> DataFrame:
    """One row per tile with ``pos`` in document order."""
    html = F.col("html")
    prim = F.arrays_zip(F.regexp_extract_all(html, F.lit(sel.primary), 1).alias("href"),
                        F.regexp_extract_all(html, F.lit(sel.primary), 2).alias("inner_html"))
    fb = F.arrays_zip(F.regexp_extract_all(html, F.lit(sel.fallback), 1).alias("href"),
                      F.regexp_extract_all(html, F.lit(sel.fallback), 2).alias("inner_html"))
    chosen = F.when(F.size(prim) > 0, prim).otherwise(fb)
    return (snapshots.select("bank", "hub_slug", "hub_ord", "page_id", "url",
                             F.posexplode(chosen).alias("pos", "tile"))
            .select("bank", "hub_slug", "hub_ord", "page_id", "url", "pos",
                    F.col("tile.href").alias("href"), F.col("tile.inner_html").alias("inner_html")))


def tiles_for_extraction(tiles: DataFrame, scraped_at: str = "2026-03-01 06:00:00") -> DataFrame:
    """Generic tile columns (X5/X6 slot text) for ``normalize_tiles``; links
    resolve against the page URL."""
    joiner = F.when(F.col("bank").isin(*[s for s in HTML_SOURCES if SPECS[s].text_joiner == " "]),
                    F.lit(" ")).otherwise(F.lit(""))
    text = unescape(F.regexp_replace(F.col("inner_html"), "<[^>]*>", joiner))
    return tiles.select(
        "bank", "hub_slug", "hub_ord",
        F.lit("").alias("item_id"),
        text.alias("title_raw"),
        F.lit("").alias("description_raw"), F.lit("").alias("date_raw"),
        F.lit(None).cast("string").alias("start_raw"), F.lit(None).cast("string").alias("end_raw"),
        F.col("href"), F.lit("").alias("image_raw"),
        F.lit(None).cast("string").alias("category_raw"),
        F.array().cast("array<string>").alias("card_types"),
        F.lit(scraped_at).cast("timestamp_ntz").alias("scraped_at"),
        F.col("url").alias("page_url"),
        F.lit(None).cast("string").alias("merchant_raw"), F.lit(None).cast("string").alias("slug"),
        F.lit(None).cast("double").alias("start_epoch"), F.lit(None).cast("double").alias("end_epoch"),
        F.struct("hub_ord", "page_id", "pos").alias("ord"),
        (F.col("page_id") * (1 << 20) + F.col("pos")).alias("seq"),
    )
