"""Tile / item normalisation: raw extracted fields -> promotion rows.

One projection serves every source: each spec-dependent column is a CASE over
the row's source whose branches are the spec's native expressions (T1-T6,
M1-M7, D-1..D-10, X8, X10-X13, P2, P3, J11, J12). Only the matching branch is
evaluated per row. The projection is larger than whole-stage code allows, so Spark runs
it as generated expressions of its own.
"""

from __future__ import annotations

import weakref
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.functions import checksum as ck
from promospark.functions import dates as D
from promospark.functions.merchant import merchant_candidates, merchant_of
from promospark.functions.text import discount_steps, normalize_text
from promospark.functions.urls import absolutize_image, id_or_title, id_segment, url_join
from promospark.sources.specs import SPECS, SourceSpec

PROMOTION_COLUMNS = [
    "id", "bank", "source_id", "source_url", "title", "description", "image_url", "card_types",
    "category", "merchant_name", "discount_type", "discount_value", "minimum_spend",
    "start_date", "end_date", "terms_and_conditions", "raw_data", "checksum", "scraped_at",
]

JSON_URL_PATHS = {"ktc": "/promotion/", "cardx": "/credit-card/promotion/"}


def by_source(fn: Callable[[SourceSpec], Column], source: str = "bank") -> Column:
    """CASE source WHEN name THEN fn(spec) ... over all registered specs."""
    out = None
    for name, spec in SPECS.items():
        cond = F.col(source) == name
        out = F.when(cond, fn(spec)) if out is None else out.when(cond, fn(spec))
    return out


def source_number(source: str = "bank") -> Column:
    """The place of the source among the registered specs, to be compared instead of its name; null: unknown."""
    return F.coalesce(*(F.when(F.col(source) == name, F.lit(k)) for k, name in enumerate(SPECS)))


def of_row(fn: Callable[[SourceSpec], Column]) -> Column:
    """``by_source`` by the column ``_source`` that holds ``source_number``."""
    out = None
    for k, spec in enumerate(SPECS.values()):
        cond = F.col("_source") == k
        out = F.when(cond, fn(spec)) if out is None else out.when(cond, fn(spec))
    return out


def unknown_source_error() -> Column:
    """Fails the job that reads a row of a source without spec; nothing is written then."""
    return F.raise_error(F.concat(F.lit("Unknown source '"), F.coalesce("bank", F.lit("null")),
                                  F.lit("'. Available: " + ", ".join(SPECS)))).cast("boolean")


def promotion_id(bank: Column, source_id: Column) -> Column:
    """Deterministic surrogate id for a natural key."""
    return F.sha2(F.concat_ws("/", bank, source_id), 256)


# Keyed by the context object itself, so that a stopped context's entry can't serve another one.
_RECIPES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def normalize_tiles(tiles: DataFrame, keep: tuple = ()) -> DataFrame:
    """Raw tiles/items -> promotion rows (plus the ``ord`` / ``seq`` order columns).

    Expected input columns: bank, hub_slug, title_raw, description_raw, date_raw,
    start_raw, end_raw, href, image_raw, category_raw, card_types, scraped_at,
    item_id, ord (struct, total tile order), seq (bigint, coarse order).

    The Column expressions do not depend on the input, so they are built once per
    SparkContext (building them costs thousands of JVM calls) and reused.
    """
    sc = tiles.sparkSession.sparkContext
    if sc not in _RECIPES:
        _RECIPES[sc] = _build_recipe()
    steps, final, checksum = _RECIPES[sc]
    # The whole captured item, where the feed has it, is kept as raw_data.
    df = tiles if "raw_item" in tiles.columns else tiles.withColumn("raw_item", F.lit(None).cast("string"))
    df = D.apply_steps(df, steps).select(*final, *keep)
    return D.apply_steps(df, checksum)


def _build_recipe():
    title = normalize_text("title_raw")

    def description(spec):
        return title if spec.description_from_title else normalize_text("description_raw")

    def href_abs(spec):
        base = F.coalesce(F.col("page_url"), F.lit(spec.promotion_url))
        return F.when(F.col("href") != "", url_join(base, F.col("href"))).otherwise(F.lit(""))

    def segment(spec):
        return F.lit(None).cast("string") if spec.kind == "json" else id_segment(
            F.col("href_abs"), spec.strip_query, spec.strip_html_ext)

    def source_id(spec):
        if spec.kind == "json":
            return F.col("item_id")
        return id_or_title("href_abs", "_segment", F.col("title"), spec.strip_query, spec.id_fallback_len)

    def source_url(spec):
        if spec.kind == "json":
            return F.concat(F.lit(spec.base_url + JSON_URL_PATHS[spec.name]),
                            F.coalesce(F.nullif(F.col("slug"), F.lit("")), F.col("item_id")))
        return F.when(F.col("href_abs") != "", F.col("href_abs")).otherwise(F.lit(spec.promotion_url))

    def image(spec):
        img = F.nullif(F.col("image_raw"), F.lit(""))
        return img if spec.name == "cardx" else absolutize_image(img, spec.base_url)

    def category(spec):
        raw = F.nullif(F.col("category_raw"), F.lit(""))
        if spec.hub_category_mode == "never":
            return F.lit(None).cast("string")
        if spec.hub_category_mode == "none":
            return raw
        hub_map = F.create_map(*[x for kv in spec.hub_categories.items() for x in map(F.lit, kv)])
        hub_cat = F.try_element_at(hub_map, F.col("hub_slug"))
        if spec.hub_category_mode == "always":
            return F.coalesce(hub_cat, F.col("hub_slug"))
        return F.coalesce(raw, hub_cat)

    def discount_text(spec):
        head = F.col("title_raw") if spec.discount_on_raw_title else F.col("title")
        return F.concat(head, F.lit(" "), F.col("description"))

    # The rules of spend read the title, those of discount the raw title of some sources; none needs both.
    assert not any(spec.minimum_spend and spec.discount_on_raw_title for spec in SPECS.values())
    def sources(having: Callable[[SourceSpec], bool]) -> Column:
        return F.col("_source").isin(*(k for k, spec in enumerate(SPECS.values()) if having(spec)))

    spends = sources(lambda spec: spec.minimum_spend)
    thai = sources(lambda spec: spec.thai_dates)

    def uses(fmt: str) -> Column:
        return sources(lambda spec: fmt in spec.date_formats)

    def date_text(spec):
        if spec.kind == "json":
            return F.coalesce(F.col("start_raw"), F.lit(""))
        t = F.col("description") if spec.date_from_description else F.col("date_raw")
        if spec.date_prefix:
            t = D._strip(F.regexp_replace(t, spec.date_prefix, ""))
        return t

    def parts(spec):
        if spec.kind == "json":
            return F.array(F.col("start_raw"), F.col("end_raw"))
        return F.split(F.col("_dtext"), spec.split_regex, 2)

    def start(spec):
        if spec.kind == "json":
            return F.coalesce(D.part_rule(spec, 0), D.epoch_millis_date(F.col("start_epoch")))
        return F.when(F.col("_dtext").isNotNull(), D.part_rule(spec, 0))

    def end(spec):
        if spec.kind == "json":
            return F.coalesce(D.part_rule(spec, 1), D.epoch_millis_date(F.col("end_epoch")))
        return F.when(F.col("_has1"), D.part_rule(spec, 1))

    def candidates(spec):
        if not spec.merchant_patterns:
            return F.lit(None).cast("array<string>")
        return merchant_candidates(spec, F.col("title"), F.col("_mtext"))

    def _merchant(spec):
        if spec.name == "ktc":
            given = F.nullif(F.col("merchant_raw"), F.lit(""))
            return F.when(given.isNotNull(), normalize_text(given)).otherwise(F.col("title"))
        if spec.name == "cardx":
            return F.nullif(F.col("merchant_raw"), F.lit(""))
        return merchant_of(spec, F.col("title"), F.col("_candidates"))

    def cards(spec):
        if spec.kind == "json":
            return F.coalesce(F.col("card_types"), F.array().cast("array<string>"))
        return F.array().cast("array<string>")

    def valid(spec):
        if spec.kind == "json":
            return (F.col("item_id") != "") & (F.col("title_raw") != "")
        return F.length(F.col("title")) >= spec.min_title_len

    def raw_data(spec):
        if spec.kind == "json":
            return F.coalesce("raw_item", F.to_json(F.struct(F.col("item_id").alias("id"), F.col("title_raw").alias("title"))))
        title = F.col("title")
        written = F.to_json(F.struct(F.lit(True).alias("html_source"), title.alias("title")))
        # Text without anything to escape needs no JSON writer.
        return F.when(~title.rlike(ck._NEEDS_ESCAPE), F.concat(F.lit('{"html_source":true,"title":"'), title, F.lit('"}'))).otherwise(written)

    # Filters don't pass a column that isn't deterministic. Else the whole title, as the input makes it, would be worked
    # out in the filter (in the join, where there is one) several times over, and once more for the rows kept.
    source = F.when(F.spark_partition_id() >= 0, source_number())
    steps = [("cols", {"title": title, "_source": source}),
             ("filter", of_row(valid).otherwise(unknown_source_error())),
             ("cols", {"description": of_row(description), "href_abs": of_row(href_abs)})]
    ids = [("cols", {"_segment": of_row(segment)}),
           ("cols", {"source_id": of_row(source_id), "source_url": of_row(source_url)}),
           ("drop", ["_segment", "href_abs"])]
    merchants = [("cols", {"_mtext": F.trim(F.concat_ws(" ", "title", "description"))}),
                 ("cols", {"_candidates": of_row(candidates)}),
                 ("cols", {"merchant_name": of_row(_merchant)}),
                 ("drop", ["_mtext", "_candidates"])]
    dates = D.split_steps(of_row(date_text), of_row(parts)) + D.side_by_side(
        D.part_parse_steps(0, "_p0", thai, uses), D.part_parse_steps(1, "_p1", thai, uses))
    dates += [("cols", {"_start": of_row(start), "_end": of_row(end)}), ("drop", D.DATE_WORK_COLUMNS)]
    # Columns that need nothing but the tile come first, so that what they are made from need not be carried on.
    direct = [("cols", {"image_url": of_row(image), "card_types": of_row(cards), "category": of_row(category),
                        "raw_data": of_row(raw_data)})]
    steps += D.side_by_side(direct, ids, merchants, discount_steps(of_row(discount_text), spends), dates)
    final = [
        promotion_id(F.col("bank"), F.col("source_id")).alias("id"),
        *[F.col(c) for c in ("bank", "source_id", "source_url", "title", "description")],
        *[F.col(c) for c in ("image_url", "card_types", "category")],
        *[F.col(c) for c in ("merchant_name", "discount_type", "discount_value", "minimum_spend")],
        F.col("_start").alias("start_date"),
        F.col("_end").alias("end_date"),
        F.lit(None).cast("string").alias("terms_and_conditions"),
        F.col("raw_data"),
        F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"),
        F.col("ord"), F.col("seq"),
    ]
    # What the checksum needs first is worked out beside these columns; its one text without a column yet is null.
    (_, ready), *checksum = ck.checksum_steps({"terms_and_conditions": F.lit(None).cast("string")})
    return steps, final + [c.alias(name) for name, c in ready.items()], checksum
