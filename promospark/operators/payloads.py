"""JSON payload extraction (J1-J12) over VARIANT.

Payloads (KTC pages with embedded ``__NEXT_DATA__``, CardX API bodies) are
parsed with ``try_parse_json`` (malformed -> null), the item list is located
by the source's ordered path rules, exploded with its position, and every
field is read through the source's alias list with Python-style falsy
fall-through (null, empty string, 0, empty list/object). Object-valued fields
are unwrapped to their name/url. The result has the generic tile columns read
by ``operators.extract.normalize_tiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.sources.specs import KTC_HUBS

NEXT_DATA_RE = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'

# Item-list locations and field aliases, in lookup order.
KTC_LIST_PATHS = ["$.props.pageProps.promotions", "$.props.pageProps.data.promotions",
                  "$.props.pageProps.initialData.promotions", "$.props.pageProps.items"]
KTC_FIRST_LIST_KEYS = ["title", "name", "slug", "id"]
CARDX_WRAPPERS = ["data", "results", "items", "promotions", "content"]
CARDX_INNER = ["items", "promotions", "results", "edges", "nodes"]

ALIASES = {
    "ktc": {
        "id": ["id", "slug", "_id"], "title": ["title", "name"],
        "description": ["description", "short_description"],
        "image": ["image", "thumbnail", "cover_image"], "category": ["category", "type"],
        "cards": ["card_types", "cards"], "merchant": ["merchant_name", "merchantName", "merchant", "brand"],
        "start": ["start_date", "startDate"], "end": ["end_date", "endDate"], "slug": ["slug"],
    },
    "cardx": {
        "id": ["id", "promotionId", "slug"], "title": ["title", "name", "promotionName"],
        "description": ["description", "shortDescription"],
        "image": ["image", "imageUrl", "thumbnail", "coverImage"], "category": ["category", "categoryName"],
        "cards": ["cardTypes", "cards"], "merchant": ["merchantName", "merchant"],
        "start": ["startDate", "start_date"], "end": ["endDate", "end_date"], "slug": ["slug", "urlSlug"],
    },
}


def _path(key: str) -> str:
    return "$." + key if key.isidentifier() else f"$['{key}']"


def _truthy(v: Column) -> Column:
    """v (variant) if it isn't null, false, zero, or an empty string, list or object. The type
    decides, so the strings "0", "false" and "[]" count as given."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    empty = (F.when(kind == "STRING", text == "")
             .when(kind == "BOOLEAN", text == "false")
             .when(kind.startswith("ARRAY"), text == "[]")
             .when(kind.startswith("OBJECT"), text == "{}")
             .otherwise(F.try_variant_get(v, "$", "double") == 0.0))
    return F.when(text.isNotNull() & ~F.coalesce(empty, F.lit(False)), v)


def first_truthy(item: Column, keys: list[str]) -> Column:
    """First alias whose value is truthy (as a variant)."""
    return F.coalesce(*[_truthy(F.try_variant_get(item, _path(k), "variant")) for k in keys])


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def unwrap(v: Column, names: list[str]) -> Column:
    """An object is replaced by its first truthy ``names`` field."""
    inner = F.coalesce(*[_truthy(F.try_variant_get(v, _path(n), "variant")) for n in names])
    return F.when(_is_object(v), as_text(inner)).otherwise(as_text(v))


def card_names(v: Column) -> Column:
    """String -> [s]; list -> element names (objects by 'name', else text)."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    names = F.transform(arr, lambda x: F.when(_is_object(x), F.coalesce(
        F.try_variant_get(x, "$.name", "string"), F.to_json(x))).otherwise(as_text(x)))
    return (F.when(v.isNull(), F.array().cast("array<string>"))
            .when(arr.isNotNull(), names)
            .otherwise(F.array(as_text(v))))


def _nonempty_array(v: Column, path: str) -> Column:
    a = F.try_variant_get(v, path, "array<variant>")
    return F.when(F.size(a) > 0, a)


def _first_map_value(json_text: Column, pred) -> Column:
    """Value (JSON text) of the first entry of an object, in input order, that
    satisfies ``pred(variant)``."""
    m = F.from_json(json_text, "map<string,string>")
    hit = F.filter(F.map_entries(m), lambda e: pred(F.try_parse_json(e["value"])))
    return F.try_element_at(hit, F.lit(1))["value"]


def ktc_items(html: Column) -> Column:
    """Embedded JSON, first non-empty known list, else the first list
    under pageProps whose first element has a title/name/slug/id key."""
    nd = F.nullif(F.regexp_extract(html, NEXT_DATA_RE, 1), F.lit(""))
    v = F.try_parse_json(nd)
    known = F.coalesce(*[_nonempty_array(v, p) for p in KTC_LIST_PATHS])

    def looks_like_list(x):
        first = F.try_variant_get(x, "$[0]", "map<string,variant>")
        has = None
        for k in KTC_FIRST_LIST_KEYS:
            c = F.array_contains(F.map_keys(first), F.lit(k))
            has = c if has is None else (has | c)
        return first.isNotNull() & has
    fallback = F.try_variant_get(F.try_parse_json(
        _first_map_value(F.get_json_object(nd, "$.props.pageProps"), looks_like_list)), "$", "array<variant>")
    return F.coalesce(known, fallback)


def cardx_items(payload: Column) -> Column:
    """Bare list; else wrapper keys (list, or inner list); else the first
    ``data`` value (input order) holding ``edges`` (nodes unwrapped) or a list."""
    v = F.try_parse_json(payload)
    cands = [F.try_variant_get(v, "$", "array<variant>")]
    for k in CARDX_WRAPPERS:
        cands.append(F.try_variant_get(v, f"$.{k}", "array<variant>"))
        for inner in CARDX_INNER:
            cands.append(F.try_variant_get(v, f"$.{k}.{inner}", "array<variant>"))

    def edges_or_list(x):
        return (F.try_variant_get(x, "$.edges", "array<variant>").isNotNull()
                | F.try_variant_get(x, "$", "array<variant>").isNotNull())
    hit = F.try_parse_json(_first_map_value(F.get_json_object(payload, "$.data"), edges_or_list))
    edges = F.try_variant_get(hit, "$.edges", "array<variant>")
    graph = F.when(edges.isNotNull(), F.transform(edges, lambda e: F.coalesce(
        F.try_variant_get(e, "$.node", "variant"), e))).otherwise(F.try_variant_get(hit, "$", "array<variant>"))
    return F.coalesce(*cands, graph)


def explode_items(payloads: DataFrame) -> DataFrame:
    """One row per item with its position; ``bank`` selects the rules."""
    items = F.when(F.col("bank") == "ktc", ktc_items(F.col("payload"))).otherwise(cardx_items(F.col("payload")))
    return with_hub(payloads).select("bank", "hub_slug", "hub_ord", "seq", F.posexplode(items).alias("pos", "item"))


def item_fields(items: DataFrame, scraped_at: str = "2026-03-01 06:00:00") -> DataFrame:
    """J7-J12 field extraction to the generic tile columns."""
    def per_source(field_fn):
        return (F.when(F.col("bank") == "ktc", field_fn("ktc"))
                .otherwise(field_fn("cardx")))
    it = F.col("item")

    def text(src, key):
        return as_text(first_truthy(it, ALIASES[src][key]))

    def image(src):
        return unwrap(first_truthy(it, ALIASES[src]["image"]), ["url", "src"])

    def category(src):
        return unwrap(first_truthy(it, ALIASES[src]["category"]), ["name", "slug"])

    def merchant(src):
        names = ["name", "title"] if src == "ktc" else ["name"]
        return unwrap(first_truthy(it, ALIASES[src]["merchant"]), names)

    def cards(src):
        return card_names(first_truthy(it, ALIASES[src]["cards"]))

    def date_text(src, key):
        v = first_truthy(it, ALIASES[src][key])
        return F.when(F.try_variant_get(v, "$", "double").isNull() | F.try_variant_get(v, "$", "string")
                      .rlike("[^0-9.eE+-]"), as_text(v))

    def epoch(src, key):
        if src != "cardx":
            return F.lit(None).cast("double")
        v = first_truthy(it, ALIASES[src][key])
        s = F.try_variant_get(v, "$", "string")
        return F.when(~s.rlike("[^0-9.eE+-]"), F.try_variant_get(v, "$", "double"))

    def slug(src):
        if src == "ktc":
            # a present-but-null slug falls back to the id (corrected quirk)
            return F.try_variant_get(it, "$.slug", "string")
        return text(src, "slug")

    return with_hub(items).select(
        "bank", "hub_slug", "hub_ord",
        F.coalesce(per_source(lambda s: text(s, "id")), F.lit("")).alias("item_id"),
        F.coalesce(per_source(lambda s: text(s, "title")), F.lit("")).alias("title_raw"),
        F.coalesce(per_source(lambda s: text(s, "description")), F.lit("")).alias("description_raw"),
        F.lit("").alias("date_raw"),
        per_source(lambda s: date_text(s, "start")).alias("start_raw"),
        per_source(lambda s: date_text(s, "end")).alias("end_raw"),
        per_source(lambda s: epoch(s, "start")).alias("start_epoch"),
        per_source(lambda s: epoch(s, "end")).alias("end_epoch"),
        F.lit("").alias("href"),
        F.coalesce(per_source(image), F.lit("")).alias("image_raw"),
        per_source(category).alias("category_raw"),
        per_source(cards).alias("card_types"),
        per_source(merchant).alias("merchant_raw"),
        per_source(slug).alias("slug"),
        F.lit(scraped_at).cast("timestamp_ntz").alias("scraped_at"),
        F.lit(None).cast("string").alias("page_url"),
        F.to_json("item").alias("raw_item"),
        F.struct("hub_ord", "seq", "pos").alias("ord"),
        (F.col("seq") * (1 << 20) + F.col("pos")).alias("seq"),
    )


# --------------------------------------------------------------------------
# KTC pages are JSON-first; a page without usable embedded JSON falls
# back to HTML cards (anchors to /promotion/ pages or promotion/card divs, in
# document order; duplicates are left to the first-seen dedup).
# A selector returns an enclosing promotion div and the cards inside it.
KTC_BASE = "https://www.ktc.co.th"

#: Pages without any of these hold no card; attribute values can have characters by number.
MAY_HOLD_CARDS = "promotion|card-item|PromoCard|&#"


def has_next_data(html: Column) -> Column:
    """Embedded JSON present, parseable and truthy."""
    v = F.try_parse_json(F.nullif(F.regexp_extract(html, NEXT_DATA_RE, 1), F.lit("")))
    return _truthy(v).isNotNull()


def ktc_html_cards(pages: DataFrame) -> DataFrame:
    """Cards of pages without embedded JSON -> promotion rows (title = first
    h2/h3/h4/p text, link from the card or its first link, merchant = title).
    C1/P3: a category page's slug is the category, the main page gives none."""
    from promospark.functions.checksum import checksum
    from promospark.functions.text import normalize_text
    from promospark.functions.urls import absolutize_image, last_segment
    from promospark.operators.html_tiles import ktc_cards

    held = with_hub(pages).filter(~has_next_data(F.col("html")) & F.col("html").rlike(MAY_HOLD_CARDS))
    link = F.col("href")
    rows = ktc_cards(held).withColumn("title", normalize_text(F.col("heading"))).filter(F.col("title") != "")
    source_id = F.when(link != "", last_segment(link)).otherwise(F.substring("title", 1, 50))
    out = rows.select(
        F.lit("ktc").alias("bank"), source_id.alias("source_id"),
        F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(KTC_BASE), link)).alias("source_url"),
        "title", F.lit("").alias("description"), absolutize_image(F.col("src"), KTC_BASE).alias("image_url"),
        F.array().cast("array<string>").alias("card_types"),
        F.when(F.col("hub_slug").isin(*KTC_HUBS), F.col("hub_slug")).alias("category"),
        F.col("title").alias("merchant_name"), F.lit(None).cast("string").alias("discount_type"),
        F.lit(None).cast("string").alias("discount_value"), F.lit(None).cast("double").alias("minimum_spend"),
        F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        F.lit(None).cast("string").alias("terms_and_conditions"),
        F.lit('{"html_source": true}').alias("raw_data"),
        F.struct("hub_ord", "seq", "pos").alias("ord"))
    return out.withColumn("checksum", checksum()) \
        .withColumn("id", F.sha2(F.concat_ws("/", F.col("bank"), F.col("source_id")), 256))


def ktc_page_promotions(pages: DataFrame) -> DataFrame:
    """JSON items for pages with embedded JSON, HTML cards for the others,
    concatenated (C1) with their hub, page and tile order kept for the dedup.

    ``pages`` has seq and html, and hub_slug and hub_ord where hubs are known (``sources.hubs``)."""
    from promospark.operators.extract import PROMOTION_COLUMNS, normalize_tiles
    with_json = with_hub(pages).filter(has_next_data(F.col("html"))).select(
        F.lit("ktc").alias("bank"), "hub_slug", "hub_ord", "seq", F.col("html").alias("payload"))
    json_rows = normalize_tiles(item_fields(explode_items(with_json)))
    cols = [c for c in PROMOTION_COLUMNS if c != "scraped_at"] + ["ord"]
    return json_rows.select(*cols).unionByName(ktc_html_cards(pages).select(*cols))


def with_hub(rows: DataFrame) -> DataFrame:
    """``rows`` with hub_slug and hub_ord; rows without them stand first and in no hub."""
    if "hub_slug" not in rows.columns:
        rows = rows.withColumn("hub_slug", F.lit(None).cast("string"))
    return rows if "hub_ord" in rows.columns else rows.withColumn("hub_ord", F.lit(0))
