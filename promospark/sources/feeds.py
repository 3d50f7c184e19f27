"""Feeds: the input tables projected onto the promotion / run / page concepts.

The input tables hold no promotions, so they are projected:

* promo tiles: ``lineitem`` joined to ``part``; one tile per line item. The
  source is the ``l_suppkey % 7``-th registered source, the tile text is one of
  the TEMPLATES below filled with part and line values, the date slot is the
  ship date written in one of four date styles, the link and image are derived
  from the keys. Exact and keyed duplicates occur naturally (repeated
  ``(l_orderkey, l_linenumber)``) and through link-less tiles whose id falls
  back to their title.
* run events: ``events`` rows become start/finish audit events per source.
* page snapshots: ``pages`` rows are page snapshots (see operators.tiles).

Everything is a lazy projection of the scans, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.functions.dates import ENGLISH_MONTH_ABBR, THAI_MONTH_ABBR, THAI_MONTH_FULL
from promospark.session import spread
from promospark.sources.specs import AMEX_HUBS, KRUNGSRI_HUBS, KTC_HUBS, SOURCE_NAMES
from promospark.sources.tables import read_table

# Tile-title templates. Tokens: N = upper(p_name), Nc = p_name with a capital
# first letter, d = discount percent, q = quantity, qK = K * quantity.
TEMPLATES = [
    ["รับส่วนลด ", "d", "% ที่ ", "N", " ตั้งแต่ ", "q100", " บาท"],
    ["รับเงินคืน ", "q10", " บาท เมื่อช้อปครบ ", "q100", " บาท"],
    ["รับ ", "q100", " คะแนน ร่วมกับ ", "N", " ทุกสาขา"],
    ["ลด ", "q", ",000 บาท ที่ บัตรเครดิต ตั้งแต่ 5"],
    ["Get ", "q", " points minimum ", "q20", " baht"],
    ["  ", "N", "   ผ่อน 0%  "],
    ["สิทธิพิเศษสำหรับสมาชิก"],
    ["แลกรับบัตรกำนัล จาก ", "N", " ", "q", " ใบ"],
    ["ส่วนลด ", "d", "% กับ ", "N", " เมื่อใช้จ่าย ", "q100", " บาท"],
    ["Enjoy ", "d", "% cashback at ", "Nc", " until end of month"],
    ["ผ่อน 0% 10 เดือน @ ", "N"],
    ["ส่วนลด ", "d", "% ที่ ", "Nc", " และร้านค้าที่ร่วมรายการ"],
]
LINKLESS_TEMPLATE = 6          # tiles of this template carry no link
HUB_LISTS = {"amex": AMEX_HUBS, "krungsri": KRUNGSRI_HUBS, "ktc": KTC_HUBS}
CARD_EXTRA = "Platinum"

TILE_ORDER = ["hub_ord", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]


def _token(tok: str) -> Column:
    q = F.col("l_quantity").cast("int")
    values = {
        "N": F.upper(F.col("p_name")),
        "Nc": F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 20)),
        "d": F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        "q": q.cast("string"),
        "q10": (q * 10).cast("string"),
        "q20": (q * 20).cast("string"),
        "q100": (q * 100).cast("string"),
    }
    return values[tok] if tok in values else F.lit(tok)


def tile_title(template_idx: Column) -> Column:
    out = None
    for i, parts in enumerate(TEMPLATES):
        val = F.concat(*[_token(t) for t in parts])
        out = F.when(template_idx == i, val) if out is None else out.when(template_idx == i, val)
    return out


def _date_text(start: Column, end: Column, variant: Column) -> Column:
    """Ship date range in one of four styles: Thai abbreviated (BE year),
    Thai full month with two-digit BE year, DD/MM/YYYY with a period prefix,
    English abbreviated month with 'until'."""
    abbr = F.array(*[F.lit(m) for m in THAI_MONTH_ABBR])
    full = F.array(*[F.lit(m) for m in THAI_MONTH_FULL])
    eng = F.array(*[F.lit(m) for m in ENGLISH_MONTH_ABBR])

    def pick(arr, d):
        return F.element_at(arr, F.month(d))

    def thai_abbr(d):
        return F.concat_ws(" ", F.dayofmonth(d).cast("string"), pick(abbr, d),
                           (F.year(d) + 543).cast("string"))

    def thai_full(d):
        return F.concat_ws(" ", F.dayofmonth(d).cast("string"), pick(full, d),
                           ((F.year(d) + 543) % 100).cast("string"))

    def slash(d):
        return F.date_format(d, "dd/MM/yyyy")

    def english(d):
        return F.concat_ws(" ", F.dayofmonth(d).cast("string"), pick(eng, d),
                           F.year(d).cast("string"))

    return (F.when(variant == 0, F.concat(thai_abbr(start), F.lit(" - "), thai_abbr(end)))
            .when(variant == 1, F.concat(thai_full(start), F.lit(" ถึง "), thai_full(end)))
            .when(variant == 2, F.concat(F.lit("ระยะเวลา: "), slash(start), F.lit(" - "), slash(end)))
            .otherwise(F.concat(english(start), F.lit(" until "), english(end))))


def _json_date_text(d: Column, variant: Column) -> Column:
    return (F.when(variant == 2, F.date_format(d, "dd/MM/yyyy"))
            .when(variant == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00")))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))


def promo_tiles(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Raw promotion tiles (one per line item) with the columns the extractor reads:
    bank, hub_slug, hub_ord, tile ordering columns, title_raw, description_raw,
    date_raw, start_raw, end_raw, href, image_raw, category_raw, card_types, scraped_at.
    """
    li = spread(lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"))
    p = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # Equi join on the part key; Catalyst/AQE choose broadcast vs shuffle from
    # measured sizes (part is ~1/30 of lineitem, so at scale it is a shuffle join).
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")

    bank = F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]),
                        (F.col("l_suppkey") % len(SOURCE_NAMES)).cast("int") + 1)
    hub_ord = (F.col("p_size") % 4).cast("int")
    ktc_ord = (F.col("p_size") % len(KTC_HUBS)).cast("int")
    hub_slug = (F.when(F.col("bank") == "amex", F.element_at(F.array(*map(F.lit, AMEX_HUBS)), hub_ord + 1))
                .when(F.col("bank") == "krungsri",
                      F.element_at(F.array(*map(F.lit, KRUNGSRI_HUBS)), hub_ord + 1))
                .when(F.col("bank") == "ktc", F.element_at(F.array(*map(F.lit, KTC_HUBS)), ktc_ord + 1))
                .otherwise(F.lit("main")))
    hub_ord_col = (F.when(F.col("bank") == "ktc", ktc_ord)
                   .when(F.col("bank").isin("amex", "krungsri"), hub_ord).otherwise(F.lit(0)))
    template = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(TEMPLATES)).cast("int")
    variant = (F.col("l_partkey") % 4).cast("int")
    start = F.to_date("l_shipdate")
    end = F.date_add(start, F.col("l_quantity").cast("int"))
    key = F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("-"),
                   F.col("l_linenumber").cast("string"))
    href = F.concat(F.lit("/promotion/"), key,
                    F.when(F.col("l_linenumber") % 2 == 0, F.lit(".html")).otherwise(F.lit("")),
                    F.when(F.col("l_linenumber") % 3 == 0, F.lit("?utm_source=feed")).otherwise(F.lit("")))
    size3 = F.col("p_size") % 3
    image = (F.when(size3 == 0, F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")))
             .when(size3 == 1, F.concat(F.lit("https://cdn.example.com/"), F.col("p_partkey").cast("string"),
                                        F.lit(".png")))
             .otherwise(F.lit("")))
    cards = (F.when(size3 == 0, F.array().cast("array<string>"))
             .when(size3 == 1, F.array(F.col("p_brand")))
             .otherwise(F.array(F.col("p_brand"), F.lit(CARD_EXTRA))))
    return (j.withColumn("bank", bank)
            .withColumn("template", template)
            .select(
                "bank",
                hub_slug.alias("hub_slug"),
                hub_ord_col.alias("hub_ord"),
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice", "l_discount", "l_shipdate",
                key.alias("item_id"),
                tile_title(F.col("template")).alias("title_raw"),
                _date_text(start, end, variant).alias("description_raw"),
                _date_text(start, end, variant).alias("date_raw"),
                _json_date_text(start, variant).alias("start_raw"),
                _json_date_text(end, variant).alias("end_raw"),
                F.when(F.col("template") == LINKLESS_TEMPLATE, F.lit("")).otherwise(href).alias("href"),
                image.alias("image_raw"),
                F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).alias("category_raw"),
                cards.alias("card_types"),
                F.col("l_shipdate").alias("scraped_at"),
                F.lit(None).cast("string").alias("page_url"),
                F.lit(None).cast("string").alias("merchant_raw"),
                F.lit(None).cast("string").alias("slug"),
                F.lit(None).cast("double").alias("start_epoch"),
                F.lit(None).cast("double").alias("end_epoch"),
            )
            .withColumn("ord", F.struct(*TILE_ORDER))
            .withColumn("seq", F.col("hub_ord").cast("long") * (1 << 44)
                        + F.col("l_orderkey") * 8 + F.col("l_linenumber")))


def load_promo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promo_tiles(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part"))


# ------------------------------------------------------------------ run feed
def run_events(events: DataFrame) -> DataFrame:
    """Audit events of scrape runs: every ``events`` row is one run of the
    ``user_id % 7``-th source. It emits a start event ('running'); runs that are
    not still running also emit a finish event ``value`` seconds later with the
    final status ('error' -> failed, other types -> success) and counts."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    bank = F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]),
                        (F.col("user_id") % len(SOURCE_NAMES)).cast("int") + 1)
    k = F.get_json_object("props", "$.k").cast("int")
    status = (F.when(F.col("event_type") == "error", F.lit("failed"))
              .when(F.col("event_type") == "signup", F.lit("running"))
              .otherwise(F.lit("success")))
    base = e.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("id"),
        bank.alias("bank"), F.col("ts").alias("started_at"), status.alias("final_status"), k.alias("k"),
        F.col("value"))
    start = base.select("id", "bank", "started_at", F.col("started_at").alias("event_time"),
                        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
                        F.lit("running").alias("status"), F.lit(0).alias("promotions_found"),
                        F.lit(0).alias("promotions_new"), F.lit(0).alias("promotions_updated"),
                        F.lit(None).cast("string").alias("error_message"))
    fin_time = F.col("started_at") + F.expr("make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))")
    ok = F.col("final_status") == "success"
    finish = base.filter(F.col("final_status") != "running").select(
        "id", "bank", "started_at", fin_time.alias("event_time"), fin_time.alias("finished_at"),
        F.col("final_status").alias("status"),
        F.when(ok, F.col("k")).otherwise(0).alias("promotions_found"),
        F.when(ok, F.col("k") % 5).otherwise(0).alias("promotions_new"),
        F.when(ok, F.col("k") % 3).otherwise(0).alias("promotions_updated"),
        F.when(~ok, F.concat(F.lit("fetch failed after "),
                             F.floor("value").cast("bigint").cast("string"), F.lit("s")))
        .alias("error_message"))
    return start.unionByName(finish)


def load_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events(read_table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ payload feed
def _js(s: Column) -> Column:
    return F.concat(F.lit('"'), s, F.lit('"'))


def payload_item_json(p: DataFrame) -> DataFrame:
    """One JSON promotion item per part row, in one of four field-naming styles
    (``p_partkey % 4``): id/slug/_id, title/name, description/short_description,
    image object/thumbnail/string/cover_image object, category object/string,
    card types as objects/string/list, merchant object/name/absent, dates as ISO,
    ISO-with-time, epoch milliseconds or DD/MM/YYYY."""
    pk = F.col("p_partkey").cast("string")
    v = (F.col("p_partkey") % 4).cast("int")
    slug = F.concat(F.lower(F.regexp_replace("p_name", " ", "-")), F.lit("-"), pk)
    title = F.concat(F.lit("ส่วนลด "), F.col("p_size").cast("string"), F.lit("% "), F.upper("p_name"))
    desc = F.concat(F.lit("สำหรับ "), F.col("p_type"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    end = F.date_add(start, 30)

    def iso(d):
        return F.date_format(d, "yyyy-MM-dd")

    def epoch(d):
        # midnight UTC of the date, in epoch milliseconds
        return (F.unix_date(d).cast("long") * F.lit(86_400_000)).cast("string")

    pieces = [
        F.when(v != 3, F.concat(F.lit('"id": '), _js(F.concat(F.lit("pp"), pk))))
        .otherwise(F.concat(F.lit('"_id": '), _js(F.concat(F.lit("x"), pk)))),
        F.concat(F.lit('"slug": '), _js(slug)),
        F.concat(F.when(v == 1, F.lit('"name": ')).otherwise(F.lit('"title": ')), _js(title)),
        F.concat(F.when(v == 2, F.lit('"short_description": ')).otherwise(F.lit('"description": ')), _js(desc)),
        (F.when(v == 0, F.concat(F.lit('"image": {"url": '), _js(F.concat(F.lit("/img/"), pk, F.lit(".jpg"))),
                                 F.lit("}")))
         .when(v == 1, F.concat(F.lit('"thumbnail": '),
                                _js(F.concat(F.lit("https://cdn.example.com/"), pk, F.lit(".png")))))
         .when(v == 2, F.concat(F.lit('"image": '), _js(F.concat(F.lit("/img/"), pk, F.lit(".png")))))
         .otherwise(F.concat(F.lit('"cover_image": {"src": '), _js(F.concat(F.lit("/img/"), pk, F.lit(".gif"))),
                             F.lit("}")))),
        F.when(v % 2 == 0, F.concat(F.lit('"category": {"name": '), _js(F.col("p_type")), F.lit(', "slug": '),
                                    _js(F.lower("p_type")), F.lit("}")))
        .otherwise(F.concat(F.lit('"category": '), _js(F.lower("p_type")))),
        (F.when(v == 0, F.concat(F.lit('"card_types": [{"name": '), _js(F.col("p_brand")),
                                 F.lit('}, {"name": "Platinum"}]')))
         .when(v == 1, F.concat(F.lit('"card_types": '), _js(F.col("p_brand"))))
         .when(v == 2, F.concat(F.lit('"cards": ['), _js(F.col("p_brand")), F.lit(', "Platinum"]')))),
        (F.when(v == 0, F.concat(F.lit('"merchant": {"name": '), _js(F.upper("p_name")), F.lit("}")))
         .when(v == 1, F.concat(F.lit('"merchantName": '), _js(F.col("p_brand"))))),
        (F.when(v == 0, F.concat(F.lit('"start_date": '), _js(iso(start)), F.lit(', "end_date": '), _js(iso(end))))
         .when(v == 1, F.concat(F.lit('"startDate": '), _js(F.concat(iso(start), F.lit("T00:00:00"))),
                                F.lit(', "endDate": '), _js(F.concat(iso(end), F.lit("T00:00:00")))))
         .when(v == 2, F.concat(F.lit('"startDate": '), epoch(start), F.lit(', "endDate": '), epoch(end)))
         .otherwise(F.concat(F.lit('"start_date": '), _js(F.date_format(start, "dd/MM/yyyy"))))),
    ]
    item = F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))
    return p.select("p_partkey", item.alias("item"))


PAYLOAD_ITEMS = 20      # items per payload (bounded group size)
PAYLOAD_SHAPES = 6


def payload_documents(part: DataFrame) -> DataFrame:
    """Captured payloads: part items grouped ``PAYLOAD_ITEMS`` at a time (a bounded
    ``collect_list``), wrapped in one of six shapes. Shapes 0-2 are KTC pages
    with embedded ``__NEXT_DATA__`` (promotions / data.promotions behind an empty
    list / first list under pageProps); 3-5 are CardX API bodies (data.items,
    results, GraphQL edges)."""
    items = payload_item_json(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    grouped = (items.withColumn("payload_id", (F.col("p_partkey") / PAYLOAD_ITEMS).cast("long"))
               .groupBy("payload_id")
               .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("its")))
    arr = F.concat(F.lit("["), F.array_join(F.transform("its", lambda x: x["item"]), ", "), F.lit("]"))
    edges = F.concat(F.lit("["), F.array_join(
        F.transform("its", lambda x: F.concat(F.lit('{"node": '), x["item"], F.lit("}"))), ", "), F.lit("]"))
    shape = (F.col("payload_id") % PAYLOAD_SHAPES).cast("int")

    def page(body):
        return F.concat(F.lit('<html><head><script id="__NEXT_DATA__" type="application/json">'), body,
                        F.lit("</script></head><body></body></html>"))
    doc = (F.when(shape == 0, page(F.concat(F.lit('{"props": {"pageProps": {"promotions": '), arr, F.lit("}}}"))))
           .when(shape == 1, page(F.concat(F.lit('{"props": {"pageProps": {"promotions": [], "data": {"promotions": '),
                                            arr, F.lit("}}}}"))))
           .when(shape == 2, page(F.concat(F.lit('{"props": {"pageProps": {"meta": {"n": 1}, "featured": '),
                                            arr, F.lit("}}}"))))
           .when(shape == 3, F.concat(F.lit('{"data": {"items": '), arr, F.lit('}, "meta": {"total": 0}}')))
           .when(shape == 4, F.concat(F.lit('{"results": '), arr, F.lit("}")))
           .otherwise(F.concat(F.lit('{"data": {"allPromos": {"edges": '), edges, F.lit("}}}"))))
    return grouped.select(F.when(shape <= 2, F.lit("ktc")).otherwise(F.lit("cardx")).alias("bank"),
                          F.col("payload_id").alias("seq"), doc.alias("payload"))


def load_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_documents(read_table(spark, sf_dir, "part"))
