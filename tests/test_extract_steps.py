"""The steps of the extraction against the functions they stand for, and how often each pattern is in the plan."""
import datetime as dt

from pyspark.sql import functions as F

from promospark.functions import checksum as ck
from promospark.functions import dates as D
from promospark.functions.merchant import merchant_for_spec
from promospark.functions.text import (BAHT_RE, MIN_SPEND_RE, PCT_RE, POINTS_RE, extract_discount, extract_minimum_spend,
                                       normalize_text)
from promospark.functions.urls import source_id_from_url, url_join
from promospark.operators.extract import by_source, normalize_tiles
from promospark.sources.specs import SPECS

COLUMNS = ("bank hub_slug title_raw description_raw date_raw start_raw end_raw href image_raw category_raw page_url merchant_raw slug "
           "item_id").split()
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + (", card_types array<string>, start_epoch double, end_epoch double, "
                                                      "scraped_at timestamp_ntz, ord int, seq bigint")
TEXTS = [
    ("ลด 20% GET 1,200 POINTS at Big Cafe 5", "MIN 3,000 Baht \"quoted\\\" 1 ม.ค. 67 - 31 ก.พ. 67", "/promotion/a/../b?x=/.y#z"),
    ("Cash bacK ๑,๕๐๐ บาท จาก CAFE İST และ", "ขั้นต่ำ 5,000", "/p/one.html?utm=1"),
    ("คืน 300  บาท ร่วมกับ บัตรเครดิต กับ TOPS 9", "ครบ 1000 เท่า", "//cdn.example/x/"),
    ("MINOR FOODS ผ่อน 0% ที่ Krungsri วันที่ 3", "01/02/2024 - 3-4-2024", "rel/./deal.htm/"),
    ("สิทธิพิเศษ 5 POINTs @ K SHOP 5", "5  March 2024 until 2024-1-9", ""),
    ("ที่ CENTRAL WORLD ตั้งแต่ 1", "1 Jan 2024 ถึง 2024-02-30T01:02:03", "https://other.example/q?a=1"),
    ("ab\tc\x07d", "20/2/2024 - ๓ มีนาคม ๒๕๖๗", "?page=2"),
    ("Dining at Le Bistro during May", "1/1/2024 ~ 12 December 2024", "/a./b.htm"),
]


def tiles(spark):
    rows = [(bank, "dining", title, text, text, "2024-02-03", "2024-02-30T00:00:00", href, "/i.png", None, None, None, "", f"id{k}",
             ["b", None, "a\""] if k % 2 else None, None, None, dt.datetime(2026, 3, 1), k, k)
            for bank in SPECS for k, (title, text, href) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def test_steps_equal_the_functions(spark):
    raw = tiles(spark)
    got = normalize_tiles(raw).orderBy("bank", "seq").drop("ord").collect()
    assert len(got) == len(SPECS) * len(TEXTS)

    def html(fn, otherwise=None):
        return by_source(lambda s: F.lit(otherwise) if s.kind == "json" else fn(s))

    t = raw.withColumn("title", normalize_text("title_raw")).withColumn(
        "description", by_source(lambda s: F.col("title") if s.description_from_title else normalize_text("description_raw")))
    t = t.withColumn("href_abs", by_source(lambda s: F.when(F.col("href") != "", url_join(s.promotion_url, F.col("href"))).otherwise("")))
    t = t.withColumn("disc", by_source(lambda s: extract_discount(F.concat(
        F.col("title_raw") if s.discount_on_raw_title else F.col("title"), F.lit(" "), F.col("description")))))
    t = t.withColumn("dates", html(lambda s: D.date_range(F.col("description" if s.date_from_description else "date_raw"), s)))
    want = t.select(
        "bank", html(lambda s: merchant_for_spec(s, "title", "description")).alias("merchant"), "disc.*",
        html(lambda s: extract_minimum_spend(F.concat("title", F.lit(" "), "description"))).alias("spend"),
        html(lambda s: source_id_from_url(F.col("href_abs"), F.col("title"), s.strip_query, s.strip_html_ext, s.id_fallback_len)).alias("sid"),
        "dates.*", "seq").orderBy("bank", "seq").collect()
    for g, w in zip(got, want):
        assert (g.bank, g.seq, g.discount_type, g.discount_value) == (w.bank, w.seq, w.discount_type, w.discount_value)
        if SPECS[g.bank].kind == "html":
            assert (g.merchant_name, g.minimum_spend, g.source_id) == (w.merchant, w.spend, w.sid), g
            assert (g.start_date, g.end_date) == (w.start_date, w.end_date), g
    again = normalize_tiles(raw).withColumn("_again", ck.checksum()).select("checksum", "_again").collect()
    assert all(r[0] == r[1] for r in again)


def plan_text(spark, df):
    shown = {"spark.sql.maxPlanStringLength": "10000000", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in shown}
    try:
        for k, v in shown.items():
            spark.conf.set(k, v)
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_each_pattern_is_in_the_plan_once(spark):
    plan = plan_text(spark, normalize_tiles(tiles(spark)))
    for pattern in (PCT_RE, POINTS_RE, BAHT_RE, MIN_SPEND_RE):
        assert plan.count(", " + pattern + ", 1)") == 1, pattern
    assert plan.count("concat_ws(, ") == 1  # the scan that tells whether any text needs escaping


def test_titles_are_worked_out_once(spark):
    from conftest import SF
    from promospark.plans import ingest as I
    from promospark.sources.feeds import TEMPLATES
    plan = plan_text(spark, normalize_tiles(I.snapshot_tiles(spark, SF, 2)))
    # The filter of short titles neither stands in the join nor repeats the title there.
    assert plan.count(TEMPLATES[7][0]) == 1 and plan.count("Unknown source") == 1


def test_lower_case_is_made_for_the_rules_that_read_it(spark):
    from promospark.functions.text import discount_steps
    texts = ["ลด 5% MIN 300 BAHT", "GET 20 POINTS", "CASH BACK 30 Baht", "MINIMUM 1,000", "ฟรี", "0 %", None]
    df = spark.createDataFrame([(t, b) for t in texts for b in (True, False)], "t string, b boolean")
    got = D.apply_steps(df, discount_steps(F.col("t"), F.col("b")))
    want = extract_discount("t")
    bad = got.where(~F.col("discount_type").eqNullSafe(want["discount_type"]) | ~F.col("discount_value").eqNullSafe(want["discount_value"])
                    | ~F.col("minimum_spend").eqNullSafe(F.when(F.col("b"), extract_minimum_spend("t"))))
    assert got.count() == 2 * len(texts) and bad.count() == 0
    plan = plan_text(spark, D.apply_steps(df, discount_steps(F.col("t"), F.col("b"))))
    assert "lower(t" not in plan.replace("THEN lower(t", "")


def test_first_seen_carries_its_own_columns_alone(spark):
    from conftest import SF
    from promospark.plans.catalog import REGISTRY
    for name in ("first_seen", "html_first_seen"):
        plan = plan_text(spark, REGISTRY[name][0](spark, SF))
        assert "AS raw_data" not in plan and "AS id#" not in plan, name


def test_numeric_dates_need_no_formatter(spark):
    texts = [f"{a}{s}{b}{s}{c}" for s in "/-" for a in ("1", "29", "31", "0000", "2024") for b in ("02", "2", "13", "0")
             for c in ("2023", "2024", "0000", "9999", "29", "30", "1", "12345")] + [" 1/2/2024 ", "1/2/2024\n", "๑/๒/๒๐๒๔", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt, pattern in ((D.FMT_DMY_SLASH, "d/M/yyyy"), (D.FMT_DMY_DASH, "d-M-yyyy"), (D.FMT_YMD, "yyyy-M-d")):
        stripped = F.regexp_replace("t", r"^\s+|\s+$", "")
        want = F.when(stripped.rlike(D._SHAPES[fmt]), F.try_to_date(stripped, pattern))
        got = df.select(F.unix_date(D.format_date("t", fmt)).alias("got"), F.unix_date(want).alias("want"))
        assert got.where("got IS NOT NULL").count() > 5 and got.where("NOT got <=> want").count() == 0, fmt
    plan = plan_text(spark, normalize_tiles(tiles(spark)))
    assert "d/M/yyyy" not in plan and "d-M-yyyy" not in plan


def test_plain_text_is_normalised_as_any_text(spark):
    from promospark.sources.specs import WS_CLASS, ZERO_WIDTH_CLASS
    texts = ["a b", " a  b ", "ก ข", "a\tb", "a b", "a​b", "　a", "a ​ b", "é", "", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.trim(F.regexp_replace(F.regexp_replace("t", ZERO_WIDTH_CLASS, ""), WS_CLASS + "+", " "))
    assert df.where(~normalize_text("t").eqNullSafe(want)).count() == 0
    assert df.where(~D._strip(F.col("t")).eqNullSafe(D._strip_any(F.col("t")))).count() == 0


def test_snapshots_are_stored_apart(spark):
    from conftest import SF
    from promospark.plans import ingest as I
    from promospark.plans.store import TableStore, input_fingerprint
    snaps = I.feed_snapshots(spark, SF)
    versions = TableStore(spark).versions("feed_snapshots_" + input_fingerprint(spark, SF, ["lineitem", "part"]))
    assert [(v["batch_id"], v["tag"]) for v in versions] == [("extract-1", "1"), ("extract-2", "2")]
    assert versions[0]["path"] not in "".join(snaps.where("snap = 2").inputFiles())
    assert {r.snap: r["count"] for r in snaps.groupBy("snap").count().collect()} == {
        snap: normalize_tiles(I.snapshot_tiles(spark, SF, snap)).count() for snap in (1, 2)}
