"""X8/X9 helpers, key checks, the store and the report sink."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import one
from promospark.functions.urls import absolutize_image, css_background_url, first_nonempty
from promospark.operators.dedup import first_seen, key_duplicates
from promospark.plans.store import TableStore
from promospark.sources.specs import get_spec

import pytest


def test_image_attribute_fallthrough(spark):
    df = spark.createDataFrame([("", None, "/a.png"), ("x.png", "y.png", None), ("", "", "")],
                               "src STRING, data_src STRING, lazy STRING")
    got = [r[0] for r in df.select(absolutize_image(first_nonempty("src", "data_src", "lazy"),
                                                    "https://b.example")).collect()]
    assert got == ["https://b.example/a.png", "x.png", None]


@pytest.mark.parametrize("style,expected", [
    ("background-image: url('/img/a.jpg');", "/img/a.jpg"),
    ('background-image:url( "https://x/y.png" )', "https://x/y.png"),
    ("color: red", None),
])
def test_css_background(spark, style, expected):
    assert one(spark, css_background_url(F.col("s")), style) == expected


def test_unknown_source_raises():
    with pytest.raises(KeyError):
        get_spec("scb")


def test_first_seen_and_key_check(spark):
    df = spark.createDataFrame([("b", "k", 2, "second"), ("b", "k", 1, "first"), ("b", "j", 5, "only")],
                               "bank STRING, source_id STRING, o INT, title STRING")
    got = {r["source_id"]: r["title"] for r in first_seen(df, order="o").collect()}
    assert got == {"k": "first", "j": "only"}
    assert [(r[0], r[1], r[2]) for r in key_duplicates(df).collect()] == [("b", "k", 2)]


def test_store_versions_and_replay(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="store-"))
    a = store.commit("t", spark.range(3), "batch-a")
    b = store.commit("t", spark.range(5), "batch-b")
    again = store.commit("t", spark.range(7), "batch-a")
    assert (a["version"], b["version"], again["version"]) == (1, 2, 1)
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3


def test_report_sink(spark):
    from promospark.plans.report import write_coverage_report
    df = spark.createDataFrame(
        [("1", "uob", None, ["x"], "T1", None), ("2", "uob", "M", [], "T2", None), ("3", None, None, [], " ", None)],
        "id STRING, bank STRING, merchant_name STRING, card_types ARRAY<STRING>, title STRING, "
        "scraped_at TIMESTAMP_NTZ")
    paths = write_coverage_report(df, tempfile.mkdtemp(prefix="report-"))
    cov = spark.read.option("header", True).csv(paths["coverage"]).collect()
    rows = {r["bank"]: (r["total"], r["merchant_null"], r["merchant_null_pct"]) for r in cov}
    assert rows["uob"] == ("2", "1", "50.0%") and rows["unknown"] == ("1", "1", "100.0%")
    assert rows["ALL"] == ("3", "2", "66.7%")
    assert os.path.isdir(paths["samples"])


def test_epoch_dates_ignore_session_time_zone(spark):
    import datetime as dt
    from promospark.functions.dates import epoch_millis_date
    df = spark.createDataFrame([(1704412800000.0,), (1704499199999.0,)], "ms DOUBLE")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Bangkok", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r[0] for r in df.select(epoch_millis_date(df.ms)).collect()]
            assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5)], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_percentages_round_the_double(spark):
    from promospark.operators.aggregates import _pct
    pairs = [(n, d) for d in (1, 3, 7, 8, 16, 40, 80, 400, 2000, 4000, 9999) for n in range(0, d + 1, max(1, d // 37))]
    pairs += [(1, 2000), (3, 2000), (5, 2000), (1, 800), (0, 0), (123456, 10_000_000)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = {(r.n, r.d): r.p for r in df.select("n", "d", _pct(F.col("n"), F.col("d")).alias("p")).collect()}
    assert got == {(n, d): f"{100 * n / d:.1f}%" if d else "—" for n, d in pairs}


def test_month_dates_take_any_white_space(spark):
    from promospark.functions.dates import _parse_stripped
    from promospark.sources.specs import FMT_D_MON_Y, FMT_D_MONTH_Y
    df = spark.createDataFrame([("1  Mar 2026", "1\nMarch\t2026")], "a string, b string")
    row = df.select(_parse_stripped(F.col("a"), FMT_D_MON_Y).alias("a"), _parse_stripped(F.col("b"), FMT_D_MONTH_Y).alias("b")).first()
    assert str(row.a) == str(row.b) == "2026-03-01"
