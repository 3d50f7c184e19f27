"""Golden pairs for the text, merchant, date and URL functions (re-typed by hand)."""
import datetime as dt
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from conftest import one
from promospark.functions import dates as D
from promospark.functions.merchant import merchant_for_spec
from promospark.functions.text import extract_discount, extract_minimum_spend, normalize_text
from promospark.functions.urls import source_id_from_url, url_join
from promospark.sources.specs import SPECS


@pytest.mark.parametrize("text,expected", [
    ("  hello   world  ", "hello world"),
    ("test​text", "testtext"),
    ("a 　b\x1fc", "a b c"),
])
def test_normalize(spark, text, expected):
    assert one(spark, normalize_text("s"), text) == expected


@pytest.mark.parametrize("text,dtype,dval", [
    ("รับส่วนลด 50% ที่ร้านอาหาร", "percentage", "50%"),
    ("รับเงินคืน 500 บาท", "cashback", "500 baht"),
    ("รับ 5000 คะแนนพิเศษ", "points", "5000 points"),
    ("สิทธิพิเศษสำหรับสมาชิก", None, None),
    ("ลด 1,000 บาท", "discount", "1000 baht"),
    ("ผ่อน 0% นาน 10 เดือน", "percentage", "0%"),
    ("1,000.50 บาท", "discount", "50 baht"),
    ("Get 3 Points now", "points", "3 points"),
    ("รับ ๕๐% ทุกวัน", "percentage", "๕๐%"),
])
def test_discount(spark, text, dtype, dval):
    r = one(spark, extract_discount("s"), text)
    assert (r["discount_type"], r["discount_value"]) == (dtype, dval)


@pytest.mark.parametrize("text,expected", [
    ("ช้อปครบ 3,000 บาท", 3000.0), ("ขั้นต่ำ 500 baht", 500.0), ("no minimum", None),
    ("Minimum 250", 250.0), ("ตั้งแต่ 1,500", 1500.0),
])
def test_minimum_spend(spark, text, expected):
    assert one(spark, extract_minimum_spend("s"), text) == expected


def _range(spark, spec, text):
    r = one(spark, D.date_range(F.col("s"), SPECS[spec]), text)
    return r["start_date"], r["end_date"]


@pytest.mark.parametrize("spec,text,start,end", [
    ("krungsri", "1 ม.ค. 69 - 30 มิ.ย. 69", dt.date(2026, 1, 1), dt.date(2026, 6, 30)),
    ("krungsri", "1 มี.ค. 2569 - 28 ก.พ. 2570", dt.date(2026, 3, 1), dt.date(2027, 2, 28)),
    ("krungsri", "2026-04-01 - 2026-04-30", dt.date(2026, 4, 1), dt.date(2026, 4, 30)),
    ("krungsri", "1 มกราคม 2569 ถึง 31 ธันวาคม 2569", dt.date(2026, 1, 1), dt.date(2026, 12, 31)),
    ("krungsri", "31 ก.พ. 69 - 1 มี.ค. 69", None, dt.date(2026, 3, 1)),
    ("amex", "available soon", None, None),
    ("amex", "ระยะเวลา: 01/04/2026 - 30/09/2026", dt.date(2026, 4, 1), dt.date(2026, 9, 30)),
    ("bbl", "1 Mar 2026 until 30 Apr 2026", dt.date(2026, 3, 1), dt.date(2026, 4, 30)),
    ("uob", "ใช้ได้ 1 ม.ค. 69 - 30 มิ.ย. 69", dt.date(2026, 1, 1), dt.date(2026, 6, 30)),
    ("kasikorn", "1 ม.ค. 67 - 30 มิ.ย. 67", dt.date(2024, 1, 1), dt.date(2024, 6, 30)),
    # the character-class split of this source cuts inside the month name
    ("kasikorn", "1 สิงหาคม 67 - 30 สิงหาคม 67", None, None),
])
def test_date_ranges(spark, spec, text, start, end):
    assert _range(spark, spec, text) == (start, end)


def test_thai_digits_and_two_digit_year(spark):
    assert one(spark, D.thai_date(F.col("s")), "๑ ม.ค. ๖๙") == dt.date(2026, 1, 1)
    assert one(spark, D.thai_date(F.col("s")), "10.00 น. 5 ม.ค. 00") == dt.date(1957, 1, 10)


def _merchant(spark, spec, title, desc=""):
    df = spark.createDataFrame([(title, desc)], "t STRING, d STRING")
    return df.select(merchant_for_spec(SPECS[spec], F.col("t"), F.col("d"))).first()[0]


@pytest.mark.parametrize("spec,title,desc,expected", [
    ("kasikorn", "ส่วนลด 20% กับ SUSHIRO เมื่อใช้จ่าย 1,000 บาท", "", "SUSHIRO"),
    ("kasikorn", "รับคะแนนสะสม 3 เท่า กับ บัตรเครดิตกสิกรไทย", "", None),
    ("kasikorn", "ASB GREEN VALLEY ผ่อน 0% นาน 10 เดือน", "", "ASB GREEN VALLEY"),
    ("krungsri", "ลดสูงสุด 50% ที่ Centara Grand Buffet 1 ม.ค. 69 - 30 มิ.ย. 69", "", "Centara Grand Buffet"),
    ("uob", "รับเครดิตเงินคืน", "เฉพาะการใช้จ่ายที่ 18 มีนาคม 2568", None),
    ("bbl", "10% cashback at Starbucks", "10% cashback at Starbucks", "Starbucks"),
    ("amex", "Hilton Dining Offer", "", "Hilton Dining Offer"),
    ("amex", "American Express Platinum Lounge", "", None),
])
def test_merchants(spark, spec, title, desc, expected):
    assert _merchant(spark, spec, title, desc) == expected


@pytest.mark.parametrize("href", [
    "../pages/dining_sushiro.aspx", "/th/promo/a.aspx", "https://other.example.com/x?y=1",
    "sub/page.aspx?id=3#top", "//cdn.example.com/i.png", "./a/./b/../c", "?page=2",
])
def test_url_join_matches_urljoin(spark, href):
    base = SPECS["kasikorn"].promotion_url
    assert one(spark, url_join(base, F.col("s")), href) == urljoin(base, href)


def test_source_ids(spark):
    df = spark.createDataFrame([("https://x.com/a/b/offer.html?utm=1", "Title here")], "u STRING, t STRING")
    amex = source_id_from_url(F.col("u"), F.col("t"), True, True)
    krungsri = source_id_from_url(F.col("u"), F.col("t"), False, False)
    r = df.select(amex, krungsri).first()
    assert r[0] == "offer" and r[1] == "offer.html?utm=1"
    df2 = spark.createDataFrame([("", "A title that is long")], "u STRING, t STRING")
    assert df2.select(source_id_from_url(F.col("u"), F.col("t"), True, False, 5)).first()[0] == "A tit"
