"""The Spark checksum equals SHA-256 of Python's sorted-key json.dumps."""
import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from promospark.functions.checksum import CHECKSUM_FIELDS, checksum, json_float

SCHEMA = ("bank STRING, card_types ARRAY<STRING>, category STRING, description STRING, "
          "discount_type STRING, discount_value STRING, end_date DATE, image_url STRING, "
          "merchant_name STRING, minimum_spend DOUBLE, source_id STRING, source_url STRING, "
          "start_date DATE, terms_and_conditions STRING, title STRING")


def py_checksum(row):
    d = dict(row)
    d["card_types"] = sorted(d["card_types"]) if d["card_types"] else []
    for k in ("start_date", "end_date"):
        d[k] = str(d[k]) if d[k] else None
    return hashlib.sha256(json.dumps(d, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_checksum_matches_python(spark):
    rows = [
        ("ktc", ["b", "a"], None, "", None, None, None, None, None, None, "id1", "https://x/1", None, None, "T"),
        ("uob", [], "dining", 'say "hi"\\ now\nnext\ttab', "percentage", "50%", dt.date(2026, 6, 30),
         "https://i/1.png", "ร้าน", 3000.0, "p-1", "https://u/p-1", dt.date(2026, 1, 1), None, "ไทย ๕๐%"),
        ("bbl", ["Brand#1"], None, "ctl\x1fchar\x0bx\x01", None, None, None, None, None, 1.0e7, "k", "u", None,
         None, "big number"),
        ("amex", ["z", "Z", "ä"], "c", "d", "cashback", "5 baht", None, None, "M", 12.5, "s", "u", None, "t&c",
         "title"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r[0] for r in df.select(checksum()).collect()]
    want = [py_checksum(zip(CHECKSUM_FIELDS, r)) for r in rows]
    assert got == want


def test_checksum_sensitivity(spark):
    base = ("ktc", ["a"], None, "", None, None, None, None, "M", None, "id", "u", None, None, "T")
    changed = list(base)
    changed[8] = "N"
    df = spark.createDataFrame([base, tuple(changed), base], SCHEMA)
    a, b, c = [r[0] for r in df.select(checksum()).collect()]
    assert a == c and a != b


def test_floats_as_python_writes_them(spark):
    rng = random.Random(4)
    floats = [0.0, -0.0, 1.0, -3.0, 0.1, 0.001, 0.0001, 0.00012345, 0.00001, -1.5e-7, 9.999e15, 1e16, 1.2345e17, -1e22, 1e100, 1e-100,
              123456789.125, 12345678.9, 9007199254740993.0, 1234567890123456.5, float("nan"), float("inf"), float("-inf"), None]
    floats += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-12, 25) for _ in range(500)]
    floats += [round(rng.random() * 10 ** rng.randint(0, 9), rng.randint(0, 3)) for _ in range(300)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(floats)], "k INT, x DOUBLE").select("k", json_float(F.col("x")).alias("t")).collect()
    for r in rows:
        assert r.t == json.dumps(floats[r.k])
