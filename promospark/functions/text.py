"""Text scalar functions (T1-T6) as Spark Columns.

All are native expressions (regexp_replace / regexp_extract / when), so they stay
inside whole-stage codegen and are pushed through projections by Catalyst.
Java regex is made Unicode-aware with ``(?U)`` so ``\\d`` and ``\\s`` behave like
Python's ``re`` on ``str`` (Thai digits count as digits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promospark.sources.specs import WS_CLASS, ZERO_WIDTH_CLASS

# The discount / minimum-spend patterns being reproduced.
PCT_RE = r"(?U)(\d+(?:\.\d+)?)\s*%"
POINTS_RE = r"(?U)(\d[\d,]*)\s*(?:คะแนน|points?|พอยท์|เท่า)"
BAHT_RE = r"(?U)(\d[\d,]*)\s*(?:บาท|baht|฿)"
CASHBACK_WORDS = ("คืน", "cashback", "cash back")
# What a lower-cased text must hold for the patterns of points, baht and spend to match.
POINTS_WORDS = ("คะแนน", "point", "พอยท์", "เท่า")
BAHT_WORDS = ("บาท", "baht", "฿")
MIN_SPEND_WORDS = ("ครบ", "ตั้งแต่", "ขั้นต่ำ", "min")
MIN_SPEND_RE = r"(?U)(?:ครบ|ตั้งแต่|ขั้นต่ำ|min(?:imum)?)\s*(\d[\d,]*)\s*(?:บาท|baht|฿)?"

# Thai digits ๐..๙ map to 0..9 before numeric casts.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Holds none of the zero-width characters, and the space as its only whitespace.
_NOT_PLAIN = "[^ -~\u0E00-\u0E7F]"


def is_plain(col: Column) -> Column:
    """Whether a text is of printable ASCII and Thai alone, told by one cheap class."""
    return ~col.rlike(_NOT_PLAIN)


def normalize_text(col) -> Column:
    """Drop zero-width characters, collapse whitespace runs, trim. Plain text without a run needs the trim alone."""
    t = _c(col)
    c = F.regexp_replace(t, ZERO_WIDTH_CLASS, "")
    c = F.regexp_replace(c, WS_CLASS + "+", " ")
    return F.trim(F.when(~F.contains(t, F.lit("  ")) & is_plain(t), t).otherwise(c))


def ascii_digits(col) -> Column:
    return F.translate(_c(col), THAI_DIGITS, "0123456789")


def _first(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def extract_discount(text) -> Column:
    """struct<discount_type, discount_value> with the fixed precedence
    percentage > points > baht (cashback when a refund word appears) > null."""
    t = _c(text)
    low = F.lower(t)
    pct = _first(t, PCT_RE)
    pts = _first(low, POINTS_RE)
    baht = _first(low, BAHT_RE)
    refund = None
    for w in CASHBACK_WORDS:
        cond = F.contains(low, F.lit(w))
        refund = cond if refund is None else (refund | cond)
    dtype = (F.when(pct.isNotNull(), F.lit("percentage"))
             .when(pts.isNotNull(), F.lit("points"))
             .when(baht.isNotNull() & refund, F.lit("cashback"))
             .when(baht.isNotNull(), F.lit("discount")))
    dval = (F.when(pct.isNotNull(), F.concat(pct, F.lit("%")))
            .when(pts.isNotNull(), F.concat(F.regexp_replace(pts, ",", ""), F.lit(" points")))
            .when(baht.isNotNull(), F.concat(F.regexp_replace(baht, ",", ""), F.lit(" baht"))))
    return F.struct(dtype.alias("discount_type"), dval.alias("discount_value"))


def extract_minimum_spend(text) -> Column:
    """First spend threshold after ครบ/ตั้งแต่/ขั้นต่ำ/min/minimum, as DOUBLE."""
    return _to_double(_first(F.lower(_c(text)), MIN_SPEND_RE))


def contains_any(col: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


def discount_steps(text: Column, spends: Column) -> list:
    """``extract_discount`` and, for rows of ``spends``, ``extract_minimum_spend`` of one text, as projections
    that add ``discount_type``, ``discount_value`` and ``minimum_spend``.

    Each pattern runs once at most, and only on text that holds one of the words it needs."""
    pct, pts, baht, low, spend = (F.col(c) for c in ("_pct", "_pts", "_baht", "_low", "_spend"))

    def first(needed: Column, col: Column, pattern: str) -> Column:
        # Empty where there is none, so that later steps need not run the pattern again.
        return F.when(needed, F.regexp_extract(col, pattern, 1)).otherwise("")

    return [
        ("cols", {"_text": text}),
        ("cols", {"_pct": first(F.contains("_text", F.lit("%")), F.col("_text"), PCT_RE)}),
        # A percentage goes before the rules that read lower case; spends are looked for in any text.
        ("cols", {"_low": F.when((pct == "") | spends, F.lower("_text"))}),
        ("cols", {"_pts": first((pct == "") & contains_any(low, POINTS_WORDS), low, POINTS_RE),
                  "_spend": first(spends & contains_any(low, MIN_SPEND_WORDS), low, MIN_SPEND_RE)}),
        ("cols", {"_baht": first((pct == "") & (pts == "") & contains_any(low, BAHT_WORDS), low, BAHT_RE)}),
        ("cols", {"discount_type": F.when(pct != "", F.lit("percentage")).when(pts != "", F.lit("points"))
                  .when((baht != "") & contains_any(low, CASHBACK_WORDS), F.lit("cashback")).when(baht != "", F.lit("discount")),
                  "discount_value": F.when(pct != "", F.concat(pct, F.lit("%")))
                  .when(pts != "", F.concat(F.replace(pts, F.lit(","), F.lit("")), F.lit(" points")))
                  .when(baht != "", F.concat(F.replace(baht, F.lit(","), F.lit("")), F.lit(" baht"))),
                  "minimum_spend": F.when(spend != "", _to_double(spend))}),
        ("drop", ["_text", "_low", "_pct", "_pts", "_baht", "_spend"]),
    ]


def _to_double(s: Column) -> Column:
    digits = F.regexp_replace(ascii_digits(s), ",", "")
    return F.when(s.isNotNull(), digits.try_cast("double"))
