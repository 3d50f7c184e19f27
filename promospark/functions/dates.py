"""Date scalar functions (D-1..D-10) as Spark Columns.

Ranges are split into at most two parts with ``split(text, regex, 2)``; each part
is parsed by the source's rules: Thai month-name dates (Buddhist era aware) and
strptime-style formats mapped onto Spark datetime patterns with ``try_to_date``
(invalid calendar days give null, as a failed parse does).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promospark.functions.text import ascii_digits, contains_any, is_plain
from promospark.sources.specs import (FMT_D_MON_Y, FMT_D_MONTH_Y, FMT_DMY_DASH, FMT_DMY_SLASH,
                                      FMT_ISO_FRAC_Z, FMT_ISO_T, FMT_YMD, SourceSpec, WS_CLASS)

# Thai month names and abbreviations in lookup order
# (the first name contained in the text decides the month).
THAI_MONTHS = [
    ("ม.ค.", 1), ("มกราคม", 1), ("ก.พ.", 2), ("กุมภาพันธ์", 2),
    ("มี.ค.", 3), ("มีนาคม", 3), ("เม.ย.", 4), ("เมษายน", 4),
    ("พ.ค.", 5), ("พฤษภาคม", 5), ("มิ.ย.", 6), ("มิถุนายน", 6),
    ("ก.ค.", 7), ("กรกฎาคม", 7), ("ส.ค.", 8), ("สิงหาคม", 8),
    ("ก.ย.", 9), ("กันยายน", 9), ("ต.ค.", 10), ("ตุลาคม", 10),
    ("พ.ย.", 11), ("พฤศจิกายน", 11), ("ธ.ค.", 12), ("ธันวาคม", 12),
]
THAI_MONTH_ABBR = [n for n, _ in THAI_MONTHS[0::2]]
THAI_MONTH_FULL = [n for n, _ in THAI_MONTHS[1::2]]
ENGLISH_MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                      "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Shape each format accepts (strptime: %d/%m one or two digits, %Y four digits);
# parses run only on matching text, so failed parses cost a regex, not an exception.
_SHAPES = {
    FMT_DMY_SLASH: r"^\d{1,2}/\d{1,2}/\d{4}$",
    FMT_DMY_DASH: r"^\d{1,2}-\d{1,2}-\d{4}$",
    FMT_YMD: r"^\d{4}-\d{1,2}-\d{1,2}$",
    FMT_D_MON_Y: r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$",
    FMT_D_MONTH_Y: r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$",
    FMT_ISO_T: r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
}

# strptime format -> Spark datetime pattern (d and M accept one or two digits).
_SPARK_PATTERNS = {
    FMT_DMY_SLASH: "d/M/yyyy",
    FMT_DMY_DASH: "d-M-yyyy",
    FMT_YMD: "yyyy-M-d",
    FMT_D_MON_Y: "d MMM yyyy",
    FMT_D_MONTH_Y: "d MMMM yyyy",
    FMT_ISO_T: "yyyy-M-d'T'H:m:s",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(col: Column) -> Column:
    """``str.strip``; plain text has no whitespace but the space."""
    return F.when(is_plain(col), F.trim(col)).otherwise(_strip_any(col))


def _strip_any(col: Column) -> Column:
    return F.regexp_replace(col, "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def _month_of(p: Column) -> Column:
    """Number of the first month name (in lookup order) contained in ``p``.
    A CASE chain of ``contains`` stays inside generated code."""
    out = None
    for n, m in THAI_MONTHS:
        cond = F.contains(p, F.lit(n))
        out = F.when(cond, F.lit(m)) if out is None else out.when(cond, F.lit(m))
    return out


#: Every month name ends in one of these.
_MONTH_ENDS = sorted({n[-2:] for n, _ in THAI_MONTHS})


def make_date_or_null(y: Column, m: Column, d: Column) -> Column:
    """Calendar-checked date from integer parts; invalid gives null."""
    txt = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string"))
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), txt.try_cast("date"))


def buddhist_year(y: Column) -> Column:
    """D-5: > 2500 is Buddhist era (minus 543); < 100 is a two-digit BE year."""
    return F.when(y > 2500, y - 543).when(y < 100, y + 1957).otherwise(y)


def thai_date(part) -> Column:
    """D-4: first Thai month name contained in the text (lookup order); first
    number is the day, last the year; at least two numbers needed."""
    p = _c(part)
    month = _month_of(p)
    nums = F.regexp_extract_all(p, F.lit(r"(?U)(\d+)"), 1)
    day = F.try_element_at(nums, F.lit(1))
    year = F.try_element_at(nums, F.lit(-1))
    d = ascii_digits(day).try_cast("int")
    y = buddhist_year(ascii_digits(year).try_cast("int"))
    return F.when(month.isNotNull() & (F.size(nums) >= 2), make_date_or_null(y, month, d))


def format_date(part, fmt: str) -> Column:
    """One strptime-style format as a Spark parse returning null on failure."""
    return _parse_stripped(_strip(_c(part)), fmt)


def standard_date(part, formats) -> Column:
    return F.coalesce(*[format_date(part, f) for f in formats])


def parse_part(part, spec: SourceSpec) -> Column:
    std = standard_date(part, spec.date_formats)
    if not spec.thai_dates:
        return std
    if spec.english_first:
        return F.coalesce(std, thai_date(part))
    return F.coalesce(thai_date(part), std)


def date_range(text, spec: SourceSpec) -> Column:
    """D-6..D-9: struct<start_date, end_date> from one range text."""
    t = _c(text)
    if spec.date_prefix:
        t = _strip(F.regexp_replace(t, spec.date_prefix, ""))
    parts = F.split(t, spec.split_regex, 2)
    p0 = F.try_element_at(parts, F.lit(1))
    p1 = F.try_element_at(parts, F.lit(2))
    start = F.when(t.isNotNull(), parse_part(p0, spec))
    end = F.when(F.size(parts) > 1, parse_part(p1, spec))
    return F.struct(start.alias("start_date"), end.alias("end_date"))


def epoch_millis_date(col) -> Column:
    """D-3: epoch milliseconds to a calendar date in UTC (explicit zone, so the
    result does not depend on the session time zone)."""
    days = F.floor(F.floor(_c(col)) / F.lit(86_400_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


# --------------------------------------------------------------------------
# DataFrame-level range parsing: every intermediate (split parts, month, number
# list, each format's parse) is a column of its own projection, computed once
# per row and shared by all sources' rules; the per-source choice at the end is
# a small CASE over those columns.
ALL_FORMATS = [FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD, FMT_D_MON_Y, FMT_D_MONTH_Y,
               FMT_ISO_T, FMT_ISO_FRAC_Z]


def _fmt_col(i: int, fmt: str) -> str:
    return f"_f{i}_{ALL_FORMATS.index(fmt)}"


def part_parse_steps(i: int, part: str, thai: Column | None = None, uses=None) -> list:
    """Projection steps adding ``_s{i}`` (stripped part), the Thai-date parse
    ``_t{i}`` and one parse column per format for part ``i``.

    Format parses only run where the Thai parse found nothing: a text holding a
    Thai month name can never fully match a numeric or English format, so the
    skipped parses would all be null anyway. ``thai`` tells the rows whose source reads
    Thai dates, ``uses(fmt)`` those whose source reads a format; no other row is parsed so."""
    p = F.col(part)
    may = contains_any(p, _MONTH_ENDS)
    may = may if thai is None else thai & may
    n = F.col(f"_n{i}")
    no_thai = F.col(f"_t{i}").isNull()
    return [
        ("cols", {f"_s{i}": _strip(p), f"_m{i}": F.when(may, _month_of(p)),
                  f"_n{i}": F.when(may, F.regexp_extract_all(p, F.lit(r"(?U)(\d+)"), 1))}),
        ("cols", {f"_y{i}": buddhist_year(ascii_digits(F.try_element_at(n, F.lit(-1))).try_cast("int")),
                  f"_d{i}": ascii_digits(F.try_element_at(n, F.lit(1))).try_cast("int")}),
        ("cols", {f"_t{i}": F.when(F.col(f"_m{i}").isNotNull() & (F.size(n) >= 2),
                                   make_date_or_null(F.col(f"_y{i}"), F.col(f"_m{i}"), F.col(f"_d{i}")))}),
        ("cols", {_fmt_col(i, fmt): F.when((no_thai if uses is None else uses(fmt) & no_thai) & _may_fit(F.col(f"_s{i}"), fmt),
                                           _parse_stripped(F.col(f"_s{i}"), fmt))
                  for fmt in ALL_FORMATS}),
    ]


def _may_fit(p: Column, fmt: str) -> Column:
    """What any text of the format's shape fulfils, told without a pattern."""
    slash, dash = F.contains(p, F.lit("/")), F.contains(p, F.lit("-"))
    if fmt == FMT_DMY_SLASH:
        return slash
    if fmt == FMT_D_MON_Y:
        return ~slash & ~dash
    if fmt == FMT_D_MONTH_Y:
        # Three letters are left to the short form, which every source tries before: failed parses throw.
        return ~slash & ~dash & ~p.rlike(_SHAPES[FMT_D_MON_Y])
    time = F.contains(p, F.lit("T"))
    return dash & time if fmt in (FMT_ISO_T, FMT_ISO_FRAC_Z) else dash & ~time


def side_by_side(*chains: list) -> list:
    """Steps that take the chains' first projections at once, then their second ones, and so on: a row is copied as
    often as the longest chain is long. No chain may read what another one adds."""
    out = []
    for level in range(max(map(len, chains))):
        added, gone = {}, []
        for kind, arg in (c[level] for c in chains if level < len(c)):
            if kind == "cols":
                added.update(arg)
            else:
                gone += arg
        out += [("cols", added)] * bool(added) + [("drop", gone)] * bool(gone)
    return out


def apply_steps(df, steps):
    for kind, arg in steps:
        if kind == "cols":
            df = df.withColumns(arg)
        elif kind == "filter":
            df = df.filter(arg)
        else:
            df = df.drop(*arg)
    return df


def _parse_stripped(p: Column, fmt: str) -> Column:
    if fmt == FMT_ISO_FRAC_Z:
        ok = p.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$")
        body = F.regexp_replace(p, r"\.\d{1,6}Z$", "")
        return F.when(ok, F.to_date(F.try_to_timestamp(body, F.lit(_SPARK_PATTERNS[FMT_ISO_T]))))
    ok = p.rlike(_SHAPES[fmt])
    if fmt in _NUMERIC:
        # Of this shape, so the cast reads what the pattern would, without a formatter.
        return F.when(ok, _year_first(p, _NUMERIC[fmt]).try_cast("date"))
    if fmt == FMT_ISO_T:
        return F.when(ok, F.to_date(F.try_to_timestamp(p, F.lit(_SPARK_PATTERNS[FMT_ISO_T]))))
    if fmt in (FMT_D_MON_Y, FMT_D_MONTH_Y):
        p = F.regexp_replace(p, r"\s+", " ")
    return F.when(ok, F.try_to_date(p, _SPARK_PATTERNS[fmt]))


#: The separator of the formats made of numbers with the day first; '' where the year is first.
_NUMERIC = {FMT_DMY_SLASH: "/", FMT_DMY_DASH: "-", FMT_YMD: ""}


def _year_first(p: Column, sep: str) -> Column:
    if not sep:
        return p
    day_month = F.substring_index(p, sep, 2)
    return F.concat_ws("-", F.substring_index(p, sep, -1), F.substring_index(day_month, sep, -1), F.substring_index(p, sep, 1))


def part_rule(spec: SourceSpec, i: int) -> Column:
    """The spec's parse of part ``i`` from the precomputed columns."""
    std = F.coalesce(*[F.col(_fmt_col(i, f)) for f in spec.date_formats])
    if not spec.thai_dates:
        return std
    if spec.english_first:
        return F.coalesce(std, F.col(f"_t{i}"))
    return F.coalesce(F.col(f"_t{i}"), std)


def split_steps(text_col: Column, parts_col: Column) -> list:
    """Steps adding ``_dtext``, ``_p0``/``_p1`` (at most two parts) and ``_has1``."""
    parts = F.col("_parts")
    return [("cols", {"_dtext": text_col, "_parts": parts_col}),
            ("cols", {"_p0": F.try_element_at(parts, F.lit(1)), "_p1": F.try_element_at(parts, F.lit(2)),
                      "_has1": F.size(parts) > 1})]


DATE_WORK_COLUMNS = (["_dtext", "_parts", "_has1", "_p0", "_p1"]
                     + [f"_{x}{i}" for x in "smnydt" for i in (0, 1)]
                     + [f"_f{i}_{k}" for i in (0, 1) for k in range(len(ALL_FORMATS))])
