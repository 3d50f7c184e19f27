"""Content checksum (U1): SHA-256 of a sorted-key JSON text of 15 fields.

The JSON text is built with native string functions so that it is byte-equal to
``json.dumps(obj, sort_keys=True, ensure_ascii=False)``: ``", "`` and ``": "``
separators, strings escaped by Spark's JSON writer (control characters' hex
digits lower-cased), card types sorted, dates ISO or null, floats printed the
Python way for integral values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hashed fields (sorted) — identity, scrape time and raw
# payload are excluded.
CHECKSUM_FIELDS = [
    "bank", "card_types", "category", "description", "discount_type", "discount_value",
    "end_date", "image_url", "merchant_name", "minimum_spend", "source_id", "source_url",
    "start_date", "terms_and_conditions", "title",
]
_NEEDS_ESCAPE = "[\"\\\\\\x00-\\x1F]"
_UPPER_HEX_CONTROLS = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def json_string(col: Column, plain: Column | None = None) -> Column:
    """JSON literal for a string Column: quoted/escaped text, or ``null``.
    ``plain`` may assert (per row) that no escaping is needed."""
    wrapped = F.to_json(F.array(col))
    j = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    fixed = j
    for h in _UPPER_HEX_CONTROLS:
        fixed = F.replace(fixed, F.lit("\\u" + h), F.lit("\\u" + h.lower()))
    # Text without quotes, backslashes or control characters needs no escaping:
    # quote it directly and skip the JSON writer.
    no_escape = ~col.rlike(_NEEDS_ESCAPE) if plain is None else (plain | ~col.rlike(_NEEDS_ESCAPE))
    return (F.when(col.isNull(), F.lit("null"))
            .when(no_escape, F.concat(F.lit('"'), col, F.lit('"')))
            .when(col.rlike("[\\x0B\\x0E\\x0F\\x1A-\\x1F]"), fixed)
            .otherwise(j))


def json_float(col: Column) -> Column:
    """A float as Python's ``repr`` writes it (JSON's NaN and Infinity included), or ``null``.

    Its digits are the first 16 where they are enough to tell the number, else 17; the point is set anew."""
    integral = (F.floor(col) == col) & (F.abs(col) < F.lit(1e16))
    shorter = F.format_string("%.15e", col)
    text = F.when(shorter.try_cast("double") == col, shorter).otherwise(F.format_string("%.16e", col))
    shape = r"^-?(\d+)\.(\d*)e\+?(-?\d+)$"
    whole, fraction, power = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
    given = F.concat(whole, fraction)
    lead = F.length(given) - F.length(F.regexp_replace(given, "^0+", ""))
    digits = F.regexp_replace(F.regexp_replace(given, "^0+", ""), "0+$", "")
    # The value is 0.digits times ten to the ``point``.
    point = F.length(whole) + F.coalesce(F.nullif(power, F.lit("")).cast("int"), F.lit(0)) - lead
    n = F.length(digits)
    fixed = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
             .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
             .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))))
    exponent = F.concat(F.when(point <= 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(point - 1).cast("string"), F.greatest(
        F.lit(2), F.length(F.abs(point - 1).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), exponent)
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise("")
    return (F.when(col.isNull(), F.lit("null"))
            .when(F.isnan(col), F.lit("NaN"))
            .when(F.abs(col) == F.lit(float("inf")), F.concat(sign, F.lit("Infinity")))
            .when((col == 0.0) & F.startswith(text, F.lit("-")), F.lit("-0.0"))
            .when(integral, F.concat(col.cast("bigint").cast("string"), F.lit(".0")))
            .when((point > -4) & (point <= 16), F.concat(sign, fixed))
            .otherwise(F.concat(sign, scientific)))


def sorted_list(col: Column) -> Column:
    arr = F.coalesce(col, F.array().cast("array<string>"))
    return F.when(F.size(arr) < 2, arr).otherwise(F.array_sort(arr))


def json_string_list(col: Column, in_order: bool = False) -> Column:
    """Sorted list of strings as ``["a", "b"]`` (``[]`` for null/empty); ``in_order``: ``sorted_list`` has sorted it."""
    arr = col if in_order else sorted_list(col)
    plain = ~F.array_join(arr, "").rlike(_NEEDS_ESCAPE)
    fast = F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.array_join(arr, '", "'), F.lit('"]')))
    items = F.transform(arr, lambda x: json_string(x))
    slow = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    # Elements needing no escaping (the common case) skip the per-element lambda.
    return F.when(plain, fast).otherwise(slow)


def json_date(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('"'), col.cast("string"), F.lit('"')))


TEXT_FIELDS = [f for f in CHECKSUM_FIELDS if f not in ("card_types", "minimum_spend", "start_date", "end_date")]


def texts_plain(cols: dict | None = None) -> Column:
    """Whether no text field needs escaping, by one scan over all of them."""
    return ~F.concat_ws("", *[(cols or {}).get(f, F.col(f)) for f in TEXT_FIELDS]).rlike(_NEEDS_ESCAPE)


def checksum_steps(cols: dict | None = None) -> list:
    """Projections that add ``checksum``; what several fields need is computed once per row. ``cols`` may give the text
    fields that the first projection can't read as columns."""
    return [("cols", {"_plain": texts_plain(cols), "_cards": sorted_list(F.col("card_types"))}),
            ("cols", {"checksum": F.sha2(checksum_json(all_plain=F.col("_plain"), cards=F.col("_cards")), 256)}),
            ("drop", ["_plain", "_cards"])]


def checksum_json(df_cols: dict | None = None, all_plain: Column | None = None, cards: Column | None = None) -> Column:
    """The canonical JSON text; ``df_cols`` may override field Columns; ``all_plain`` and ``cards``
    may be given as columns that hold ``texts_plain`` and ``sorted_list``."""
    cols = {f: F.col(f) for f in CHECKSUM_FIELDS}
    if df_cols:
        cols.update(df_cols)
    if all_plain is None:
        all_plain = texts_plain(cols)
    pieces = [F.lit("{")]
    for i, f in enumerate(CHECKSUM_FIELDS):
        c = cols[f]
        if f == "card_types":
            v = json_string_list(c) if cards is None else json_string_list(cards, in_order=True)
        elif f == "minimum_spend":
            v = json_float(c)
        elif f in ("start_date", "end_date"):
            v = json_date(c)
        else:
            v = json_string(c, all_plain)
        pieces.append(F.lit(('' if i == 0 else ', ') + '"' + f + '": '))
        pieces.append(v)
    pieces.append(F.lit("}"))
    return F.concat(*pieces)


def checksum(df_cols: dict | None = None) -> Column:
    """Hex SHA-256 of the canonical JSON text (UTF-8)."""
    return F.sha2(checksum_json(df_cols), 256)
