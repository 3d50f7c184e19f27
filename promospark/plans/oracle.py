"""DuckDB oracle SQL for the registered queries.

The oracle is an independent SQL formulation over the same parquet tables. It
reuses the fixed values (patterns, month names, templates) but is written in
DuckDB's dialect: RE2 has no look-around, so a look-ahead terminator becomes a
consumed non-capturing group (group 1 is unchanged) and the single negative
look-behind becomes ``(?:^|[^ม])``.
"""

from __future__ import annotations

from promospark.functions.checksum import CHECKSUM_FIELDS
from promospark.functions.dates import (ENGLISH_MONTH_ABBR, THAI_MONTH_ABBR, THAI_MONTH_FULL,
                                        THAI_MONTHS)
from promospark.functions.text import BAHT_RE, CASHBACK_WORDS, MIN_SPEND_RE, PCT_RE, POINTS_RE
from promospark.operators.extract import JSON_URL_PATHS
from promospark.sources.feeds import CARD_EXTRA, LINKLESS_TEMPLATE, TEMPLATES
from promospark.sources.specs import (AMEX_HUBS, FMT_D_MON_Y, FMT_D_MONTH_Y, FMT_DMY_DASH,
                                      FMT_DMY_SLASH, FMT_ISO_FRAC_Z, FMT_ISO_T, FMT_YMD,
                                      KRUNGSRI_HUBS, KTC_HUBS, SOURCE_NAMES, SPECS, WS_CLASS,
                                      ZERO_WIDTH_CLASS, SourceSpec)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    p = p.replace("(?U)", "")
    p = p.replace("(?<!ร่วม)กับ", "(?:^|[^ม])กับ")
    return p.replace("(?=", "(?:")


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


# ---------------------------------------------------------------- text
def normalize(e: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({e}, {lit(ZERO_WIDTH_CLASS)}, '', 'g'), "
            f"{lit(WS_CLASS + '+')}, ' ', 'g'))")


def _first(e: str, pat: str) -> str:
    return f"nullif(regexp_extract({e}, {lit(re2(pat))}, 1), '')"


def discount(text: str) -> tuple[str, str]:
    low = f"lower({text})"
    pct, pts, baht = _first(text, PCT_RE), _first(low, POINTS_RE), _first(low, BAHT_RE)
    refund = " OR ".join(f"contains({low}, {lit(w)})" for w in CASHBACK_WORDS)
    dtype = (f"CASE WHEN {pct} IS NOT NULL THEN 'percentage' WHEN {pts} IS NOT NULL THEN 'points' "
             f"WHEN {baht} IS NOT NULL AND ({refund}) THEN 'cashback' "
             f"WHEN {baht} IS NOT NULL THEN 'discount' END")
    dval = (f"CASE WHEN {pct} IS NOT NULL THEN {pct} || '%' "
            f"WHEN {pts} IS NOT NULL THEN replace({pts}, ',', '') || ' points' "
            f"WHEN {baht} IS NOT NULL THEN replace({baht}, ',', '') || ' baht' END")
    return dtype, dval


def min_spend(text: str) -> str:
    g = _first(f"lower({text})", MIN_SPEND_RE)
    return f"TRY_CAST(replace({g}, ',', '') AS DOUBLE)"


# ---------------------------------------------------------------- merchant
def merchant(spec: SourceSpec, title: str, desc: str) -> str:
    text = f"trim(concat_ws(' ', {title}, {desc}))"
    branches = []

    def blocked(c):
        return f"regexp_matches({c}, {lit(re2(spec.blocklist))}, 'i')" if spec.blocklist else "false"

    for pat in spec.merchant_patterns:
        cand = f"rtrim(trim(regexp_extract({text}, {lit(re2(pat))}, 1)), {lit(spec.merchant_rstrip)})"
        branches.append(f"WHEN {cand} <> '' AND NOT {blocked(cand)} THEN substring({cand}, 1, 255)")
    if spec.caps_prefix:
        cand = f"trim(regexp_extract({title}, {lit(re2(spec.caps_prefix))}, 1))"
        fb = f"CASE WHEN {cand} <> '' AND NOT {blocked(cand)} THEN {cand} END"
    elif spec.title_is_merchant_max:
        fb = (f"CASE WHEN {title} <> '' AND length({title}) <= {spec.title_is_merchant_max} "
              f"AND NOT {blocked(title)} THEN substring(trim({title}), 1, 255) END")
    elif spec.merchant_from_title:
        fb = normalize(title)
    else:
        fb = "CAST(NULL AS VARCHAR)"
    if not branches:
        return fb
    return "CASE " + " ".join(branches) + f" ELSE {fb} END"


# ---------------------------------------------------------------- dates
_GUARDS = {
    FMT_DMY_SLASH: r"\d{1,2}/\d{1,2}/\d{4}",
    FMT_DMY_DASH: r"\d{1,2}-\d{1,2}-\d{4}",
    FMT_YMD: r"\d{4}-\d{1,2}-\d{1,2}",
    FMT_D_MON_Y: r"\d{1,2}\s+[A-Za-z]{3}\s+\d{4}",
    FMT_D_MONTH_Y: r"\d{1,2}\s+[A-Za-z]+\s+\d{4}",
    FMT_ISO_T: r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}",
    FMT_ISO_FRAC_Z: r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z",
}


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def fmt_date(part: str, fmt: str) -> str:
    p = _strip(part)
    guard = f"regexp_full_match({p}, {lit(_GUARDS[fmt])})"
    if fmt == FMT_ISO_FRAC_Z:
        body = f"regexp_replace({p}, '\\.\\d{{1,6}}Z$', '')"
        return f"CASE WHEN {guard} THEN CAST(try_strptime({body}, {lit(FMT_ISO_T)}) AS DATE) END"
    return f"CASE WHEN {guard} THEN CAST(try_strptime(regexp_replace({p}, '\\s+', ' ', 'g'), {lit(fmt)}) AS DATE) END"


def std_date(part: str, formats) -> str:
    return "coalesce(" + ", ".join(fmt_date(part, f) for f in formats) + ")"


def thai_date(part: str) -> str:
    month = "CASE " + " ".join(f"WHEN contains({part}, {lit(n)}) THEN {m}" for n, m in THAI_MONTHS) + " END"
    nums = f"regexp_extract_all({part}, '(\\d+)', 1)"
    d = f"TRY_CAST({nums}[1] AS INTEGER)"
    y0 = f"TRY_CAST({nums}[-1] AS INTEGER)"
    y = f"(CASE WHEN {y0} > 2500 THEN {y0} - 543 WHEN {y0} < 100 THEN {y0} + 1957 ELSE {y0} END)"
    txt = f"lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || CAST({month} AS VARCHAR) || '-' || CAST({d} AS VARCHAR)"
    return (f"CASE WHEN ({month}) IS NOT NULL AND len({nums}) >= 2 AND {y} BETWEEN 1 AND 9999 "
            f"AND {d} BETWEEN 1 AND 31 THEN CAST(try_strptime({txt}, '%Y-%m-%d') AS DATE) END")


def parse_part(part: str, spec: SourceSpec) -> str:
    std = std_date(part, spec.date_formats)
    if not spec.thai_dates:
        return std
    if spec.english_first:
        return f"coalesce({std}, {thai_date(part)})"
    return f"coalesce({thai_date(part)}, {std})"


def date_range(text: str, spec: SourceSpec) -> tuple[str, str]:
    t = text
    if spec.date_prefix:
        t = _strip(f"regexp_replace({text}, {lit(re2(spec.date_prefix))}, '')")
    sep = re2(spec.split_regex)
    has = f"regexp_matches({t}, {lit(sep)})"
    head = f"CASE WHEN {has} THEN regexp_extract({t}, {lit('(?s)^(.*?)(?:' + sep + ')(.*)$')}, 1) ELSE {t} END"
    tail = f"CASE WHEN {has} THEN regexp_extract({t}, {lit('(?s)^(.*?)(?:' + sep + ')(.*)$')}, 2) END"
    start = f"CASE WHEN {t} IS NOT NULL THEN {parse_part(head, spec)} END"
    end = f"CASE WHEN {has} THEN {parse_part(tail, spec)} END"
    return start, end


# ---------------------------------------------------------------- urls
def url_join(base: str, href: str) -> str:
    """``base`` is a SQL expression (a column or a quoted literal)."""
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    base_path = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    base_dir = f"regexp_replace({base_path}, '[^/]*$', '')"
    base_no_query = f"regexp_extract({base}, '^([^?#]*)', 1)"
    base_no_frag = f"regexp_extract({base}, '^([^#]*)', 1)"
    hpath = f"regexp_extract({href}, '^([^?#]*)', 1)"
    tail = f"substring({href}, length({hpath}) + 1)"
    is_abs = f"starts_with({hpath}, '/')"
    merged = f"(CASE WHEN {is_abs} THEN {hpath} ELSE {base_dir} || {hpath} END)"
    segs = f"string_split({merged}, '/')"
    kept = (f"(CASE WHEN {is_abs} THEN {segs} ELSE "
            f"list_filter({segs}, lambda x, i: i = 1 OR i = len({segs}) OR x <> '') END)")
    folded = (f"list_reduce({kept}, lambda acc, s: CASE WHEN s = '..' THEN "
              f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END) "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    folded = f"(CASE WHEN {kept}[-1] IN ('.', '..') THEN list_append({folded}, '') ELSE {folded} END)"
    joined = f"array_to_string({folded}, '/')"
    resolved = f"(CASE WHEN {joined} = '' THEN '/' ELSE {joined} END)"
    return (f"CASE WHEN {href} = '' THEN {base} "
            f"WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN starts_with({href}, '?') THEN {base_no_query} || {href} "
            f"WHEN starts_with({href}, '#') THEN {base_no_frag} || {href} "
            f"ELSE {origin} || {resolved} || {tail} END")


def source_id_from_url(url: str, title: str, strip_query: bool, strip_html: bool, n: int) -> str:
    seg = f"string_split(regexp_replace({url}, '/+$', ''), '/')[-1]"
    if strip_query:
        seg = f"regexp_replace({seg}, '\\?.*$', '')"
    if strip_html:
        seg = f"regexp_replace({seg}, '\\.html?$', '')"
    has = f"{url} IS NOT NULL AND {url} <> ''"
    if strip_query:
        has += f" AND {seg} <> ''"
    return f"CASE WHEN {has} THEN {seg} ELSE substring({title}, 1, {n}) END"


# ---------------------------------------------------------------- checksum
def json_str(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN 'null' ELSE "
            f"'\"' || replace(replace({e}, '\\', '\\\\'), '\"', '\\\"') || '\"' END")


def checksum(alias: str = "") -> str:
    a = alias + "." if alias else ""
    parts = []
    for i, f in enumerate(CHECKSUM_FIELDS):
        c = a + f
        if f == "card_types":
            v = (f"'[' || array_to_string(list_transform(list_sort(coalesce({c}, []::VARCHAR[])), "
                 f"lambda x: {json_str('x')}), ', ') || ']'")
        elif f == "minimum_spend":
            v = (f"CASE WHEN {c} IS NULL THEN 'null' WHEN floor({c}) = {c} AND abs({c}) < 1e16 "
                 f"THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({c} AS VARCHAR) END")
        elif f in ("start_date", "end_date"):
            v = f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || strftime({c}, '%Y-%m-%d') || '\"' END"
        else:
            v = json_str(c)
        parts.append(lit(("" if i == 0 else ", ") + '"' + f + '": ') + " || " + v)
    return "sha256('{' || " + " || ".join(parts) + " || '}')"


# ---------------------------------------------------------------- feed
def _token(tok: str) -> str:
    q = "CAST(l_quantity AS INTEGER)"
    return {
        "N": "upper(p_name)",
        "Nc": "upper(substring(p_name, 1, 1)) || substring(p_name, 2)",
        "d": "CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR)",
        "q": f"CAST({q} AS VARCHAR)",
        "q10": f"CAST({q} * 10 AS VARCHAR)",
        "q20": f"CAST({q} * 20 AS VARCHAR)",
        "q100": f"CAST({q} * 100 AS VARCHAR)",
    }.get(tok, lit(tok))


def _date_text(d: str, which: str) -> str:
    abbr, full, eng = lst(THAI_MONTH_ABBR), lst(THAI_MONTH_FULL), lst(ENGLISH_MONTH_ABBR)
    if which == "abbr":
        return f"concat_ws(' ', CAST(day({d}) AS VARCHAR), {abbr}[month({d})], CAST(year({d}) + 543 AS VARCHAR))"
    if which == "full":
        return (f"concat_ws(' ', CAST(day({d}) AS VARCHAR), {full}[month({d})], "
                f"CAST((year({d}) + 543) % 100 AS VARCHAR))")
    if which == "slash":
        return f"strftime({d}, '%d/%m/%Y')"
    return f"concat_ws(' ', CAST(day({d}) AS VARCHAR), {eng}[month({d})], CAST(year({d}) AS VARCHAR))"


def tiles_sql() -> str:
    title = ("CASE tmpl " + " ".join(
        f"WHEN {i} THEN " + " || ".join(_token(t) for t in parts) for i, parts in enumerate(TEMPLATES))
             + " END")
    s, e = "start_d", "end_d"
    date_text = (f"CASE variant WHEN 0 THEN {_date_text(s, 'abbr')} || ' - ' || {_date_text(e, 'abbr')} "
                 f"WHEN 1 THEN {_date_text(s, 'full')} || ' ถึง ' || {_date_text(e, 'full')} "
                 f"WHEN 2 THEN 'ระยะเวลา: ' || {_date_text(s, 'slash')} || ' - ' || {_date_text(e, 'slash')} "
                 f"ELSE {_date_text(s, 'eng')} || ' until ' || {_date_text(e, 'eng')} END")

    def jdate(d):
        return (f"CASE variant WHEN 2 THEN strftime({d}, '%d/%m/%Y') "
                f"WHEN 3 THEN strftime({d}, '%Y-%m-%d') || 'T00:00:00' ELSE strftime({d}, '%Y-%m-%d') END")
    return f"""
j AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
         l.l_discount, l.l_shipdate, p.p_name, p.p_brand, p.p_type, p.p_size,
         {lst(SOURCE_NAMES)}[CAST(l.l_suppkey % {len(SOURCE_NAMES)} AS INTEGER) + 1] AS bank,
         CAST((l.l_orderkey + l.l_linenumber) % {len(TEMPLATES)} AS INTEGER) AS tmpl,
         CAST(l.l_partkey % 4 AS INTEGER) AS variant,
         CAST(l.l_shipdate AS DATE) AS start_d,
         CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INTEGER) AS end_d,
         'p' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS item_id
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
tiles AS (
  SELECT bank,
    CASE bank WHEN 'amex' THEN {lst(AMEX_HUBS)}[CAST(p_size % 4 AS INTEGER) + 1]
              WHEN 'krungsri' THEN {lst(KRUNGSRI_HUBS)}[CAST(p_size % 4 AS INTEGER) + 1]
              WHEN 'ktc' THEN {lst(KTC_HUBS)}[CAST(p_size % {len(KTC_HUBS)} AS INTEGER) + 1]
              ELSE 'main' END AS hub_slug,
    CASE WHEN bank = 'ktc' THEN CAST(p_size % {len(KTC_HUBS)} AS INTEGER)
         WHEN bank IN ('amex', 'krungsri') THEN CAST(p_size % 4 AS INTEGER) ELSE 0 END AS hub_ord,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate,
    item_id,
    {title} AS title_raw,
    {date_text} AS description_raw,
    {date_text} AS date_raw,
    {jdate(s)} AS start_raw,
    {jdate(e)} AS end_raw,
    CASE WHEN tmpl = {LINKLESS_TEMPLATE} THEN '' ELSE '/promotion/' || item_id
      || CASE WHEN l_linenumber % 2 = 0 THEN '.html' ELSE '' END
      || CASE WHEN l_linenumber % 3 = 0 THEN '?utm_source=feed' ELSE '' END END AS href,
    CASE p_size % 3 WHEN 0 THEN '/img/' || CAST(p_partkey_s AS VARCHAR) || '.jpg'
                    WHEN 1 THEN 'https://cdn.example.com/' || CAST(p_partkey_s AS VARCHAR) || '.png'
                    ELSE '' END AS image_raw,
    CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS category_raw,
    CASE p_size % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [p_brand]
                    ELSE [p_brand, {lit(CARD_EXTRA)}] END AS card_types,
    l_shipdate AS scraped_at,
    CAST(NULL AS VARCHAR) AS page_url,
    CAST(NULL AS VARCHAR) AS merchant_raw, CAST(NULL AS VARCHAR) AS slug,
    CAST(NULL AS DOUBLE) AS start_epoch, CAST(NULL AS DOUBLE) AS end_epoch,
    CAST(hub_ord AS BIGINT) * 17592186044416 + l_orderkey * 8 + l_linenumber AS seq
  FROM (SELECT *, l_partkey AS p_partkey_s FROM j)
)"""


# Typed out here, so that a wrong map on the Spark side shows.
CATEGORY_SQL = {
    "kasikorn": "nullif(category_raw, '')",
    "bbl": "nullif(category_raw, '')",
    "cardx": "nullif(category_raw, '')",
    "uob": "CAST(NULL AS VARCHAR)",
    "amex": "CASE hub_slug WHEN 'dining' THEN 'dining' WHEN 'travel' THEN 'travel' WHEN 'lifestyle' THEN 'shopping' "
            "WHEN 'explore-asia' THEN 'travel' ELSE hub_slug END",
    "krungsri": "coalesce(nullif(category_raw, ''), CASE hub_slug WHEN 'hot-promotion' THEN 'featured' "
                "WHEN 'dining' THEN 'dining' WHEN 'shopping-online' THEN 'shopping' WHEN 'travel' THEN 'travel' END)",
    "ktc": "coalesce(nullif(category_raw, ''), CASE WHEN hub_slug IN ('recommended', 'dining-restaurants', "
           "'online-shopping-services', 'air-ticket-hotels-travel', 'auto-gas-ev', 'shopping', 'insurance-investment', "
           "'electronics-mobile', 'health-beauty', 'home-furniture', 'sports-fitness', 'gold-diamond-jewelry', "
           "'entertainment-hobby', 'education', 'pet') THEN hub_slug END)",
}


def _by_source(fn) -> str:
    return "CASE bank " + " ".join(f"WHEN {lit(n)} THEN {fn(s)}" for n, s in SPECS.items()) + " END"


def promos_sql(src: str = "tiles", extra: str = "", order_cols: str | None = None,
               pre_ctes: str = "") -> str:
    """CTEs ``j``, ``tiles``, ``t1``, ``t2``, ``promos`` (normalised promotion rows)."""
    def description(s):
        return "title" if s.description_from_title else normalize("description_raw")

    def href_abs(s):
        return f"CASE WHEN href <> '' THEN {url_join(f'coalesce(page_url, {lit(s.promotion_url)})', 'href')} ELSE '' END"

    def valid(s):
        if s.kind == "json":
            return "(item_id <> '' AND title_raw <> '')"
        return f"(length(title) >= {s.min_title_len})"

    def source_id(s):
        if s.kind == "json":
            return "item_id"
        return source_id_from_url("href_abs", "title", s.strip_query, s.strip_html_ext, s.id_fallback_len)

    def source_url(s):
        if s.kind == "json":
            return f"{lit(s.base_url + JSON_URL_PATHS[s.name])} || coalesce(nullif(slug, ''), item_id)"
        return f"CASE WHEN href_abs <> '' THEN href_abs ELSE {lit(s.promotion_url)} END"

    def image(s):
        img = "nullif(image_raw, '')"
        if s.name == "cardx":
            return img
        return f"CASE WHEN starts_with({img}, '/') THEN {lit(s.base_url)} || {img} ELSE {img} END"

    def cards(s):
        return "coalesce(card_types, []::VARCHAR[])" if s.kind == "json" else "[]::VARCHAR[]"

    def category(s):
        return CATEGORY_SQL[s.name]

    def merchant_sql(s):
        if s.name == "ktc":
            return (f"CASE WHEN nullif(merchant_raw, '') IS NOT NULL THEN {normalize('merchant_raw')} "
                    f"ELSE {normalize('title_raw')} END")
        if s.name == "cardx":
            return "nullif(merchant_raw, '')"
        return merchant(s, 'title', 'description')

    def disc(s, which):
        head = "title_raw" if s.discount_on_raw_title else "title"
        return discount(f"({head} || ' ' || description)")[which]

    def spend(s):
        if not s.minimum_spend:
            return "CAST(NULL AS DOUBLE)"
        return min_spend("(title || ' ' || description)")

    def dates(s, which):
        if s.kind == "json":
            raw, ep = ("start_raw", "start_epoch") if which == 0 else ("end_raw", "end_epoch")
            return (f"coalesce({std_date(raw, s.date_formats)}, "
                    f"CAST(epoch_ms(CAST(floor({ep}) AS BIGINT)) AS DATE))")
        text = "description" if s.date_from_description else "date_raw"
        return date_range(text, s)[which]

    pre = tiles_sql() + (",\n" + SNAP_TILES if src == "snap_tiles" else "") + \
        ((",\n" + pre_ctes) if pre_ctes else "")
    return pre + f""",
t1 AS (
  SELECT *, {_by_source(description)} AS description, {_by_source(href_abs)} AS href_abs
  FROM (SELECT *, {normalize('title_raw')} AS title FROM {src})
),
t2 AS (
  SELECT *, {_by_source(source_id)} AS source_id FROM t1 WHERE {_by_source(valid)}
),
promos AS (
  SELECT sha256(concat_ws('/', bank, source_id)) AS id, bank, source_id,
    {_by_source(source_url)} AS source_url, title, description,
    {_by_source(image)} AS image_url,
    {_by_source(cards)} AS card_types,
    {_by_source(category)} AS category,
    {_by_source(merchant_sql)} AS merchant_name,
    {_by_source(lambda s: disc(s, 0))} AS discount_type,
    {_by_source(lambda s: disc(s, 1))} AS discount_value,
    {_by_source(spend)} AS minimum_spend,
    {_by_source(lambda s: dates(s, 0))} AS start_date,
    {_by_source(lambda s: dates(s, 1))} AS end_date,
    CAST(NULL AS VARCHAR) AS terms_and_conditions,
    scraped_at, {order_cols or ORDER_COLS}, seq{extra}
  FROM t2
)"""


def with_promos(select: str, extra_ctes: str = "") -> str:
    """``WITH <feed + promos> [, extra] <select>``; ``promos_ck`` adds the checksum."""
    ck = f"promos_ck AS (SELECT *, {checksum()} AS checksum FROM promos)"
    more = (",\n" + extra_ctes) if extra_ctes else ""
    return "WITH " + promos_sql() + ",\n" + ck + more + "\n" + select


# ---------------------------------------------------------------- snapshots / state
NOW_1 = "2026-03-01 06:00:00"
NOW_2 = "2026-03-02 06:00:00"
ORDER_COLS = ("hub_ord, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
              "l_extendedprice, l_discount, l_shipdate")
SNAP_TILES = """snap_tiles AS (
  SELECT *, 1 AS snap FROM tiles WHERE (l_orderkey * 31 + l_linenumber) % 10 <> 2
  UNION ALL
  SELECT * REPLACE (CASE WHEN (l_orderkey * 31 + l_linenumber) % 10 = 1 THEN '/img/v2.jpg'
                         ELSE image_raw END AS image_raw), 2 AS snap
  FROM tiles WHERE (l_orderkey * 31 + l_linenumber) % 10 <> 0
)"""
CONTENT_COLS = ["source_url", "title", "description", "image_url", "card_types", "category",
                "merchant_name", "discount_type", "discount_value", "minimum_spend", "start_date",
                "end_date", "terms_and_conditions", "checksum", "scraped_at"]


def state_ctes() -> str:
    """CTEs ``snaps`` (normalised rows of both snapshots with checksum), ``d``
    (first-seen per snapshot and key), ``state1``, ``d2``, ``state2``."""
    n1, n2 = f"TIMESTAMP '{NOW_1}'", f"TIMESTAMP '{NOW_2}'"
    return promos_sql("snap_tiles", ", snap") + f""",
snaps AS (SELECT *, {checksum()} AS checksum FROM promos),
d AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snap, bank, source_id ORDER BY {ORDER_COLS}) AS rn
    FROM snaps) WHERE rn = 1
),
state1 AS (
  SELECT * EXCLUDE (snap), true AS is_active, {n1} AS created_at, {n1} AS updated_at
  FROM d WHERE snap = 1
),
d2 AS (SELECT * FROM d WHERE snap = 2),
j2 AS (
  SELECT s.id AS s_id, n.id AS n_id,
    coalesce(s.bank, n.bank) AS k_bank, coalesce(s.source_id, n.source_id) AS k_source_id,
    (n.id IS NOT NULL AND (s.id IS NULL OR s.checksum <> n.checksum)) AS wrote,
    (s.id IS NOT NULL AND s.is_active AND n.id IS NULL
      AND s.bank IN (SELECT DISTINCT bank FROM d2)) AS gone,
    s.is_active AS s_active, s.created_at AS s_created, s.updated_at AS s_updated,
    {", ".join(f"s.{c} AS s_{c}, n.{c} AS n_{c}" for c in CONTENT_COLS)}
  FROM state1 s FULL OUTER JOIN d2 n ON s.bank = n.bank AND s.source_id = n.source_id
),
state2 AS (
  SELECT coalesce(s_id, n_id) AS id, k_bank AS bank, k_source_id AS source_id,
    {", ".join(f"CASE WHEN wrote THEN n_{c} ELSE s_{c} END AS {c}" for c in CONTENT_COLS)},
    CASE WHEN s_id IS NULL THEN true WHEN gone THEN false ELSE s_active END AS is_active,
    CASE WHEN s_id IS NULL THEN {n2} ELSE s_created END AS created_at,
    CASE WHEN wrote OR gone THEN {n2} ELSE s_updated END AS updated_at,
    gone AS deactivated
  FROM j2
)"""


def with_state(select: str, extra_ctes: str = "") -> str:
    more = (",\n" + extra_ctes) if extra_ctes else ""
    return "WITH " + state_ctes() + more + "\n" + select


# ---------------------------------------------------------------- runs
def runs_ctes() -> str:
    return f"""ev AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS id,
    {lst(SOURCE_NAMES)}[CAST(user_id % {len(SOURCE_NAMES)} AS INTEGER) + 1] AS bank, ts AS started_at,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'running'
         ELSE 'success' END AS final_status,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
  FROM events
),
runlog AS (
  SELECT id, bank, started_at, started_at AS event_time, CAST(NULL AS TIMESTAMP) AS finished_at,
    'running' AS status, 0 AS promotions_found, 0 AS promotions_new, 0 AS promotions_updated,
    CAST(NULL AS VARCHAR) AS error_message FROM ev
  UNION ALL
  SELECT id, bank, started_at, ft, ft, final_status,
    CASE WHEN ok THEN k ELSE 0 END, CASE WHEN ok THEN k % 5 ELSE 0 END, CASE WHEN ok THEN k % 3 ELSE 0 END,
    CASE WHEN NOT ok THEN 'fetch failed after ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 's' END
  FROM (SELECT *, started_at + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS ft,
               final_status = 'success' AS ok FROM ev WHERE final_status <> 'running')
),
runs AS (
  SELECT * EXCLUDE (rn, event_time) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_time DESC) AS rn FROM runlog) WHERE rn = 1
)"""


def with_runs(select: str, extra_ctes: str = "") -> str:
    more = (",\n" + extra_ctes) if extra_ctes else ""
    return "WITH " + runs_ctes() + more + "\n" + select


def duration_sql(s: str, f: str) -> str:
    secs = f"CAST(round((epoch_ms({f}) - epoch_ms({s})) / 1000.0) AS BIGINT)"
    return (f"CASE WHEN {f} IS NULL OR {secs} < 0 THEN '-' WHEN {secs} // 60 > 0 THEN "
            f"CAST({secs} // 60 AS VARCHAR) || 'm ' || CAST({secs} % 60 AS VARCHAR) || 's' "
            f"ELSE CAST({secs} % 60 AS VARCHAR) || 's' END")


# ---------------------------------------------------------------- page tiles
def page_tiles_ctes() -> str:
    from promospark.operators.tiles import ENTITIES, HTML_SOURCES, TileSelector
    sel = TileSelector()
    spaced = [x for x in HTML_SOURCES if SPECS[x].text_joiner == " "]
    text = "regexp_replace(inner_html, '<[^>]*>', CASE WHEN bank IN (" + ", ".join(lit(x) for x in spaced) + \
        ") THEN ' ' ELSE '' END, 'g')"
    for ent, ch in ENTITIES:
        text = f"replace({text}, {lit(ent)}, {lit(ch)})"
    return f"""pages_snap AS (
  SELECT {lst(HTML_SOURCES)}[CAST(page_id % {len(HTML_SOURCES)} AS INTEGER) + 1] AS bank,
    'main' AS hub_slug, 0 AS hub_ord, page_id, url,
    regexp_extract_all(html, {lit(sel.primary)}, 1) AS ph, regexp_extract_all(html, {lit(sel.primary)}, 2) AS pt,
    regexp_extract_all(html, {lit(sel.fallback)}, 1) AS fh, regexp_extract_all(html, {lit(sel.fallback)}, 2) AS ft
  FROM pages
),
pages_sel AS (
  SELECT *, CASE WHEN len(ph) > 0 THEN ph ELSE fh END AS hs, CASE WHEN len(ph) > 0 THEN pt ELSE ft END AS tx
  FROM pages_snap
),
page_tiles AS (
  SELECT bank, hub_slug, hub_ord, page_id, url, CAST(i - 1 AS INTEGER) AS pos, hs[i] AS href, tx[i] AS inner_html
  FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM pages_sel)
),
ptiles AS (
  SELECT bank, hub_slug, hub_ord, '' AS item_id, {text} AS title_raw, '' AS description_raw, '' AS date_raw,
    CAST(NULL AS VARCHAR) AS start_raw, CAST(NULL AS VARCHAR) AS end_raw, href, '' AS image_raw,
    CAST(NULL AS VARCHAR) AS category_raw, []::VARCHAR[] AS card_types,
    TIMESTAMP '2026-03-01 06:00:00' AS scraped_at, url AS page_url, page_id, pos,
    CAST(NULL AS VARCHAR) AS merchant_raw, CAST(NULL AS VARCHAR) AS slug,
    CAST(NULL AS DOUBLE) AS start_epoch, CAST(NULL AS DOUBLE) AS end_epoch,
    page_id * 1048576 + pos AS seq
  FROM page_tiles
)"""


def with_page_promos(select: str) -> str:
    body = promos_sql("ptiles", order_cols="hub_ord, page_id, pos", pre_ctes=page_tiles_ctes())
    ck = f"promos_ck AS (SELECT *, {checksum()} AS checksum FROM promos)"
    return "WITH " + body + ",\n" + ck + "\n" + select


def with_page_tiles(select: str) -> str:
    return "WITH " + page_tiles_ctes() + "\n" + select


# ---------------------------------------------------------------- html tiles
def html_tiles_ctes() -> str:
    """The tiles of the HTML pages, from the source columns alone: their places on the pages, and the slots that each
    site's tiles have (typed out here; uob and amex show no category, uob no date)."""
    return f"""hplaces AS (
  SELECT *, (l_orderkey // 32 * 8 + CASE bank WHEN 'kasikorn' THEN 0 WHEN 'krungsri' THEN 1 WHEN 'uob' THEN 2
      WHEN 'amex' THEN 3 ELSE 4 END) * 4 + hub_ord AS page_id
  FROM tiles WHERE bank IN ('kasikorn', 'krungsri', 'uob', 'amex', 'bbl')
),
htiles AS (
  SELECT * REPLACE (
      CASE WHEN bank IN ('uob', 'amex') THEN NULL ELSE {normalize('category_raw')} END AS category_raw,
      CASE WHEN bank = 'uob' THEN NULL ELSE date_raw END AS date_raw,
      CASE WHEN bank = 'bbl' THEN '' ELSE description_raw END AS description_raw,
      TIMESTAMP '2026-03-01 06:00:00' AS scraped_at),
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY {ORDER_COLS}) - 1 AS INTEGER) AS pos
  FROM hplaces
),
hpages AS (SELECT bank, hub_slug, page_id, count(*) AS n FROM htiles GROUP BY bank, hub_slug, page_id),
hrejects AS (
  SELECT bank, hub_slug, page_id, CAST(n AS INTEGER) AS pos, 'no title' AS reason, ' ' || chr(160) || ' ' AS title, '' AS href
  FROM hpages WHERE page_id % 5 = 0
  UNION ALL
  SELECT bank, hub_slug, page_id, CAST(n + (CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER), 'short title', 'ab', ''
  FROM hpages WHERE page_id % 7 = 0
)"""


def with_html_tiles(select: str) -> str:
    return "WITH " + tiles_sql() + ",\n" + html_tiles_ctes() + "\n" + select


def with_html_promos(select: str) -> str:
    body = promos_sql("htiles", extra=", page_id, pos", pre_ctes=html_tiles_ctes())
    return "WITH " + body + ",\n" + f"promos_ck AS (SELECT *, {checksum()} AS checksum FROM promos)" + "\n" + select


# ---------------------------------------------------------------- payloads
def _js(e: str) -> str:
    return "'\"' || " + e + " || '\"'"


def payload_ctes() -> str:
    from promospark.sources.feeds import PAYLOAD_ITEMS, PAYLOAD_SHAPES
    pk = "CAST(p_partkey AS VARCHAR)"
    slug = f"lower(replace(p_name, ' ', '-')) || '-' || {pk}"
    title = "'ส่วนลด ' || CAST(p_size AS VARCHAR) || '% ' || upper(p_name)"
    desc = "'สำหรับ ' || p_type"
    start, end = "(DATE '2024-01-01' + p_size)", "(DATE '2024-01-01' + p_size + 30)"

    def iso(d):
        return f"strftime({d}, '%Y-%m-%d')"

    def epoch(d):
        return f"CAST(epoch_ms(CAST({d} AS TIMESTAMP)) AS VARCHAR)"
    pieces = [
        f"CASE WHEN v <> 3 THEN '\"id\": ' || {_js("'pp' || " + pk)} ELSE '\"_id\": ' || {_js("'x' || " + pk)} END",
        f"'\"slug\": ' || {_js(slug)}",
        f"CASE WHEN v = 1 THEN '\"name\": ' ELSE '\"title\": ' END || {_js(title)}",
        f"CASE WHEN v = 2 THEN '\"short_description\": ' ELSE '\"description\": ' END || {_js(desc)}",
        (f"CASE v WHEN 0 THEN '\"image\": {{\"url\": ' || {_js("'/img/' || " + pk + " || '.jpg'")} || '}}' "
         f"WHEN 1 THEN '\"thumbnail\": ' || {_js("'https://cdn.example.com/' || " + pk + " || '.png'")} "
         f"WHEN 2 THEN '\"image\": ' || {_js("'/img/' || " + pk + " || '.png'")} "
         f"ELSE '\"cover_image\": {{\"src\": ' || {_js("'/img/' || " + pk + " || '.gif'")} || '}}' END"),
        (f"CASE WHEN v % 2 = 0 THEN '\"category\": {{\"name\": ' || {_js('p_type')} || ', \"slug\": ' || "
         f"{_js('lower(p_type)')} || '}}' ELSE '\"category\": ' || {_js('lower(p_type)')} END"),
        (f"CASE v WHEN 0 THEN '\"card_types\": [{{\"name\": ' || {_js('p_brand')} || "
         f"'}}, {{\"name\": \"Platinum\"}}]' WHEN 1 THEN '\"card_types\": ' || {_js('p_brand')} "
         f"WHEN 2 THEN '\"cards\": [' || {_js('p_brand')} || ', \"Platinum\"]' END"),
        (f"CASE v WHEN 0 THEN '\"merchant\": {{\"name\": ' || {_js('upper(p_name)')} || '}}' "
         f"WHEN 1 THEN '\"merchantName\": ' || {_js('p_brand')} END"),
        (f"CASE v WHEN 0 THEN '\"start_date\": ' || {_js(iso(start))} || ', \"end_date\": ' || {_js(iso(end))} "
         f"WHEN 1 THEN '\"startDate\": ' || {_js(iso(start) + " || 'T00:00:00'")} || ', \"endDate\": ' || "
         f"{_js(iso(end) + " || 'T00:00:00'")} "
         f"WHEN 2 THEN '\"startDate\": ' || {epoch(start)} || ', \"endDate\": ' || {epoch(end)} "
         f"ELSE '\"start_date\": ' || {_js("strftime(" + start + ", '%d/%m/%Y')")} END"),
    ]
    item = "'{' || concat_ws(', ', " + ", ".join(pieces) + ") || '}'"

    def page(body):
        return ("'<html><head><script id=\"__NEXT_DATA__\" type=\"application/json\">' || " + body +
                " || '</script></head><body></body></html>'")
    doc = (f"CASE shape WHEN 0 THEN {page("'{\"props\": {\"pageProps\": {\"promotions\": ' || arr || '}}}'")} "
           f"WHEN 1 THEN {page("'{\"props\": {\"pageProps\": {\"promotions\": [], \"data\": {\"promotions\": ' || arr || '}}}}'")} "
           f"WHEN 2 THEN {page("'{\"props\": {\"pageProps\": {\"meta\": {\"n\": 1}, \"featured\": ' || arr || '}}}'")} "
           "WHEN 3 THEN '{\"data\": {\"items\": ' || arr || '}, \"meta\": {\"total\": 0}}' "
           "WHEN 4 THEN '{\"results\": ' || arr || '}' "
           "ELSE '{\"data\": {\"allPromos\": {\"edges\": ' || edges || '}}}' END")
    return f"""pitems AS (
  SELECT p_partkey, {item} AS item FROM (SELECT *, CAST(p_partkey % 4 AS INTEGER) AS v FROM part)
),
pgroups AS (
  SELECT p_partkey // {PAYLOAD_ITEMS} AS payload_id,
    '[' || string_agg(item, ', ' ORDER BY p_partkey) || ']' AS arr,
    '[' || string_agg('{{"node": ' || item || '}}', ', ' ORDER BY p_partkey) || ']' AS edges
  FROM pitems GROUP BY 1
),
docs AS (
  SELECT CASE WHEN shape <= 2 THEN 'ktc' ELSE 'cardx' END AS bank, payload_id AS seq, {doc} AS payload
  FROM (SELECT *, CAST(payload_id % {PAYLOAD_SHAPES} AS INTEGER) AS shape FROM pgroups)
)"""


def _arr(doc: str, path: str, nonempty: bool) -> str:
    cond = f"json_type({doc}, {lit(path)}) = 'ARRAY'"
    if nonempty:
        cond += f" AND json_array_length({doc}, {lit(path)}) > 0"
    return f"CASE WHEN {cond} THEN json_extract({doc}, {lit(path)}) END"


def located_ctes() -> str:
    from promospark.operators.payloads import (CARDX_INNER, CARDX_WRAPPERS, KTC_FIRST_LIST_KEYS,
                                               KTC_LIST_PATHS, NEXT_DATA_RE)
    nd = f"nullif(regexp_extract(payload, {lit(NEXT_DATA_RE)}, 1), '')"
    pp = "json_extract(nd, '$.props.pageProps')"
    key_hit = (f"list_filter(json_keys({pp}), lambda k: json_type({pp}, '$.\"' || k || '\"') = 'ARRAY' "
               f"AND json_type({pp}, '$.\"' || k || '\"[0]') = 'OBJECT' AND len(list_intersect("
               f"json_keys(json_extract({pp}, '$.\"' || k || '\"[0]')), {lst(KTC_FIRST_LIST_KEYS)})) > 0)[1]")
    ktc = ("coalesce(" + ", ".join(_arr("nd", p, True) for p in KTC_LIST_PATHS) +
           f", json_extract({pp}, '$.\"' || {key_hit} || '\"'))")
    cands = [_arr("payload", "$", False)]
    for k in CARDX_WRAPPERS:
        cands.append(_arr("payload", f"$.{k}", False))
        for inner in CARDX_INNER:
            cands.append(_arr("payload", f"$.{k}.{inner}", False))
    data = "json_extract(payload, '$.data')"
    dkey = (f"list_filter(json_keys({data}), lambda k: json_type({data}, '$.\"' || k || '\".edges') = 'ARRAY' "
            f"OR json_type({data}, '$.\"' || k || '\"') = 'ARRAY')[1]")
    hit = f"json_extract({data}, '$.\"' || {dkey} || '\"')"
    graph = (f"CASE WHEN json_type({hit}, '$.edges') = 'ARRAY' THEN to_json(list_transform("
             f"json_extract({hit}, '$.edges[*]'), lambda e: coalesce(json_extract(e, '$.node'), e))) "
             f"WHEN json_type({hit}) = 'ARRAY' THEN {hit} END")
    cardx = "coalesce(" + ", ".join(cands) + f", {graph})"
    return f"""located AS (
  SELECT bank, seq, CASE WHEN bank = 'ktc' THEN {ktc} ELSE {cardx} END AS lst
  FROM (SELECT *, {nd} AS nd FROM docs)
),
pitems_x AS (
  SELECT bank, seq, CAST(i - 1 AS INTEGER) AS pos, its[i] AS item FROM (
    SELECT bank, seq, json_extract(lst, '$[*]') AS its,
           unnest(generate_series(1, CAST(coalesce(json_array_length(lst), 0) AS BIGINT))) AS i
    FROM located)
)"""


def _truthy(v: str) -> str:
    return (f"CASE json_type({v}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN CASE WHEN json_extract_string({v}, '$') <> '' THEN {v} END "
            f"WHEN 'ARRAY' THEN CASE WHEN json_array_length({v}) > 0 THEN {v} END "
            f"WHEN 'OBJECT' THEN CASE WHEN len(json_keys({v})) > 0 THEN {v} END "
            f"WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string({v}, '$') = 'true' THEN {v} END "
            f"ELSE CASE WHEN CAST(json_extract_string({v}, '$') AS DOUBLE) <> 0 THEN {v} END END")


def _first_truthy(item: str, keys) -> str:
    return "coalesce(" + ", ".join(_truthy(f"json_extract({item}, {lit('$.' + k)})") for k in keys) + ")"


def _as_text(v: str) -> str:
    return f"json_extract_string({v}, '$')"


def _unwrap(v: str, names) -> str:
    return f"CASE WHEN json_type({v}) = 'OBJECT' THEN {_as_text(_first_truthy(v, names))} ELSE {_as_text(v)} END"


def payload_tiles_ctes() -> str:
    from promospark.operators.payloads import ALIASES

    def per(fn):
        return f"CASE WHEN bank = 'ktc' THEN {fn('ktc')} ELSE {fn('cardx')} END"

    def text(src, key):
        return _as_text(_first_truthy("item", ALIASES[src][key]))

    def cards(src):
        v = _first_truthy("item", ALIASES[src]["cards"])
        return (f"CASE WHEN {v} IS NULL THEN []::VARCHAR[] WHEN json_type({v}) = 'ARRAY' THEN "
                f"list_transform(json_extract({v}, '$[*]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN "
                f"coalesce(json_extract_string(x, '$.name'), CAST(x AS VARCHAR)) ELSE json_extract_string(x, '$') END) "
                f"ELSE [{_as_text(v)}] END")

    def date_text(src, key):
        v = _first_truthy("item", ALIASES[src][key])
        return f"CASE WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN NULL ELSE {_as_text(v)} END"

    def epoch(src, key):
        if src != "cardx":
            return "CAST(NULL AS DOUBLE)"
        v = _first_truthy("item", ALIASES[src][key])
        return f"CASE WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({_as_text(v)} AS DOUBLE) END"

    def slug(src):
        return "json_extract_string(item, '$.slug')" if src == "ktc" else text(src, "slug")
    merchant_names = {"ktc": ["name", "title"], "cardx": ["name"]}
    return f"""jtiles AS (
  SELECT bank, CAST(NULL AS VARCHAR) AS hub_slug, 0 AS hub_ord,
    coalesce({per(lambda s: text(s, 'id'))}, '') AS item_id,
    coalesce({per(lambda s: text(s, 'title'))}, '') AS title_raw,
    coalesce({per(lambda s: text(s, 'description'))}, '') AS description_raw, '' AS date_raw,
    {per(lambda s: date_text(s, 'start'))} AS start_raw, {per(lambda s: date_text(s, 'end'))} AS end_raw,
    {per(lambda s: epoch(s, 'start'))} AS start_epoch, {per(lambda s: epoch(s, 'end'))} AS end_epoch,
    '' AS href,
    coalesce({per(lambda s: _unwrap(_first_truthy('item', ALIASES[s]['image']), ['url', 'src']))}, '') AS image_raw,
    {per(lambda s: _unwrap(_first_truthy('item', ALIASES[s]['category']), ['name', 'slug']))} AS category_raw,
    {per(cards)} AS card_types,
    {per(lambda s: _unwrap(_first_truthy('item', ALIASES[s]['merchant']), merchant_names[s]))} AS merchant_raw,
    {per(slug)} AS slug,
    TIMESTAMP '2026-03-01 06:00:00' AS scraped_at, CAST(NULL AS VARCHAR) AS page_url, seq AS pseq, pos,
    seq * 1048576 + pos AS seq
  FROM pitems_x
)"""


def with_payload_items(select: str) -> str:
    return "WITH " + payload_ctes() + ",\n" + located_ctes() + "\n" + select


def with_payload_promos(select: str) -> str:
    pre = payload_ctes() + ",\n" + located_ctes() + ",\n" + payload_tiles_ctes()
    body = promos_sql("jtiles", order_cols="hub_ord, pseq, pos", pre_ctes=pre)
    ck = f"promos_ck AS (SELECT *, {checksum()} AS checksum FROM promos)"
    return "WITH " + body + ",\n" + ck + "\n" + select


# ---------------------------------------------------------------- KTC hub pages
def ktc_cards_ctes() -> str:
    """Promotion rows of the cards, from the source columns alone."""
    title = normalize("title_raw")
    return f"""kcards AS (
  SELECT *, CASE WHEN href <> '' THEN string_split(rtrim(href, '/'), '/')[-1] ELSE substring(title, 1, 50) END AS source_id,
    'https://www.ktc.co.th' || href AS source_url, title AS merchant_name
  FROM (
    SELECT 'ktc' AS bank, {title} AS title, '' AS description, href,
      CASE WHEN image_raw = '' THEN NULL WHEN starts_with(image_raw, '/') THEN 'https://www.ktc.co.th' || image_raw ELSE image_raw END
        AS image_url, []::VARCHAR[] AS card_types, hub_slug AS category, CAST(NULL AS VARCHAR) AS discount_type,
      CAST(NULL AS VARCHAR) AS discount_value, CAST(NULL AS DOUBLE) AS minimum_spend, CAST(NULL AS DATE) AS start_date,
      CAST(NULL AS DATE) AS end_date, CAST(NULL AS VARCHAR) AS terms_and_conditions, hub_ord + 1 AS page_hub,
      (l_orderkey // 32 * 16 + hub_ord + 1) + 1099511627776 AS pseq, {ORDER_COLS}
    FROM tiles WHERE bank = 'ktc')
  WHERE title <> ''
)"""


def with_ktc_cards(select: str) -> str:
    return ("WITH " + tiles_sql() + ",\n" + ktc_cards_ctes() + ",\n"
            + f"kcards_ck AS (SELECT *, {checksum()} AS checksum FROM kcards)" + "\n" + select)


def with_ktc_hubs(select: str) -> str:
    """``kfirst``: the first row of each source_id over hubs, pages and places."""
    pre = payload_ctes() + ",\n" + located_ctes() + ",\n" + payload_tiles_ctes() + """,
khub AS (
  SELECT * REPLACE (CASE WHEN (pseq // 16) % 2 = 1 THEN NULL ELSE category_raw END AS category_raw,
                    CAST(pseq % 16 AS INTEGER) AS hub_ord),
    """ + lst(["main", *KTC_HUBS]) + """[pseq % 16 + 1] AS slug_of_hub
  FROM jtiles WHERE bank = 'ktc'
)"""
    return "WITH " + tiles_sql() + ",\n" + pre + ",\n" + ktc_cards_ctes() + """,
kall AS (
  SELECT item_id AS source_id, """ + normalize("title_raw") + """ AS title,
    coalesce(nullif(category_raw, ''), CASE WHEN slug_of_hub <> 'main' THEN slug_of_hub END) AS category,
    hub_ord, pseq, row_number() OVER (ORDER BY hub_ord, pseq, pos) AS place
  FROM khub WHERE item_id <> '' AND title_raw <> ''
  UNION ALL
  SELECT source_id, title, category, page_hub, pseq, row_number() OVER (ORDER BY page_hub, pseq, """ + ORDER_COLS + """)
  FROM kcards
),
kfirst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hub_ord, pseq, place) AS rn FROM kall) WHERE rn = 1
)
""" + select
