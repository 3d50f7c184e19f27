"""Source specifications: each promotion source is data, not a class.

A ``SourceSpec`` tells the shared Spark plan how to turn that source's tiles or
payload items into promotion rows: which merchant patterns and blocklist to
use, how dates are split and parsed, how links become ``source_id``s, and how
the hub category is stamped. Unknown source names raise before any write.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced: site bases,
# hub lists, merchant patterns, terminators and blocklists are stated as-is.
# ---------------------------------------------------------------------------

SOURCE_NAMES = ["kasikorn", "krungsri", "uob", "amex", "bbl", "ktc", "cardx"]

BASE_URLS = {
    "kasikorn": "https://www.kasikornbank.com",
    "krungsri": "https://www.krungsri.com",
    "uob": "https://www.uob.co.th",
    "amex": "https://www.americanexpress.com",
    "bbl": "https://www.bangkokbank.com",
    "ktc": "https://www.ktc.co.th",
    "cardx": "https://www.cardx.co.th",
}

PROMOTION_URLS = {
    "kasikorn": "https://www.kasikornbank.com/th/promotion/creditcard/Pages/index.aspx",
    "krungsri": "https://www.krungsri.com/th/promotions/cards/hot-promotion",
    "uob": "https://www.uob.co.th/personal/promotions/creditcard/all-promotion.page",
    "amex": "https://www.americanexpress.com/th-th/benefits/promotions/dining.html",
    "bbl": "https://www.bangkokbank.com/en/Personal/Cards/Credit-Cards/Promotions",
    "ktc": "https://www.ktc.co.th/promotion",
    "cardx": "https://www.cardx.co.th/credit-card/promotion",
}

# Hubs in crawl order: (source, hub_slug, category stamped from the hub).
KTC_HUBS = [
    "recommended", "dining-restaurants", "online-shopping-services",
    "air-ticket-hotels-travel", "auto-gas-ev", "shopping", "insurance-investment",
    "electronics-mobile", "health-beauty", "home-furniture", "sports-fitness",
    "gold-diamond-jewelry", "entertainment-hobby", "education", "pet",
]
AMEX_HUBS = ["dining", "travel", "lifestyle", "explore-asia"]
AMEX_HUB_CATEGORY = {"dining": "dining", "travel": "travel", "lifestyle": "shopping",
                     "explore-asia": "travel"}
KRUNGSRI_HUBS = ["hot-promotion", "dining", "shopping-online", "travel"]
KRUNGSRI_HUB_CATEGORY = {"hot-promotion": "featured", "dining": "dining", "shopping-online": "shopping",
                         "travel": "travel"}

# Python-style ``\s`` (str.isspace): tab..CR, U+001C..U+001F, space, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000 (literal characters).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　]"
# U+200B, U+200C, U+200D, U+FEFF; THAI_RANGE is U+0E00..U+0E7F.
ZERO_WIDTH_CLASS = r"[​‌‍﻿]"
THAI_RANGE = r"฀-๿"

# Merchant name shapes and terminators shared by krungsri, uob, amex, bbl.
MERCHANT_END = (r"(?=\s+\d|\s+ตั้งแต่|\s+วันที่|\s+สาขา|\s+เมื่อ|\s+เพียง|"
                r"\s+ทุก|\s+และ|\s+หรือ|\s*$)")
MERCHANT_SHAPES = (r"([A-Z][A-Z0-9\s&.\-']{2,60}"
                   r"|[A-Z][a-zA-Z0-9\s&.\-']{2,60}?"
                   r"|[฀-๿0-9\s&.\-']{3,60}?)")
# Kasikorn: two shapes and a wider terminator list.
KASIKORN_END = (r"(?=\s+\d|\s+ใช้จ่าย|\s+รับ|\s+ครบ|\s+เมื่อ|\s+ใน|\s+ของ|"
                r"\s+ตั้งแต่|\s+วันที่|\s+สาขา|\s+ผ่อน|\s+นาน|\s*[\-–]|\s*$)")
KASIKORN_SHAPES = r"([A-Z][A-Z0-9\s&.\-']{2,60}|[฀-๿0-9\s&.\-']{3,60}?)"
# BBL English form.
BBL_AT = (r"at\s+([A-Z][A-Za-z0-9\s&.\-']{2,60}?)"
          r"(?=\s+\d|\s+[\.,]|\s+during|\s+until|\s+for|\s*$)")
# ALL-CAPS title prefix.
CAPS_PREFIX = r"^([A-Z][A-Z0-9\s&.\-']{2,60}?)(?=\s+[฀-๿]|\s+ผ่อน|\s+รับ|\s+0%|\s*$)"
CAPS_PREFIX_KASIKORN = (r"^([A-Z][A-Z0-9\s&.\-']{2,60}?)"
                        r"(?=\s+[฀-๿]|\s+ผ่อน|\s+รับ|\s+0%|\s+ผ่อ|\s*$)")

THAI_MONTH_WORDS = ("มกราคม|กุมภาพันธ์|มีนาคม|เมษายน|พฤษภาคม|มิถุนายน|"
                    "กรกฎาคม|สิงหาคม|กันยายน|ตุลาคม|พฤศจิกายน|ธันวาคม")
ENGLISH_MONTH_WORDS = ("January|February|March|April|May|June|July|August|"
                       "September|October|November|December")

BLOCKLISTS = {
    "kasikorn": r"บัตรเครดิต|บัตรเดบิต|K\+?\s*SHOP|KBank|กสิกรไทย|เครดิตเงินคืน|ร้านค้า",
    "krungsri": r"บัตรเครดิต|บัตรเดบิต|กรุงศรี|Krungsri|BAY|KMA",
    "uob": r"บัตรเครดิต|บัตรเดบิต|ยูโอบี|UOB|Cash\s*Plus|" + THAI_MONTH_WORDS,
    "amex": r"บัตรเครดิต|บัตรเดบิต|อเมริกัน|Amex|American\s*Express|Platinum|" + THAI_MONTH_WORDS,
    "bbl": (r"บัตรเครดิต|บัตรเดบิต|ธนาคารกรุงเทพ|Bangkok\s*Bank|BBL|" + THAI_MONTH_WORDS
            + "|" + ENGLISH_MONTH_WORDS),
}

# Date-range separators (split into at most two parts).
SPLIT_PADDED = r"\s+[-–~]\s+|\s+ถึง\s+"
SPLIT_BBL = r"\s+until\s+|\s+ถึง\s+|\s+[-–~]\s+"
SPLIT_KASIKORN = r"\s*[-–~ถึง]\s*"     # a character class: quirk kept as is
AMEX_DATE_PREFIX = r"^\s*ระยะเวลา\s*[:：]?\s*"

# strptime-style formats, in the order they are tried.
FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD = "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d"
FMT_D_MON_Y, FMT_D_MONTH_Y = "%d %b %Y", "%d %B %Y"
FMT_ISO_T, FMT_ISO_FRAC_Z = "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceSpec:
    name: str
    base_url: str
    promotion_url: str
    kind: str = "html"                     # html | json
    merchant_patterns: tuple = ()          # ordered regexes, group 1 = candidate
    merchant_rstrip: str = ",.* "          # chars stripped from the candidate's right
    blocklist: str | None = None
    caps_prefix: str | None = None         # ALL-CAPS title fallback (after patterns)
    title_is_merchant_max: int | None = None   # amex: short title is the merchant
    merchant_from_title: bool = False      # ktc: merchant falls back to the title
    text_joiner: str = ""                  # '' or ' ' when tags are removed (X6)
    min_title_len: int = 3
    split_regex: str = SPLIT_PADDED
    date_prefix: str | None = None
    thai_dates: bool = True
    english_first: bool = False
    date_formats: tuple = (FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD)
    date_from_description: bool = False
    strip_query: bool = False
    strip_html_ext: bool = False
    id_fallback_len: int = 80
    hub_category_mode: str = "none"        # always | if_empty | none (the tile's own) | never
    hub_categories: dict = field(default_factory=dict)
    hubs: tuple = ()
    discount_on_raw_title: bool = False
    minimum_spend: bool = True
    description_from_title: bool = False


def _thai_prepositions(shapes: str, end: str) -> tuple:
    return (r"ที่\s+" + shapes + end, r"ร่วมกับ\s+" + shapes + end)


SPECS: dict[str, SourceSpec] = {
    "kasikorn": SourceSpec(
        "kasikorn", BASE_URLS["kasikorn"], PROMOTION_URLS["kasikorn"],
        merchant_patterns=(
            r"ที่\s+" + KASIKORN_SHAPES + KASIKORN_END,
            r"ร่วมกับ\s+" + KASIKORN_SHAPES + KASIKORN_END,
            r"จาก\s+" + KASIKORN_SHAPES + KASIKORN_END,
            r"(?<!ร่วม)กับ\s+" + KASIKORN_SHAPES + KASIKORN_END,
            r"@\s*" + KASIKORN_SHAPES + KASIKORN_END,
        ),
        merchant_rstrip=",.*-– ", blocklist=BLOCKLISTS["kasikorn"],
        caps_prefix=CAPS_PREFIX_KASIKORN, split_regex=SPLIT_KASIKORN),
    "krungsri": SourceSpec(
        "krungsri", BASE_URLS["krungsri"], PROMOTION_URLS["krungsri"],
        merchant_patterns=_thai_prepositions(MERCHANT_SHAPES, MERCHANT_END),
        blocklist=BLOCKLISTS["krungsri"], caps_prefix=CAPS_PREFIX,
        hub_category_mode="if_empty", hubs=tuple(KRUNGSRI_HUBS),
        hub_categories=KRUNGSRI_HUB_CATEGORY),
    "uob": SourceSpec(
        "uob", BASE_URLS["uob"], PROMOTION_URLS["uob"],
        merchant_patterns=_thai_prepositions(MERCHANT_SHAPES, MERCHANT_END),
        blocklist=BLOCKLISTS["uob"], text_joiner=" ",
        date_formats=(FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD, FMT_D_MON_Y, FMT_D_MONTH_Y),
        date_from_description=True, strip_query=True, hub_category_mode="never"),
    "amex": SourceSpec(
        "amex", BASE_URLS["amex"], PROMOTION_URLS["amex"],
        merchant_patterns=_thai_prepositions(MERCHANT_SHAPES, MERCHANT_END),
        blocklist=BLOCKLISTS["amex"], title_is_merchant_max=80, text_joiner=" ",
        date_prefix=AMEX_DATE_PREFIX, thai_dates=False,
        date_formats=(FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD, FMT_D_MON_Y, FMT_D_MONTH_Y),
        strip_query=True, strip_html_ext=True,
        hub_category_mode="always", hubs=tuple(AMEX_HUBS), hub_categories=AMEX_HUB_CATEGORY),
    "bbl": SourceSpec(
        "bbl", BASE_URLS["bbl"], PROMOTION_URLS["bbl"],
        merchant_patterns=_thai_prepositions(MERCHANT_SHAPES, MERCHANT_END) + (BBL_AT,),
        blocklist=BLOCKLISTS["bbl"], text_joiner=" ", split_regex=SPLIT_BBL,
        english_first=True,
        date_formats=(FMT_D_MON_Y, FMT_D_MONTH_Y, FMT_DMY_SLASH, FMT_DMY_DASH, FMT_YMD),
        strip_query=True, description_from_title=True),
    "ktc": SourceSpec(
        "ktc", BASE_URLS["ktc"], PROMOTION_URLS["ktc"], kind="json",
        merchant_from_title=True, min_title_len=1, thai_dates=False,
        date_formats=(FMT_YMD, FMT_ISO_T, FMT_ISO_FRAC_Z, FMT_DMY_SLASH),
        id_fallback_len=50, hub_category_mode="if_empty", hubs=tuple(KTC_HUBS),
        hub_categories={s: s for s in KTC_HUBS},
        discount_on_raw_title=True, minimum_spend=False),
    "cardx": SourceSpec(
        "cardx", BASE_URLS["cardx"], PROMOTION_URLS["cardx"], kind="json",
        min_title_len=1, thai_dates=False,
        date_formats=(FMT_YMD, FMT_ISO_T, FMT_ISO_FRAC_Z, FMT_DMY_SLASH),
        discount_on_raw_title=True, minimum_spend=False),
}


def get_spec(name: str) -> SourceSpec:
    """Spec by source name; unknown names raise before any work is planned."""
    try:
        return SPECS[name]
    except KeyError:
        raise KeyError(f"Unknown source '{name}'. Available: {', '.join(SPECS)}") from None


def list_sources() -> list[str]:
    return list(SPECS)
