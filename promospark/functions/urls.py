"""URL functions (X8-X13) as native Spark Columns.

``url_join`` follows RFC 3986 reference resolution the way ``urljoin`` does:
absolute references pass through, ``//host`` takes the base scheme, ``/path``
takes the base origin, relative paths are merged with the base directory; dot
segments are removed with an ``aggregate`` fold over the path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_dot_segments(segments: Column, drop_empty_middle: Column) -> Column:
    """Resolve '.' and '..' in a list of path segments; returns the joined path."""
    n = F.size(segments)
    kept = F.when(drop_empty_middle,
                  F.filter(segments, lambda x, i: (i == 0) | (i == n - 1) | (x != "")))
    kept = kept.otherwise(segments)
    folded = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, s: (F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                .otherwise(acc))
                        .when(s == ".", acc)
                        .otherwise(F.array_append(acc, s))))
    last = F.element_at(kept, -1)
    folded = F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def url_join(base, href) -> Column:
    """Resolve ``href`` against ``base`` (both string Columns or literals)."""
    base = F.lit(base) if isinstance(base, str) else base
    href = _c(href)
    scheme = F.regexp_extract(base, _SCHEME, 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base_no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_tail = F.substring(href, F.length(href_path) + 1, 1 << 30)
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    is_abs_path = F.startswith(href_path, F.lit("/"))
    merged = F.when(is_abs_path, href_path).otherwise(F.concat(base_dir, href_path))
    segs = F.split(merged, "/")
    # The segment fold only runs for paths that hold '.'/'..' segments or, for
    # relative references, empty middle segments; other paths are used as-is.
    needs_fold = merged.rlike(r"(^|/)\.\.?(/|$)") | (~is_abs_path & merged.rlike(r".//"))
    resolved = F.when(needs_fold, remove_dot_segments(segs, ~is_abs_path)).otherwise(
        F.when(merged == "", F.lit("/")).otherwise(merged))
    # A path from the root without dot segments stands behind the origin as it is.
    plain = F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit("//")) & ~F.contains(href, F.lit("/."))
    return (F.when(href == "", base)
            .when(plain, F.concat(origin, href))
            .when(href.rlike(_SCHEME), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
            .when(F.startswith(href, F.lit("?")), F.concat(base_no_query, href))
            .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
            .otherwise(F.concat(origin, resolved, href_tail)))


def last_segment(url) -> Column:
    """Last path segment after stripping trailing slashes."""
    stripped = F.regexp_replace(_c(url), "/+$", "")
    return F.substring_index(stripped, "/", -1)


def source_id_from_url(url, title, strip_query: bool, strip_html_ext: bool,
                       fallback_len: int = 80, fallback_on_empty: bool | None = None) -> Column:
    """Id from the link's last segment; no link (or, for sources that strip
    the query, an empty segment) falls back to the title prefix."""
    return id_or_title(url, id_segment(url, strip_query, strip_html_ext), title, strip_query, fallback_len, fallback_on_empty)


def id_segment(url, strip_query: bool, strip_html_ext: bool) -> Column:
    """The last segment without what the source strips."""
    seg = last_segment(url)
    if strip_query:
        seg = F.regexp_replace(seg, r"\?.*$", "")
    if strip_html_ext:
        seg = F.regexp_replace(seg, r"\.html?$", "")
    return seg


def id_or_title(url, seg, title, strip_query: bool, fallback_len: int = 80, fallback_on_empty: bool | None = None) -> Column:
    """The segment, or the title prefix where ``source_id_from_url`` falls back to it."""
    url, seg = _c(url), _c(seg)
    fb = F.substring(_c(title), 1, fallback_len)
    on_empty = strip_query if fallback_on_empty is None else fallback_on_empty
    has = (url.isNotNull() & (url != ""))
    if on_empty:
        return F.when(has & (seg != ""), seg).otherwise(fb)
    return F.when(has, seg).otherwise(fb)


def first_nonempty(*cols) -> Column:
    """First attribute that is present and non-empty (empty falls through)."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def absolutize_image(img, base_url: str) -> Column:
    """Prefix the site base when the image path starts with '/'."""
    img = _c(img)
    return F.when(F.startswith(img, F.lit("/")), F.concat(F.lit(base_url), img)).otherwise(img)


def css_background_url(style) -> Column:
    """url(...) from a CSS style, quotes and spaces trimmed."""
    raw = F.regexp_extract(_c(style), r"url\(([^)]+)\)", 1)
    return F.nullif(F.regexp_replace(raw, r"^[ '\"]+|[ '\"]+$", ""), F.lit(""))
