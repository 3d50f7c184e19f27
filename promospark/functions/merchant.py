"""Merchant-name rules (M1-M7) as one CASE expression per source.

For each source the ordered patterns are tried on ``title + ' ' + description``;
each pattern contributes its first match only. The candidate is trimmed, its
right end stripped of the spec's characters, and rejected when it hits the
source's blocklist (case-insensitive), in which case the next pattern is tried.
Fallbacks: ALL-CAPS title prefix, short title (Amex), title (KTC).
Everything is a native regexp expression; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from promospark.functions.text import normalize_text
from promospark.sources.specs import SourceSpec, get_spec


def _blocked(cand: Column, blocklist: str | None) -> Column:
    if not blocklist:
        return F.lit(False)
    return cand.rlike("(?iu)" + blocklist)


def _rstrip_chars(col: Column, chars: str) -> Column:
    cls = "[" + re.escape(chars) + "]+$"
    return F.regexp_replace(col, cls, "")


def merchant_for_spec(spec: SourceSpec, title, description) -> Column:
    """Merchant name Column for one source spec."""
    title = F.col(title) if isinstance(title, str) else title
    description = F.col(description) if isinstance(description, str) else description
    text = F.trim(F.concat_ws(" ", title, description))
    result = None
    for pat in spec.merchant_patterns:
        raw = F.regexp_extract(text, "(?U)" + pat, 1)
        cand = _rstrip_chars(F.trim(raw), spec.merchant_rstrip)
        ok = (cand != "") & ~_blocked(cand, spec.blocklist)
        val = F.substring(cand, 1, 255)
        result = F.when(ok, val) if result is None else result.when(ok, val)
    fallback = F.lit(None).cast("string")
    if spec.caps_prefix:
        cand = F.trim(F.regexp_extract(title, "(?U)" + spec.caps_prefix, 1))
        fallback = F.when((cand != "") & ~_blocked(cand, spec.blocklist), cand)
    elif spec.title_is_merchant_max:
        fallback = F.when((title != "") & (F.length(title) <= spec.title_is_merchant_max)
                          & ~_blocked(title, spec.blocklist),
                          F.substring(F.trim(title), 1, 255))
    elif spec.merchant_from_title:
        fallback = normalize_text(title)
    if result is None:
        return fallback
    return result.otherwise(fallback)


def _needed_word(pattern: str) -> str:
    """The literal that each of the specs' patterns begins with, after a lookbehind."""
    return re.match(r"(?:\(\?<!.*?\))?([^\\\[(]+)", pattern).group(1)


def merchant_candidates(spec: SourceSpec, title: Column, text: Column) -> Column:
    """The candidates of the spec's patterns in their order, the ALL-CAPS prefix last; null or '' where there is none.
    A pattern runs only on text that holds the word it begins with."""
    found = [F.when(F.contains(text, F.lit(_needed_word(pat))),
                    _rstrip_chars(F.trim(F.regexp_extract(text, "(?U)" + pat, 1)), spec.merchant_rstrip))
             for pat in spec.merchant_patterns]
    if spec.caps_prefix:
        found.append(F.trim(F.regexp_extract(title, "(?U)" + spec.caps_prefix, 1)))
    return F.array(*found)


def merchant_of(spec: SourceSpec, title: Column, candidates: Column) -> Column:
    """The choice of ``merchant_for_spec`` among ``merchant_candidates``."""
    result = None
    for k in range(len(spec.merchant_patterns) + bool(spec.caps_prefix)):
        cand = F.get(candidates, F.lit(k))
        ok = (cand != "") & ~_blocked(cand, spec.blocklist)
        val = F.substring(cand, 1, 255) if k < len(spec.merchant_patterns) else cand
        result = F.when(ok, val) if result is None else result.when(ok, val)
    if spec.title_is_merchant_max and not spec.caps_prefix:
        result = result.when((title != "") & (F.length(title) <= spec.title_is_merchant_max)
                             & ~_blocked(title, spec.blocklist), F.substring(F.trim(title), 1, 255))
    return result


def merchant_name(source, title, description, sources=None) -> Column:
    """Merchant Column dispatched on the row's source name (CASE over specs)."""
    source = F.col(source) if isinstance(source, str) else source
    names = sources or ["kasikorn", "krungsri", "uob", "amex", "bbl", "ktc", "cardx"]
    out = None
    for name in names:
        expr = merchant_for_spec(get_spec(name), title, description)
        out = F.when(source == name, expr) if out is None else out.when(source == name, expr)
    return out
