"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole input tables; each SQL string is the independent DuckDB formulation
with identical column names. Computed columns are aliased on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from promospark.functions.text import normalize_text
from promospark.functions.urls import absolutize_image
from promospark.operators import aggregates as A
from promospark.operators import query as Q
from promospark.operators.dedup import first_seen, key_duplicates
from promospark.operators.extract import by_source, normalize_tiles
from promospark.operators.upsert import initial_state, plan_upsert, upsert_counts
from promospark.operators import runs as R
from promospark.plans import audit as U
from promospark.plans import ingest as I
from promospark.session import tune
from promospark.plans import oracle as O
from promospark.sources.feeds import load_promo_tiles

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        def run(spark, sf_dir):
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def _cards_text(c="card_types"):
    return F.array_join(F.col(c), "|").alias("card_types_text")


_CARDS_SQL = "array_to_string(card_types, '|') AS card_types_text"


def promotions(spark, sf_dir):
    return normalize_tiles(load_promo_tiles(spark, sf_dir))


def state(spark, sf_dir):
    return I.promotions_table(spark, sf_dir)


# ------------------------------------------------------------------ extraction
_PROMO_COLS = ["id", "bank", "source_id", "source_url", "title", "description", "image_url",
               "category", "merchant_name", "discount_type", "discount_value", "minimum_spend",
               "start_date", "end_date", "scraped_at", "checksum"]


@register("extract_promotions", O.with_promos(
    f"SELECT {', '.join(_PROMO_COLS)}, {_CARDS_SQL}, seq FROM promos_ck"))
def q_extract_promotions(spark, sf_dir):
    """S1/X5-X13/T1-T6/M1-M7/D-*/P2/P3/U1: the full normalised feed."""
    return promotions(spark, sf_dir).select(*_PROMO_COLS, _cards_text(), "seq")


@register("discount_stats", O.with_promos(
    "SELECT bank, discount_type, count(*) AS n_rows, count(discount_value) AS n_values, "
    "count(DISTINCT discount_value) AS n_distinct_values, sum(minimum_spend) AS total_min_spend, "
    "count(merchant_name) AS n_merchants FROM promos GROUP BY bank, discount_type"))
def q_discount_stats(spark, sf_dir):
    """Flagship slice: per source and discount type, over the whole feed."""
    p = promotions(spark, sf_dir)
    return p.groupBy("bank", "discount_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("discount_value").alias("n_values"),
        F.countDistinct("discount_value").alias("n_distinct_values"),
        F.sum("minimum_spend").alias("total_min_spend"),
        F.count("merchant_name").alias("n_merchants"))


@register("text_discount", O.with_promos(
    "SELECT bank, source_id, seq, title, discount_type, discount_value, minimum_spend FROM promos"))
def q_text_discount(spark, sf_dir):
    """T1-T6 per row."""
    return promotions(spark, sf_dir).select("bank", "source_id", "seq", "title", "discount_type",
                                            "discount_value", "minimum_spend")


@register("merchant_names", O.with_promos(
    "SELECT bank, source_id, seq, merchant_name FROM promos"))
def q_merchant_names(spark, sf_dir):
    """M1-M7 per row."""
    return promotions(spark, sf_dir).select("bank", "source_id", "seq", "merchant_name")


@register("date_ranges", O.with_promos(
    "SELECT bank, source_id, seq, start_date, end_date FROM promos"))
def q_date_ranges(spark, sf_dir):
    """D-1..D-10 per row."""
    return promotions(spark, sf_dir).select("bank", "source_id", "seq", "start_date", "end_date")


@register("checksums", O.with_promos("SELECT bank, source_id, seq, checksum FROM promos_ck"))
def q_checksums(spark, sf_dir):
    """U1 per row."""
    return promotions(spark, sf_dir).select("bank", "source_id", "seq", "checksum")


@register("key_duplicates", O.with_promos(
    "SELECT bank, source_id, count(*) AS n_rows FROM promos GROUP BY bank, source_id HAVING count(*) > 1"))
def q_key_duplicates(spark, sf_dir):
    """Keys that repeat in the raw feed."""
    return key_duplicates(promotions(spark, sf_dir))


@register("first_seen", O.with_promos(
    "SELECT bank, source_id, seq, title, checksum FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY bank, source_id ORDER BY {O.ORDER_COLS}) AS rn "
    "FROM promos_ck) WHERE rn = 1"))
def q_first_seen(spark, sf_dir):
    """First row per key in hub then tile order."""
    p = promotions(spark, sf_dir).select("bank", "source_id", "seq", "title", "checksum", "ord")
    return first_seen(p).select("bank", "source_id", "seq", "title", "checksum")


# ------------------------------------------------------------------ state maintenance
_STATE_OUT = ["id", "bank", "source_id", "checksum", "title", "image_url", "is_active",
              "created_at", "updated_at"]


@register("upsert_next_state", O.with_state(f"SELECT {', '.join(_STATE_OUT)} FROM state2"))
def q_upsert_next_state(spark, sf_dir):
    """The table after run 2 (inserts, updates, soft deletes)."""
    return state(spark, sf_dir).select(*_STATE_OUT)


@register("upsert_run_counts", O.with_state(
    "SELECT k AS bank, "
    "count(*) FILTER (WHERE s_id IS NULL AND n_id IS NOT NULL) AS promotions_new, "
    "count(*) FILTER (WHERE s_id IS NOT NULL AND n_id IS NOT NULL AND wrote) AS promotions_updated, "
    "count(*) FILTER (WHERE n_id IS NOT NULL) AS promotions_found, "
    "count(*) FILTER (WHERE gone) AS promotions_deactivated "
    "FROM (SELECT *, k_bank AS k FROM j2) GROUP BY k"))
def q_upsert_run_counts(spark, sf_dir):
    """Per source new / updated / found / deactivated of run 2."""
    state1, raw2 = I.feed_state1(spark, sf_dir), I.stored_snapshot(spark, sf_dir, 2)

    def counts(of_pass):
        run2 = I.feed_run2(of_pass(state1), of_pass(raw2), found=raw2)
        gone = run2.state.groupBy("bank").agg(F.count_if("deactivated").alias("promotions_deactivated"))
        return upsert_counts(run2.plan).join(gone, "bank", "full_outer")
    names = ["promotions_new", "promotions_updated", "promotions_found", "promotions_deactivated"]
    return I.in_passes(spark, sf_dir, counts).groupBy("bank").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))


_U4_SQL = O.with_state(
    "SELECT bank, source_id, bool_or(stored_c IS NULL) AS is_new, "
    "count(*) FILTER (WHERE coalesce(prev, stored_c) IS NOT NULL AND coalesce(prev, stored_c) <> checksum) "
    "AS n_updates, count(*) AS n_rows, "
    "arg_max(checksum, rk) FILTER (WHERE wrote) AS winner_checksum "
    "FROM (SELECT *, (rk = 1 AND stored_c IS NULL) OR (coalesce(prev, stored_c) IS NOT NULL "
    "AND coalesce(prev, stored_c) <> checksum) AS wrote FROM u4rows) GROUP BY bank, source_id",
    extra_ctes=(
        "u4rows AS (SELECT r.*, s.checksum AS stored_c FROM ("
        f"SELECT bank, source_id, checksum, row_number() OVER w AS rk, lag(checksum) OVER w AS prev "
        f"FROM snaps WHERE snap = 2 WINDOW w AS (PARTITION BY bank, source_id ORDER BY {O.ORDER_COLS})) r "
        "LEFT JOIN state1 s ON r.bank = s.bank AND r.source_id = s.source_id)"))


@register("upsert_batch_repeats", _U4_SQL)
def q_upsert_batch_repeats(spark, sf_dir):
    """U4: run 2's raw snapshot (repeated keys kept) planned against state 1 with
    sequential in-batch semantics; per key new flag, update count, rows, winner."""
    state1, raw2 = I.feed_state1(spark, sf_dir), I.stored_snapshot(spark, sf_dir, 2)
    return I.in_passes(spark, sf_dir, lambda of_pass: plan_upsert(of_pass(state1), of_pass(raw2)).select(
        "bank", "source_id", "is_new", "n_updates", "n_rows", F.col("w.checksum").alias("winner_checksum")))


@register("deactivated_keys", O.with_state("SELECT bank, source_id FROM state2 WHERE deactivated"))
def q_deactivated_keys(spark, sf_dir):
    """Keys soft-deleted by run 2."""
    state1, raw2 = I.feed_state1(spark, sf_dir), I.stored_snapshot(spark, sf_dir, 2)
    return I.in_passes(spark, sf_dir, lambda of_pass: I.feed_run2(of_pass(state1), of_pass(raw2), found=raw2)
                       .state.filter("deactivated").select("bank", "source_id"))


_AUDIT_SQL = O.with_state(
    "SELECT sha256(concat_ws('/', '{now}', bank)) AS id, bank, 'success' AS status, "
    "CAST(count(*) AS INTEGER) AS promotions_found, "
    "CAST({new} AS INTEGER) AS promotions_new, CAST({upd} AS INTEGER) AS promotions_updated "
    "FROM (SELECT d2.*, s.checksum AS stored_c FROM d2 LEFT JOIN state1 s "
    "ON d2.bank = s.bank AND d2.source_id = s.source_id) GROUP BY bank")


def _audit_sql(new: str, upd: str) -> str:
    return _AUDIT_SQL.replace("{now}", I.NOW_2).replace("{new}", new).replace("{upd}", upd)


@register("run_audit", _audit_sql("count(*) FILTER (WHERE stored_c IS NULL)",
                                  "count(*) FILTER (WHERE stored_c IS NOT NULL AND stored_c <> checksum)"))
def q_run_audit(spark, sf_dir):
    """One audit row per source for run 2."""
    state1, raw2 = I.feed_state1(spark, sf_dir), I.stored_snapshot(spark, sf_dir, 2)
    audits = I.in_passes(spark, sf_dir, lambda of_pass: I.feed_run2(of_pass(state1), of_pass(raw2)).audit)
    return I.audit_sums(audits.select("id", "bank", "status", "promotions_found", "promotions_new", "promotions_updated"))


@register("run_life_cycle", O.with_state(
    "SELECT r.bank, CASE WHEN r.bank = 'bbl' THEN 'failed' ELSE 'success' END AS status, "
    f"TIMESTAMP '{I.NOW_2}' AS started_at, TIMESTAMP '{I.NOW_2}' + INTERVAL 90 SECOND AS finished_at, 2 AS n_events, "
    "CAST(coalesce(c.n, 0) AS INTEGER) AS promotions_found, CAST(coalesce(c.n_new, 0) AS INTEGER) AS promotions_new, "
    "CAST(coalesce(c.n_upd, 0) AS INTEGER) AS promotions_updated, CASE WHEN r.bank = 'bbl' THEN 'timed out' END AS error_message "
    "FROM (SELECT unnest(['kasikorn', 'krungsri', 'uob', 'amex', 'bbl', 'ktc', 'cardx']) AS bank) r LEFT JOIN ("
    "SELECT d2.bank, count(*) AS n, count(*) FILTER (WHERE s.checksum IS NULL) AS n_new, "
    "count(*) FILTER (WHERE s.checksum <> d2.checksum) AS n_upd FROM d2 LEFT JOIN state1 s "
    "ON d2.bank = s.bank AND d2.source_id = s.source_id WHERE d2.bank NOT IN ('bbl', 'cardx') GROUP BY d2.bank) c ON r.bank = c.bank"))
def q_run_life_cycle(spark, sf_dir):
    """Start and finish events of run 2, folded to one row for every requested source. One source's fetch
    failed and one brought no rows; the start events are those that a run commits before it reads its snapshot."""
    state1, raw2 = I.feed_state1(spark, sf_dir), I.stored_snapshot(spark, sf_dir, 2).where("bank <> 'cardx'")
    requested = U.requested_sources(spark)
    failed = requested.where("bank = 'bbl'").withColumn("error_message", F.lit("timed out"))
    audits = I.in_passes(spark, sf_dir, lambda of_pass: I.run_ingest(
        of_pass(state1), first_seen(of_pass(raw2)), I.NOW_2, failed, deduplicated=True, found=raw2).audit)
    finished = I.NOW_2.replace("06:00:00", "06:01:30")
    events = U.start_events(requested, I.NOW_2).unionByName(
        U.finish_events(requested, I.audit_sums(audits).where("status = 'success'"), failed, I.NOW_2, finished))
    n = events.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_events"))
    return R.fold_runs(events).join(n, "id").select("bank", "status", "started_at", "finished_at", "n_events", "promotions_found",
                                                    "promotions_new", "promotions_updated", "error_message")


@register("dry_run_audit", _audit_sql("0", "0"))
def q_dry_run_audit(spark, sf_dir):
    """A dry run counts what it found and reports no new or updated rows."""
    raw1, raw2 = (I.stored_snapshot(spark, sf_dir, snap) for snap in (1, 2))

    def audit(of_pass):
        state1 = initial_state(first_seen(of_pass(raw1)), I.NOW_1)
        return I.run_ingest(state1, first_seen(of_pass(raw2)), I.NOW_2, dry_run=True, deduplicated=True).audit
    return I.audit_sums(I.in_passes(spark, sf_dir, audit).select("id", "bank", "status", "promotions_found", "promotions_new",
                                                                 "promotions_updated"))


@register("failed_source_isolation", O.with_state(
    "SELECT k_bank AS bank, count(*) FILTER (WHERE gone AND k_bank <> 'uob') AS promotions_deactivated, "
    "count(*) FILTER (WHERE n_id IS NOT NULL AND k_bank <> 'uob' AND wrote) AS promotions_written "
    "FROM j2 GROUP BY k_bank"))
def q_failed_source_isolation(spark, sf_dir):
    """Run 2 with one source failing: it writes and deactivates nothing,
    the other sources proceed."""
    raw1, raw2 = (I.stored_snapshot(spark, sf_dir, snap) for snap in (1, 2))
    failed = spark.range(1).select(F.lit("uob").alias("bank"), F.lit("fetch failed").alias("error_message"))

    def counts(of_pass):
        state1 = initial_state(first_seen(of_pass(raw1)), I.NOW_1)
        res = I.run_ingest(state1, first_seen(of_pass(raw2)), I.NOW_2, failed=failed, deduplicated=True, found=raw2)
        # Rows that are new or updated are those written; told without their contents, which need not be shuffled then.
        written = res.plan.groupBy("bank").agg(F.count_if(F.col("is_new") | (F.col("n_updates") > 0)).alias("promotions_written"))
        gone = res.state.groupBy("bank").agg(F.count_if("deactivated").alias("promotions_deactivated"))
        return gone.join(written, "bank", "left")
    return I.in_passes(spark, sf_dir, counts).groupBy("bank").agg(
        F.sum("promotions_deactivated").cast("long").alias("promotions_deactivated"),
        F.coalesce(F.sum("promotions_written"), F.lit(0)).cast("long").alias("promotions_written"))


# ------------------------------------------------------------------ filters, sort, paging
_KEY_OUT = ["id", "bank", "source_id"]


def _filter_query(name: str, f: Q.PromotionFilter, where: str, doc: str):
    @register(name, O.with_state(f"SELECT id, bank, source_id FROM state2 WHERE {where}"))
    def q(spark, sf_dir):
        return Q.filter_promotions(state(spark, sf_dir), f).select(*_KEY_OUT)
    q.__doc__ = doc
    return q


_filter_query("filter_bank", Q.PromotionFilter(bank="krungsri"), "bank = 'krungsri'", "F1")
_filter_query("filter_category", Q.PromotionFilter(category="dining"), "category = 'dining'", "F2")
_filter_query("filter_merchant_contains", Q.PromotionFilter(merchant_name="widget"),
              "merchant_name ILIKE '%widget%'", "F3")
_filter_query("filter_discount_type", Q.PromotionFilter(discount_type="cashback"),
              "discount_type = 'cashback'", "F4")
_filter_query("filter_card_type", Q.PromotionFilter(card_type="brand#1"),
              "len(list_filter(card_types, lambda x: x ILIKE '%brand#1%')) > 0", "F5 element-wise")
_filter_query("filter_card_type_json_text", Q.PromotionFilter(card_type="brand#1", card_type_json_text=True),
              "CAST(to_json(card_types) AS VARCHAR) ILIKE '%brand#1%'", "F5 JSON-text compat")
_filter_query("filter_search", Q.PromotionFilter(search="bolt"),
              "(title ILIKE '%bolt%' OR description ILIKE '%bolt%')", "F6")
_filter_query("filter_inactive", Q.PromotionFilter(is_active=False), "is_active = false", "F7")
_filter_query("filter_start_date_range",
              Q.PromotionFilter(start_date_from="1996-01-01", start_date_to="1997-12-31"),
              "start_date >= DATE '1996-01-01' AND start_date <= DATE '1997-12-31'", "F8")
_filter_query("filter_end_date_range",
              Q.PromotionFilter(end_date_from="1998-01-01", end_date_to="1999-06-30"),
              "end_date >= DATE '1998-01-01' AND end_date <= DATE '1999-06-30'", "F9")
_filter_query("filter_min_spend_range", Q.PromotionFilter(min_spend_min=1000, min_spend_max=3000),
              "minimum_spend >= 1000 AND minimum_spend <= 3000", "F10")
_filter_query("filter_combined",
              Q.PromotionFilter(bank="kasikorn", is_active=True, discount_type="percentage",
                                min_spend_min=0, search="%"),
              "bank = 'kasikorn' AND is_active AND discount_type = 'percentage' AND minimum_spend >= 0 "
              "AND (title ILIKE '%%%' OR description ILIKE '%%%')", "F1+F4+F6+F7+F10 ANDed")

_SORTS = {
    "title_asc": ("title", "asc", "title ASC NULLS FIRST, id ASC"),
    "end_date_desc": ("end_date", "desc", "end_date DESC NULLS LAST, id ASC"),
    "created_at_asc": ("created_at", "asc", "created_at ASC NULLS FIRST, id ASC"),
    "unknown_field_desc": ("foo", "desc", "scraped_at DESC NULLS LAST, id ASC"),
}


def _page_query(name, sort_key, page, size, f: Q.PromotionFilter, where: str):
    col, order, sql_order = _SORTS[sort_key]

    @register(name, O.with_state(
        f"SELECT id, bank, source_id, title, end_date FROM state2 WHERE {where} "
        f"ORDER BY {sql_order} LIMIT {size} OFFSET {(page - 1) * size}"))
    def q(spark, sf_dir):
        rows, _ = Q.query_promotions(state(spark, sf_dir), f, col, order, page, size)
        return rows.select("id", "bank", "source_id", "title", "end_date")
    q.__doc__ = "O1/O2: sorted page"
    return q


_page_query("page_title_asc_p2", "title_asc", 2, 20, Q.PromotionFilter(), "true")
_page_query("page_end_date_desc_p1", "end_date_desc", 1, 50, Q.PromotionFilter(bank="amex"),
            "bank = 'amex'")
_page_query("page_created_asc_p3", "created_at_asc", 3, 10, Q.PromotionFilter(is_active=True), "is_active")
_page_query("page_default_sort_p1", "unknown_field_desc", 1, 100, Q.PromotionFilter(discount_type="points"),
            "discount_type = 'points'")


@register("page_total", O.with_state(
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM state2 "
    "WHERE bank = 'amex' AND is_active"))
def q_page_total(spark, sf_dir):
    """O3/A4: total before paging and page count."""
    _, total = Q.query_promotions(state(spark, sf_dir), Q.PromotionFilter(bank="amex", is_active=True))
    return total


@register("by_id", O.with_state("SELECT id, bank, source_id, title FROM state2 "
                                "WHERE id = (SELECT min(id) FROM state2)"))
def q_by_id(spark, sf_dir):
    """one row by id (the smallest id of the table as the parameter)."""
    t = state(spark, sf_dir)
    return Q.by_id(t, t.agg(F.min("id").alias("id"))).select("id", "bank", "source_id", "title")


@register("list_by_bank", O.with_state(
    "SELECT id, bank, source_id, scraped_at FROM state2 WHERE bank = 'amex' AND is_active"))
def q_list_by_bank(spark, sf_dir):
    """active rows of one bank, newest first."""
    return Q.list_by_bank(state(spark, sf_dir), "amex").select("id", "bank", "source_id", "scraped_at")


@register("latest_display", O.with_state(
    "SELECT id, bank, substring(title, 1, 40) AS title_40, coalesce(category, '-') AS category_text, "
    "CASE WHEN discount_type IS NOT NULL THEN discount_type || ': ' || coalesce(discount_value, 'None') "
    "ELSE '-' END AS discount_text, coalesce(strftime(end_date, '%Y-%m-%d'), '-') AS end_date_text "
    "FROM state2 WHERE is_active ORDER BY scraped_at DESC NULLS LAST, id ASC LIMIT 20"))
def q_latest_display(spark, sf_dir):
    """Latest 20 active promotions as display columns."""
    return Q.display_rows(state(spark, sf_dir), 20)


@register("expiry_status", O.with_state(
    "SELECT id, bank, source_id, end_date, CASE WHEN end_date IS NULL THEN 'none' "
    "WHEN end_date < DATE '1998-06-01' THEN 'expired' "
    "WHEN datediff('day', DATE '1998-06-01', end_date) <= 7 THEN 'expiring' ELSE 'active' END "
    "AS expiry_status FROM state2"))
def q_expiry_status(spark, sf_dir):
    """Expiry status of every promotion against a given day."""
    return Q.expiry_status(state(spark, sf_dir), "1998-06-01")


# ------------------------------------------------------------------ aggregates
@register("bank_stats", O.with_state(
    "SELECT bank, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM state2 GROUP BY bank"))
def q_bank_stats(spark, sf_dir):
    """A1: per bank total and active."""
    return A.bank_stats(state(spark, sf_dir))


@register("facets", O.with_state(
    "SELECT DISTINCT facet, value FROM ("
    "SELECT 'bank' AS facet, bank AS value FROM state2 UNION ALL "
    "SELECT 'category', category FROM state2 UNION ALL "
    "SELECT 'discount_type', discount_type FROM state2 UNION ALL "
    "SELECT 'merchant_name', merchant_name FROM state2 UNION ALL "
    "SELECT 'card_types', unnest(card_types) FROM state2) "
    "WHERE value IS NOT NULL AND (facet <> 'card_types' OR value <> '')"))
def q_facets(spark, sf_dir):
    """A2/A3: distinct facet values in one scan (inactive rows included)."""
    return A.facets(state(spark, sf_dir))


@register("card_type_facet", O.with_state(
    "SELECT DISTINCT card_type FROM (SELECT unnest(card_types) AS card_type FROM state2) "
    "WHERE card_type IS NOT NULL AND card_type <> ''"))
def q_card_type_facet(spark, sf_dir):
    """A3: distinct non-empty card types."""
    return A.card_type_facet(state(spark, sf_dir))


def _pct_sql(n, d):
    return f"CASE WHEN {d} = 0 THEN '—' ELSE printf('%.1f', CAST(100 * {n} AS DOUBLE) / {d}) || '%' END"


_COVERAGE_CTE = (
    "cov AS (SELECT coalesce(nullif(bank, ''), 'unknown') AS bank, count(*) AS total, "
    "count(*) FILTER (WHERE merchant_name IS NULL OR merchant_name = '') AS merchant_null, "
    "count(*) FILTER (WHERE card_types IS NULL OR len(card_types) = 0) AS card_types_empty "
    "FROM state2 GROUP BY 1)")


@register("coverage", O.with_state("SELECT * FROM cov", _COVERAGE_CTE))
def q_coverage(spark, sf_dir):
    """A5: per bank rows, merchant missing, card types empty."""
    return A.coverage(state(spark, sf_dir))


@register("coverage_report", O.with_state(
    "SELECT bank, CAST(total AS BIGINT) AS total, CAST(merchant_null AS BIGINT) AS merchant_null, "
    "CAST(card_types_empty AS BIGINT) AS card_types_empty, "
    f"{_pct_sql('merchant_null', 'total')} AS merchant_null_pct, "
    f"{_pct_sql('card_types_empty', 'total')} AS card_types_empty_pct FROM ("
    "SELECT * FROM cov UNION ALL SELECT 'ALL', sum(total), sum(merchant_null), sum(card_types_empty) FROM cov)",
    _COVERAGE_CTE))
def q_coverage_report(spark, sf_dir):
    """Per-bank coverage with percent texts and a grand-total row."""
    return A.coverage_report(state(spark, sf_dir))


@register("missing_merchant_samples", O.with_state(
    "SELECT bank, title, sample_rank FROM (SELECT coalesce(nullif(bank, ''), 'unknown') AS bank, "
    "trim(coalesce(title, '')) AS title, row_number() OVER (PARTITION BY coalesce(nullif(bank, ''), 'unknown') "
    "ORDER BY scraped_at DESC NULLS LAST, id ASC) AS sample_rank FROM state2 "
    "WHERE (merchant_name IS NULL OR merchant_name = '') AND trim(coalesce(title, '')) <> '') "
    "WHERE sample_rank <= 10"))
def q_missing_merchant_samples(spark, sf_dir):
    """First 10 titles per bank among rows without a merchant (API order)."""
    return A.missing_merchant_samples(state(spark, sf_dir),
                                      [F.col("scraped_at").desc_nulls_last(), F.col("id")], 10)


@register("low_coverage_banks", O.with_state(
    "SELECT * FROM cov WHERE total > 0 AND merchant_null / total > 0.2", _COVERAGE_CTE))
def q_low_coverage_banks(spark, sf_dir):
    """Banks with more than 20% of rows missing a merchant."""
    return A.low_coverage_banks(state(spark, sf_dir), 0.2)


# ------------------------------------------------------------------ runs
from promospark.sources.feeds import load_run_events  # noqa: E402
from promospark.sources.specs import SOURCE_NAMES  # noqa: E402

RUNS_NOW = "2024-01-30 12:00:00"
_RUN_OUT = ["id", "bank", "started_at", "finished_at", "status", "promotions_found",
            "promotions_new", "promotions_updated", "error_message"]


def runs(spark, sf_dir):
    return R.fold_runs(load_run_events(spark, sf_dir))


@register("run_state_fold", O.with_runs(f"SELECT {', '.join(_RUN_OUT)} FROM runs"))
def q_run_state_fold(spark, sf_dir):
    """Run rows folded from the append-only start/finish audit log."""
    return runs(spark, sf_dir).select(*_RUN_OUT)


@register("runs_page", O.with_runs(
    "SELECT id, bank, status, started_at FROM runs WHERE bank = 'ktc' AND status = 'success' "
    "AND started_at >= TIMESTAMP '2024-01-05 00:00:00' AND started_at <= TIMESTAMP '2024-01-20 00:00:00' "
    "ORDER BY started_at DESC NULLS LAST, id ASC LIMIT 20 OFFSET 20"))
def q_runs_page(spark, sf_dir):
    """Filtered runs, newest first, page 2 of 20."""
    f = R.filter_runs(runs(spark, sf_dir), "ktc", "success", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return Q.page_of(f, R.newest_first(), 2, 20).select("id", "bank", "status", "started_at")


@register("runs_total", O.with_runs(
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM runs "
    "WHERE bank = 'ktc' AND status = 'success' AND started_at >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND started_at <= TIMESTAMP '2024-01-20 00:00:00'"))
def q_runs_total(spark, sf_dir):
    """Total of the filtered runs and page count."""
    f = R.filter_runs(runs(spark, sf_dir), "ktc", "success", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return Q.total_and_pages(f, 20)


@register("running_banks", O.with_runs(
    "SELECT DISTINCT bank FROM runs WHERE status = 'running' "
    f"AND started_at > TIMESTAMP '{RUNS_NOW}' - INTERVAL 30 MINUTE"))
def q_running_banks(spark, sf_dir):
    """R2: banks with a non-stale running run at ``now``."""
    return R.running_banks(runs(spark, sf_dir), RUNS_NOW)


@register("stale_runs", O.with_runs(
    "SELECT id, bank, started_at FROM runs WHERE status = 'running' "
    f"AND started_at <= TIMESTAMP '{RUNS_NOW}' - INTERVAL 30 MINUTE"))
def q_stale_runs(spark, sf_dir):
    """Runs still marked running past the stale threshold."""
    return R.stale_runs(runs(spark, sf_dir), RUNS_NOW).select("id", "bank", "started_at")


_REQUESTED = SOURCE_NAMES + ["scb"]


@register("trigger_check", O.with_runs(
    "SELECT r.bank, CASE WHEN r.bank NOT IN (" + ", ".join(O.lit(s) for s in SOURCE_NAMES) + ") "
    "THEN 'unknown' WHEN r.bank IN (SELECT bank FROM runs WHERE status = 'running' "
    f"AND started_at > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 30 MINUTE) THEN 'conflict' "
    "ELSE 'ok' END AS verdict FROM (SELECT unnest(" + O.lst(_REQUESTED) + ") AS bank) r"))
def q_trigger_check(spark, sf_dir):
    """Verdict per requested bank against known sources and running runs."""
    requested = spark.createDataFrame([(b,) for b in _REQUESTED], "bank STRING")
    known = spark.createDataFrame([(b,) for b in SOURCE_NAMES], "bank STRING")
    running = R.running_banks(runs(spark, sf_dir), "2024-01-10 12:00:00")
    return R.trigger_check(requested, known, running)


@register("run_durations", O.with_runs(
    f"SELECT id, {O.duration_sql('started_at', 'finished_at')} AS duration FROM runs"))
def q_run_durations(spark, sf_dir):
    """Duration text of every run."""
    r = runs(spark, sf_dir)
    return r.select("id", R.duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"))


@register("latest_runs", O.with_runs(
    "SELECT id, bank, status, started_at FROM runs ORDER BY started_at DESC NULLS LAST, id ASC LIMIT 20"))
def q_latest_runs(spark, sf_dir):
    """Latest 20 runs of all banks."""
    return R.latest_runs(runs(spark, sf_dir), 20).select("id", "bank", "status", "started_at")


@register("latest_runs_bank", O.with_runs(
    "SELECT id, bank, status, started_at FROM runs WHERE bank = 'amex' "
    "ORDER BY started_at DESC NULLS LAST, id ASC LIMIT 5"))
def q_latest_runs_bank(spark, sf_dir):
    """Latest 5 runs of one bank."""
    return R.latest_runs(runs(spark, sf_dir), 5, "amex").select("id", "bank", "status", "started_at")


@register("runs_display", O.with_runs(
    "SELECT id, bank, status, promotions_found, promotions_new, promotions_updated, "
    "strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_text, "
    "substring(coalesce(error_message, '-'), 1, 40) AS error_text, "
    f"{O.duration_sql('started_at', 'finished_at')} AS duration FROM runs "
    "ORDER BY started_at DESC NULLS LAST, id ASC LIMIT 10"))
def q_runs_display(spark, sf_dir):
    """Latest 10 runs as display columns."""
    return R.runs_display(runs(spark, sf_dir), 10)


@register("repeated_failures", O.with_runs(
    "SELECT bank, count(*) AS consecutive_failures, arg_min(error_message, rn) AS last_error FROM ("
    "SELECT *, row_number() OVER (PARTITION BY bank ORDER BY started_at DESC NULLS LAST, id ASC) AS rn "
    "FROM runs) WHERE rn <= 3 GROUP BY bank HAVING count(*) >= 3 AND bool_and(status = 'failed')"))
def q_repeated_failures(spark, sf_dir):
    """Banks whose latest three runs all failed."""
    return R.repeated_failures(runs(spark, sf_dir), 3)


@register("failure_alerts", O.with_runs(
    "SELECT id, bank, started_at, consecutive_failures, error_message AS last_error FROM ("
    "SELECT *, k - coalesce(max(CASE WHEN status <> 'failed' THEN k END) OVER (PARTITION BY bank ORDER BY k), 0) AS consecutive_failures "
    "FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY started_at, id DESC) AS k FROM runs WHERE started_at IS NOT NULL)) "
    "WHERE status = 'failed' AND consecutive_failures >= 3"))
def q_failure_alerts(spark, sf_dir):
    """Each failed run that was at least the third failed one of its bank in a row."""
    return R.failure_alerts(runs(spark, sf_dir))


@register("failure_streaks", O.with_runs(
    "SELECT bank, count(*) AS failures_in_last_3 FROM ("
    "SELECT *, row_number() OVER (PARTITION BY bank ORDER BY started_at DESC NULLS LAST, id ASC) AS rn "
    "FROM runs) WHERE rn <= 3 AND status = 'failed' GROUP BY bank"))
def q_failure_streaks(spark, sf_dir):
    """U10 input: failed runs among each bank's latest three."""
    w = Window.partitionBy("bank").orderBy(*R.newest_first())
    r = runs(spark, sf_dir).withColumn("_rn", F.row_number().over(w))
    return r.filter((F.col("_rn") <= 3) & (F.col("status") == "failed")).groupBy("bank") \
        .agg(F.count(F.lit(1)).alias("failures_in_last_3"))


# ------------------------------------------------------------------ page tiles
from promospark.operators import tiles as X  # noqa: E402
from promospark.sources.tables import read_table  # noqa: E402


def page_tile_rows(spark, sf_dir):
    return X.explode_tiles(X.page_snapshots(read_table(spark, sf_dir, "pages")))


@register("page_tiles", O.with_page_tiles("SELECT bank, page_id, pos, href, inner_html FROM page_tiles"))
def q_page_tiles(spark, sf_dir):
    """Tiles of every page in document order, fallback when none."""
    return page_tile_rows(spark, sf_dir).select("bank", "page_id", "pos", "href", "inner_html")


@register("page_promotions", O.with_page_promos(
    "SELECT bank, source_id, source_url, title, merchant_name, discount_type, discount_value, "
    "page_id, pos, checksum FROM promos_ck"))
def q_page_promotions(spark, sf_dir):
    """X5-X13 (+T/M/U1): page tiles normalised to promotion rows."""
    p = normalize_tiles(X.tiles_for_extraction(page_tile_rows(spark, sf_dir)))
    return p.select("bank", "source_id", "source_url", "title", "merchant_name", "discount_type",
                    "discount_value", F.col("ord.page_id").alias("page_id"), F.col("ord.pos").alias("pos"),
                    "checksum")


@register("page_first_seen", O.with_page_promos(
    "SELECT bank, source_id, page_id, pos FROM (SELECT *, row_number() OVER "
    "(PARTITION BY bank, source_id ORDER BY hub_ord, page_id, pos) AS rn FROM promos) WHERE rn = 1"))
def q_page_first_seen(spark, sf_dir):
    """P1 over page tiles: first tile per (source, id) in page then tile order."""
    p = normalize_tiles(X.tiles_for_extraction(page_tile_rows(spark, sf_dir)))
    return first_seen(p).select("bank", "source_id", F.col("ord.page_id").alias("page_id"),
                                F.col("ord.pos").alias("pos"))


# ------------------------------------------------------------------ html tiles
from promospark.operators import html_tiles as H  # noqa: E402
from promospark.sources.html_feed import load_html_pages  # noqa: E402


def html_outcomes(spark, sf_dir):
    return H.outcomes(H.extract_tiles(load_html_pages(spark, sf_dir)))


@register("html_tiles", O.with_html_tiles(
    f"SELECT bank, hub_slug, page_id, pos, {O.normalize('title_raw')} AS title, {O.normalize('description_raw')} AS description, "
    "date_raw, category_raw, href, CASE WHEN starts_with(image_raw, '/') THEN CASE bank WHEN 'kasikorn' THEN 'https://www.kasikornbank.com' "
    "WHEN 'krungsri' THEN 'https://www.krungsri.com' WHEN 'uob' THEN 'https://www.uob.co.th' WHEN 'amex' THEN "
    "'https://www.americanexpress.com' ELSE 'https://www.bangkokbank.com' END || image_raw ELSE image_raw END AS image FROM htiles"))
def q_html_tiles(spark, sf_dir):
    """Accepted tiles of every HTML source, by its own rules, with their raw slots."""
    t = html_outcomes(spark, sf_dir).where("reason IS NULL")
    return t.select("bank", "hub_slug", "page_id", "pos", normalize_text("title_raw").alias("title"),
                    normalize_text("description_raw").alias("description"), "date_raw", "category_raw", "href",
                    by_source(lambda spec: absolutize_image(F.col("image_raw"), spec.base_url)).alias("image"))


_HTML_PROMO_COLS = ["bank", "source_id", "source_url", "title", "description", "image_url", "category", "merchant_name",
                    "discount_type", "discount_value", "minimum_spend", "start_date", "end_date", "checksum"]


def html_promotions(spark, sf_dir):
    return H.accepted(html_outcomes(spark, sf_dir))


@register("html_promotions", O.with_html_promos(f"SELECT {', '.join(_HTML_PROMO_COLS)}, page_id, pos FROM promos_ck"))
def q_html_promotions(spark, sf_dir):
    """X1-X16, T, M, D, P2, P3, U1: HTML pages to promotion rows."""
    return html_promotions(spark, sf_dir).select(*_HTML_PROMO_COLS, F.col("ord.page_id").alias("page_id"), F.col("ord.pos").alias("pos"))


@register("html_first_seen", O.with_html_promos(
    "SELECT bank, source_id, title, page_id, pos FROM (SELECT *, row_number() OVER "
    "(PARTITION BY bank, source_id ORDER BY hub_ord, page_id, pos) AS rn FROM promos) WHERE rn = 1"))
def q_html_first_seen(spark, sf_dir):
    """P1 over HTML tiles: the first per (source, id) in hub, page and tile order."""
    return first_seen(html_promotions(spark, sf_dir).select("bank", "source_id", "title", "ord")).select(
        "bank", "source_id", "title", F.col("ord.page_id").alias("page_id"), F.col("ord.pos").alias("pos"))


@register("rejected_tiles", O.with_html_tiles("SELECT bank, hub_slug, page_id, pos, reason, title, href FROM hrejects"))
def q_rejected_tiles(spark, sf_dir):
    """The reject side table, with reasons."""
    return H.rejected(html_outcomes(spark, sf_dir))


@register("tile_outcomes", O.with_html_tiles(
    "SELECT bank, count(*) AS n_tiles, count(*) FILTER (WHERE reason IS NULL) AS n_accepted, "
    "count(*) FILTER (WHERE reason IS NOT NULL) AS n_rejected, count(DISTINCT page_id) AS n_pages FROM ("
    "SELECT bank, page_id, CAST(NULL AS VARCHAR) AS reason FROM htiles UNION ALL SELECT bank, page_id, reason FROM hrejects) "
    "GROUP BY bank"))
def q_tile_outcomes(spark, sf_dir):
    """Accepted and rejected tiles per source; together they are all tiles."""
    return html_outcomes(spark, sf_dir).groupBy("bank").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.count_if(F.col("reason").isNull()).alias("n_accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"), F.countDistinct("page_id").alias("n_pages"))


# ------------------------------------------------------------------ payloads
from promospark.operators import payloads as J  # noqa: E402
from promospark.sources.feeds import load_payloads  # noqa: E402


def payload_promotions(spark, sf_dir):
    return normalize_tiles(J.item_fields(J.explode_items(load_payloads(spark, sf_dir))))


@register("payload_items", O.with_payload_items(
    "SELECT bank, seq, pos, json_extract_string(item, '$.slug') AS item_slug FROM pitems_x"))
def q_payload_items(spark, sf_dir):
    """Items located in every captured payload, exploded with position."""
    return J.explode_items(load_payloads(spark, sf_dir)).select(
        "bank", "seq", "pos", F.try_variant_get("item", "$.slug", "string").alias("item_slug"))


@register("payload_promotions", O.with_payload_promos(
    "SELECT bank, source_id, source_url, title, description, image_url, category, merchant_name, "
    "discount_type, discount_value, start_date, end_date, array_to_string(card_types, '|') AS card_types_text, "
    "checksum FROM promos_ck"))
def q_payload_promotions(spark, sf_dir):
    """J7-J12 (+T2-T5, D-1, D-3): payload items normalised to promotion rows."""
    return payload_promotions(spark, sf_dir).select(
        "bank", "source_id", "source_url", "title", "description", "image_url", "category",
        "merchant_name", "discount_type", "discount_value", "start_date", "end_date",
        F.array_join("card_types", "|").alias("card_types_text"), "checksum")


# ------------------------------------------------------------------ designed-but-unbuilt extras
@register("detail_work_list", O.with_state(
    "SELECT DISTINCT n.bank, n.source_url FROM state2 n WHERE n.is_active AND NOT EXISTS ("
    "SELECT 1 FROM state1 o WHERE o.bank = n.bank AND o.source_url = n.source_url)"))
def q_detail_work_list(spark, sf_dir):
    """Detail-crawl work list: active source URLs not present in the previous run."""
    state1 = I.feed_state1(spark, sf_dir)
    now = state(spark, sf_dir).filter("is_active").select("bank", "source_url").distinct()
    return now.join(state1.select("bank", "source_url"), ["bank", "source_url"], "left_anti")


@register("weekly_recheck", O.with_state(
    "SELECT id, bank, source_id, end_date FROM state2 WHERE is_active AND end_date >= DATE '1998-06-01'"))
def q_weekly_recheck(spark, sf_dir):
    """Weekly recheck set: active promotions that have not ended by the given day."""
    return state(spark, sf_dir).filter(F.col("is_active") & (F.col("end_date") >= F.lit("1998-06-01").cast("date"))) \
        .select("id", "bank", "source_id", "end_date")


@register("low_count_runs", O.with_runs(
    "SELECT id, bank, promotions_found FROM runs WHERE status = 'success' AND promotions_found < 3"))
def q_low_count_runs(spark, sf_dir):
    """Low-count alert: successful runs that found fewer than three promotions."""
    return runs(spark, sf_dir).filter((F.col("status") == "success") & (F.col("promotions_found") < 3)) \
        .select("id", "bank", "promotions_found")


@register("ktc_pages", O.with_payload_promos(
    "SELECT bank, source_id, source_url, title, merchant_name, checksum FROM promos_ck WHERE bank = 'ktc'"))
def q_ktc_pages(spark, sf_dir):
    """KTC pages (the captured KTC payload pages plus every ``pages`` row
    read as a KTC page) decided per page: embedded JSON items, else HTML cards.
    The ``pages`` rows carry no embedded JSON and no promotion cards, so they
    contribute nothing; the JSON pages yield their items."""
    docs = load_payloads(spark, sf_dir).filter(F.col("bank") == "ktc").select("seq", F.col("payload").alias("html"))
    pages = read_table(spark, sf_dir, "pages").select((F.col("page_id") + F.lit(1 << 40)).alias("seq"), "html")
    rows = J.ktc_page_promotions(docs.unionByName(pages))
    return rows.select("bank", "source_id", "source_url", "title", "merchant_name", "checksum")


# ------------------------------------------------------------------ KTC hub pages
from promospark.sources.html_feed import load_ktc_hub_pages  # noqa: E402
from promospark.sources.hubs import stamp_hubs  # noqa: E402


@register("ktc_html_cards", O.with_ktc_cards(
    "SELECT source_id, source_url, title, image_url, category, merchant_name, pseq AS page_seq, checksum FROM kcards_ck"))
def q_ktc_html_cards(spark, sf_dir):
    """Promotion rows of the cards on KTC pages without embedded JSON."""
    cards = J.ktc_html_cards(stamp_hubs(load_ktc_hub_pages(spark, sf_dir)))
    return cards.select("source_id", "source_url", "title", "image_url", "category", "merchant_name",
                        F.col("ord.seq").alias("page_seq"), "checksum")


@register("ktc_hub_categories", O.with_ktc_hubs("SELECT source_id, title, category, hub_ord, pseq AS page_seq FROM kfirst"))
def q_ktc_hub_categories(spark, sf_dir):
    """The first row of each id over KTC's main page and categories, JSON or cards as each page decides;
    a category page gives its slug to rows without category, the main page none."""
    rows = J.ktc_page_promotions(stamp_hubs(load_ktc_hub_pages(spark, sf_dir)))
    return first_seen(rows, order="ord").select("source_id", "title", "category", F.col("ord.hub_ord").alias("hub_ord"),
                                                F.col("ord.seq").alias("page_seq"))
