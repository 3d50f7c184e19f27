"""Run audit: start and finish as separate events of an append-only log.

``execute_run`` commits a start event for each requested source, ingests the
snapshot, and commits a finish event for each: success with its counts (0 where
the source brought nothing), or failed with its error. A run that dies between
the two leaves its sources running, as stale runs show. The alert on repeated
failures is computed from the folded log after the finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.operators.runs import REPEATED_FAILURE_THRESHOLD, fold_runs, repeated_failures
from promospark.operators.upsert import STATE_COLUMNS
from promospark.plans.ingest import run_ingest
from promospark.plans.store import TableStore
from promospark.sources.specs import get_spec, list_sources

EVENT = ["id", "bank", "started_at", "event_time", "finished_at", "status", "promotions_found", "promotions_new",
         "promotions_updated", "error_message"]


def requested_sources(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """One row per requested source (None: all registered); unknown names raise."""
    return spark.createDataFrame([(get_spec(n).name,) for n in (names or list_sources())], "bank string")


def _run_id(started: str):
    return F.sha2(F.concat_ws("/", F.lit(started), F.col("bank")), 256)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def start_events(requested: DataFrame, started: str) -> DataFrame:
    zero = F.lit(0)
    return requested.select(
        _run_id(started).alias("id"), "bank", _ts(started).alias("started_at"), _ts(started).alias("event_time"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit("running").alias("status"),
        zero.alias("promotions_found"), zero.alias("promotions_new"), zero.alias("promotions_updated"),
        F.lit(None).cast("string").alias("error_message"))


def finish_events(requested: DataFrame, counts: DataFrame | None, failed: DataFrame | None, started: str, finished: str) -> DataFrame:
    """``counts``: bank and the promotions_ counts; ``failed``: bank and error_message, one row per bank at most."""
    names = ["promotions_found", "promotions_new", "promotions_updated"]
    rows = requested
    if counts is not None:
        rows = rows.join(counts.select("bank", *names), "bank", "left")
    else:
        rows = rows.select("*", *(F.lit(0).alias(n) for n in names))
    if failed is not None:
        rows = rows.join(failed.select("bank", "error_message", F.lit(True).alias("is_failed")), "bank", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("boolean").alias("is_failed"))
    bad = F.coalesce("is_failed", F.lit(False))
    return rows.select(
        _run_id(started).alias("id"), "bank", _ts(started).alias("started_at"), _ts(finished).alias("event_time"),
        _ts(finished).alias("finished_at"), F.when(bad, "failed").otherwise("success").alias("status"),
        *(F.when(bad, 0).otherwise(F.coalesce(n, F.lit(0))).cast("int").alias(n) for n in names), "error_message")


def audit_events(store: TableStore, table: str) -> DataFrame | None:
    """All events of the log; None before the first one."""
    return store.read_all(table)


def audit_runs(store: TableStore, table: str) -> DataFrame | None:
    """One row per run, folded from all events."""
    events = audit_events(store, table)
    return None if events is None else fold_runs(events)


def alerts(store: TableStore, table: str, failed: DataFrame, threshold: int = REPEATED_FAILURE_THRESHOLD) -> DataFrame:
    """Sources of ``failed`` whose latest ``threshold`` runs all failed, with the last error."""
    return repeated_failures(audit_runs(store, table), threshold).join(failed.select("bank").distinct(), "bank", "left_semi")


def execute_run(store: TableStore, table: str, audit_table: str, snapshot: DataFrame, requested: DataFrame, started: str,
                finished: str, failed: DataFrame | None = None, dry_run: bool = False) -> DataFrame | None:
    """One audited run over the requested sources; returns the alerts (None: no source failed).

    Rows of other sources are left out. Start and finish are commits of their own, under ids made
    of ``started``, so that a run that is repeated after a loss goes on where it stopped. An error of
    the ingest itself fails all requested sources and is raised after its finish events are written.
    A dry run writes nothing but returns no alerts either.
    """
    rows = snapshot.join(requested, "bank", "left_semi").select(*snapshot.columns)
    if failed is not None:
        failed = failed.join(requested, "bank", "left_semi")
    if dry_run:
        return None
    store.append(audit_table, start_events(requested, started), f"start-{started}")
    state = store.read_parts(table)
    try:
        run = run_ingest(_empty_state(rows) if state is None else state.select(*STATE_COLUMNS), rows, started, failed)
        touched = [r.bank for r in requested.collect()]  # bounded by the registered sources
        store.commit_parts(table, run.state.select(*STATE_COLUMNS).join(F.broadcast(requested), "bank", "left_semi").select(*STATE_COLUMNS),
                           f"run-{started}", "bank", touched)
        counts = run.audit.where("status = 'success'")
    except Exception as e:
        broken = requested.withColumn("error_message", F.lit(str(e)[:2000]))
        store.append(audit_table, finish_events(requested, None, broken, started, finished), f"finish-{started}")
        raise
    store.append(audit_table, finish_events(requested, counts, failed, started, finished), f"finish-{started}")
    return None if failed is None else alerts(store, audit_table, failed)


def _empty_state(rows: DataFrame) -> DataFrame:
    from promospark.operators.upsert import initial_state
    return initial_state(rows.limit(0), "1970-01-01 00:00:00")
