"""Ingest plan: snapshot -> extract -> dedup -> upsert -> soft delete -> audit.

One lazy plan for all sources at once (C2); the only actions are the state
write and the audit write in ``commit_run``. Failed sources are filtered out
before the upsert (U8) and never deactivate anything (U6); a dry run (U9)
returns the plan without writing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.operators.dedup import first_seen
from promospark.operators.extract import normalize_tiles, promotion_id
from promospark.operators.upsert import STATE_COLUMNS, apply_upsert, initial_state, plan_unique, upsert_counts
from promospark.plans.store import TableStore, input_bytes, input_fingerprint
from promospark.sources.feeds import load_promo_tiles

# Run times of the two feed snapshots (parameters, not wall-clock reads).
NOW_1 = "2026-03-01 06:00:00"
NOW_2 = "2026-03-02 06:00:00"
_FEED_TABLES = ["lineitem", "part"]


@dataclass
class RunResult:
    state: DataFrame          # next state (STATE_COLUMNS + deactivated)
    plan: DataFrame           # per-key upsert plan
    audit: DataFrame          # one run row per source


def run_ingest(state: DataFrame, snapshot: DataFrame, now: str,
               failed: DataFrame | None = None, dry_run: bool = False,
               deduplicated: bool = False, deactivate: bool = True, found: DataFrame | None = None) -> RunResult:
    """One ingest run over all sources present in ``snapshot`` (normalised rows
    with ``ord``/``seq``). ``failed`` lists (bank, error_message) of sources whose
    fetch failed: their rows are dropped and they are audited as failed. Without
    ``deactivate`` the snapshot may be a part of a run, and nothing is soft-deleted.
    Sources with a row are refreshed; ``found`` may give the rows before de-duplication,
    which have the same sources and need no grouping by key."""
    found = snapshot if found is None else found
    if failed is not None:
        snapshot, found = (rows.join(failed.select("bank"), "bank", "left_anti") for rows in (snapshot, found))
    incoming = snapshot if deduplicated else first_seen(snapshot)
    plan = plan_unique(state, incoming)
    counts = upsert_counts(plan)
    if dry_run:
        counts = counts.select("bank", F.lit(0).cast("long").alias("promotions_new"),
                               F.lit(0).cast("long").alias("promotions_updated"), "promotions_found")
        return RunResult(state, plan, audit_rows(counts, failed, now))
    if not deactivate:
        return RunResult(apply_upsert(state, plan, now), plan, audit_rows(counts, failed, now))
    refreshed = found.select("bank").distinct()
    next_state = apply_upsert(state, plan, now, refreshed_banks=refreshed)
    return RunResult(next_state, plan, audit_rows(counts, failed, now))


def audit_rows(counts: DataFrame, failed: DataFrame | None, now: str) -> DataFrame:
    """One finished run row per source (success with counts, or failed)."""
    ts = F.lit(now).cast("timestamp_ntz")
    ok = counts.select(
        F.sha2(F.concat_ws("/", F.lit(now), F.col("bank")), 256).alias("id"), "bank",
        ts.alias("started_at"), ts.alias("finished_at"), F.lit("success").alias("status"),
        F.col("promotions_found").cast("int").alias("promotions_found"),
        F.col("promotions_new").cast("int").alias("promotions_new"),
        F.col("promotions_updated").cast("int").alias("promotions_updated"),
        F.lit(None).cast("string").alias("error_message"))
    if failed is None:
        return ok
    bad = failed.select(
        F.sha2(F.concat_ws("/", F.lit(now), F.col("bank")), 256).alias("id"), "bank",
        ts.alias("started_at"), ts.alias("finished_at"), F.lit("failed").alias("status"),
        F.lit(0).alias("promotions_found"), F.lit(0).alias("promotions_new"),
        F.lit(0).alias("promotions_updated"), F.col("error_message"))
    return ok.unionByName(bad)


# ------------------------------------------------------------------ feed runs
def _snapshot_key() -> F.Column:
    return (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 10


#: Keys of the feed are dealt into passes, one for so many bytes of the input tables; a state is made pass by pass.
PASS_BYTES, MAX_PASSES = 64 << 20, 16
_PASS = "_pass"


def feed_passes(spark: SparkSession, sf_dir: str) -> int:
    return max(1, min(MAX_PASSES, -(-input_bytes(spark, sf_dir, _FEED_TABLES) // PASS_BYTES)))


def feed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feed snapshots normalised, tagged ``snap`` 1 / 2.

    The extraction of each snapshot is written once to the table store, as a
    batch of its own (so that its wide rows need no sort by snapshot), and read
    back, which cuts the long extraction lineage for every plan built on top of it."""
    one, two = (stored_snapshot(spark, sf_dir, snap).withColumn("snap", F.lit(snap)).drop(_PASS) for snap in (1, 2))
    return one.unionByName(two)


def stored_snapshot(spark: SparkSession, sf_dir: str, snap: int) -> DataFrame:
    """A snapshot's normalised rows from the store, each in the folder of its key's pass. The id isn't stored, as it is
    worked out from the key."""
    store = TableStore(spark)
    table = "feed_snapshots_" + input_fingerprint(spark, sf_dir, _FEED_TABLES)
    passes = feed_passes(spark, sf_dir)
    for s in (1, 2):
        if not store.has_batch(table, f"extract-{s}"):
            rows = normalize_tiles(snapshot_tiles(spark, sf_dir, s)).drop("id")
            if passes > 1:
                rows = rows.withColumn(_PASS, F.pmod(F.xxhash64("bank", "source_id"), F.lit(passes)).cast("int"))
            store.append(table, rows, batch_id=f"extract-{s}", tag=str(s), partition_by=[_PASS] if passes > 1 else None)
    rows = store.read_all(table, str(snap)).withColumn("id", promotion_id(F.col("bank"), F.col("source_id")))
    return rows if passes > 1 else rows.withColumn(_PASS, F.lit(0))


def snapshot_tiles(spark: SparkSession, sf_dir: str, snap: int) -> DataFrame:
    """The raw tiles of a snapshot. Snapshot 1 lacks the tiles with key class 2 (they
    are new in run 2); snapshot 2 lacks key class 0 (they vanish -> soft delete) and
    carries a new image for key class 1 (content change -> update)."""
    tiles = load_promo_tiles(spark, sf_dir).withColumn("_k", _snapshot_key())
    if snap == 1:
        return tiles.filter(F.col("_k") != 2)
    return (tiles.filter(F.col("_k") != 0)
            .withColumn("image_raw", F.when(F.col("_k") == 1, F.lit("/img/v2.jpg")).otherwise(F.col("image_raw"))))


def in_passes(spark: SparkSession, sf_dir: str, rows_of: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """The rows that ``rows_of`` gives for each pass, made and stored one pass after another, so that shuffles need the
    disk of one pass at a time; with one pass only they are not stored. ``rows_of`` is called with a function that takes
    a stored snapshot or state to the rows of the pass. Keys don't cross passes; counts are the caller's to add up."""
    passes = feed_passes(spark, sf_dir)
    if passes == 1:
        return rows_of(lambda rows: rows.drop(_PASS))
    store, table = TableStore(spark), f"passes_{uuid.uuid4().hex}"
    store.commit_passes(table, (rows_of(lambda rows, k=k: rows.where(F.col(_PASS) == k).drop(_PASS)) for k in range(passes)), "rows", _PASS)
    return store.read(table).drop(_PASS)


def audit_sums(audits: DataFrame) -> DataFrame:
    """One audit row per run from the rows of its passes."""
    counts = ["promotions_found", "promotions_new", "promotions_updated"]
    rest = [c for c in audits.columns if c not in counts]
    return audits.groupBy(*rest).agg(*(F.sum(c).cast("int").alias(c) for c in counts)).select(*audits.columns)


def feed_states(spark: SparkSession, sf_dir: str):
    """(state after run 1, RunResult of run 2) for the feed snapshots.

    State 1 is committed as version 1 of the feed's promotions table; run 2 is
    planned against it (the plan is returned lazily, nothing of run 2 written)."""
    state1 = feed_state1(spark, sf_dir)
    return state1.drop(_PASS), feed_run2(state1.drop(_PASS), stored_snapshot(spark, sf_dir, 2).drop(_PASS))


def feed_state1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State 1 with the pass of each row's key; committed on first use."""
    store = TableStore(spark)
    table = _promotions_table_name(spark, sf_dir)
    if not store.has_batch(table, "run-1"):
        rows = stored_snapshot(spark, sf_dir, 1)
        store.commit_passes(table, (initial_state(first_seen(rows.where(F.col(_PASS) == k).drop(_PASS)), NOW_1)
                                    for k in range(feed_passes(spark, sf_dir))), "run-1", _PASS, partition_by=["bank"])
    return _read_version(store, table, "run-1")


def feed_run2(state1: DataFrame, raw2: DataFrame, found: DataFrame | None = None) -> RunResult:
    """Run 2 of the feed, or that of a pass; ``found`` is the whole snapshot then."""
    return run_ingest(state1, first_seen(raw2), NOW_2, deduplicated=True, found=raw2 if found is None else found)


def _promotions_table_name(spark: SparkSession, sf_dir: str) -> str:
    return "promotions_" + input_fingerprint(spark, sf_dir, _FEED_TABLES)


def _read_version(store: TableStore, table: str, batch_id: str) -> DataFrame:
    entry = next(v for v in store.versions(table) if v["batch_id"] == batch_id)
    return store.read(table, entry["version"]).select(*STATE_COLUMNS, _PASS)


def promotions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotions table after both feed runs (active and inactive rows),
    read from the store (run 2 is committed on first use, pass by pass: rows of one
    key are in one pass, and a source is refreshed in all of them)."""
    store = TableStore(spark)
    table = _promotions_table_name(spark, sf_dir)
    if not store.has_batch(table, "run-2"):
        state1, raw2 = feed_state1(spark, sf_dir), stored_snapshot(spark, sf_dir, 2)

        def next_state(k: int) -> DataFrame:
            stored, incoming = (rows.where(F.col(_PASS) == k).drop(_PASS) for rows in (state1, raw2))
            return feed_run2(stored, incoming, found=raw2).state.select(*STATE_COLUMNS)
        store.commit_passes(table, map(next_state, range(feed_passes(spark, sf_dir))), "run-2", _PASS, partition_by=["bank"])
    return _read_version(store, table, "run-2").drop(_PASS)
