"""Continuous snapshot ingest with Structured Streaming.

Raw tile batches arrive as files in a folder; ``readStream`` picks them up,
``foreachBatch`` runs the batch plan (extract -> dedup -> upsert -> audit) against the
latest committed state and commits the next state version with the micro-batch id. A
replayed micro-batch (after a driver or executor loss) finds its batch id already
committed and does nothing, so the sink is idempotent; the streaming checkpoint lives
in the shared checkpoint folder.

A snapshot may span many files and micro-batches, and a micro-batch may hold rows of
several snapshots. Rows name their snapshot in the column ``snapshot_col``, and a row
with ``end_of_snapshot`` (and no tile) says that the snapshot is complete: the batch is
split by snapshot, in the order of their names, and complete ones are closed, which
soft-deletes what they no longer hold. Producers without such columns name the snapshot
of a whole micro-batch (``snapshot_of``) and call ``close_snapshot`` themselves.

The audit only grows: a row per batch and source, and one per source when its snapshot
is closed. ``stream_audit`` folds them to one row per snapshot and source. The keys that
a snapshot has brought are kept until it is closed.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.operators.dedup import first_seen
from promospark.operators.extract import normalize_tiles
from promospark.operators.upsert import KEY, STATE_COLUMNS, deactivate_missing, initial_state
from promospark.plans.ingest import run_ingest
from promospark.plans.store import TableStore
from promospark.session import checkpoint_dir
from promospark.sources.specs import SPECS


def _seen_keys(store: TableStore, table: str, snapshot_id: str, but_batch: str | None = None) -> DataFrame | None:
    """Keys that the batches of a snapshot, other than ``but_batch``, have brought so far."""
    paths = [v["path"] for v in store.versions(f"{table}_seen")
             if v["tag"] == snapshot_id and v["path"] and v["batch_id"] != but_batch]
    return store.spark.read.parquet(*paths).select(*KEY) if paths else None


def ingest_batch(store: TableStore, table: str, audit_table: str, tiles: DataFrame, batch_id: str,
                 now: str, snapshot_id: str | None = None) -> bool:
    """Upsert a batch of tiles, which may be a part of its snapshot, into the stored state;
    False when the batch id was already committed (replay). Any other batch must name its
    snapshot: keys count as repeated within one, and as changed from one to the next.

    Keys that an earlier batch of the snapshot brought are not seen again (P1), and
    nothing is soft-deleted before ``close_snapshot``."""
    if store.has_batch(table, batch_id):
        return False
    if snapshot_id is None:
        raise ValueError("snapshot_id is missing: a batch must name the snapshot that it is a part of")
    incoming = first_seen(normalize_tiles(tiles))
    seen = _seen_keys(store, table, snapshot_id, batch_id)
    if seen is not None:
        incoming = incoming.join(seen, KEY, "left_anti").select(*incoming.columns)
    if store.latest(table) is None:
        state = initial_state(incoming.limit(0), now)
    else:
        state = store.read(table).select(*STATE_COLUMNS)
    res = run_ingest(state, incoming, now, deduplicated=True, deactivate=False)
    # The state goes last: a batch counts as done once its state is there, and a replay
    # after a loss between the writes finds the others by the batch id and goes on.
    store.commit(audit_table, res.audit.withColumn("snapshot_id", F.lit(snapshot_id)), batch_id, tag=snapshot_id)
    store.commit(f"{table}_seen", incoming.select(*KEY), batch_id, tag=snapshot_id)
    next_state = res.state.select(*STATE_COLUMNS)
    store.commit(table, next_state, batch_id, partition_by=["bank"])
    return True


def close_snapshot(store: TableStore, table: str, snapshot_id: str, now: str, audit_table: str | None = None) -> bool:
    """U5 once all batches of a snapshot are in: active rows of its sources that none of
    them brought become inactive. False when already done or when it brought nothing.

    With ``audit_table`` a row per source says when it was closed and what was deactivated; it is
    written before the state, and found again by a replay. Then the snapshot's keys are dropped."""
    batch_id = f"close-{snapshot_id}"
    if store.has_batch(table, batch_id):
        return False
    seen = _seen_keys(store, table, snapshot_id)
    if seen is None:
        return False
    state = store.read(table).select(*STATE_COLUMNS)
    closed = deactivate_missing(state, seen, seen.select("bank"), now)
    if audit_table:
        gone = (closed.join(seen.select("bank").distinct(), "bank", "left_semi").groupBy("bank")
                .agg(F.count_if("deactivated").alias("promotions_deactivated")))
        store.commit(audit_table, gone.select("bank", F.lit(now).cast("timestamp_ntz").alias("closed_at"), "promotions_deactivated",
                                              F.lit(snapshot_id).alias("snapshot_id")), batch_id, tag=f"close {snapshot_id}")
    store.commit(table, closed.select(*STATE_COLUMNS), batch_id, partition_by=["bank"])
    store.forget(f"{table}_seen", snapshot_id)
    return True


AUDIT_COLUMNS = ["snapshot_id", "bank", "started_at", "finished_at", "status", "promotions_found", "promotions_new",
                 "promotions_updated", "promotions_deactivated"]


def stream_audit(store: TableStore, audit_table: str) -> DataFrame | None:
    """U7 of the stream: one row per snapshot and source over all batches, running until the snapshot is closed.

    ``promotions_found`` counts the keys that the batches brought anew. None before the first batch."""
    versions = [v for v in store.versions(audit_table) if v["path"]]
    closing = [v["path"] for v in versions if (v["tag"] or "").startswith("close ")]
    batches = [v["path"] for v in versions if not (v["tag"] or "").startswith("close ")]
    if not batches:
        return None
    names = ["promotions_found", "promotions_new", "promotions_updated"]
    sums = store.spark.read.parquet(*batches).groupBy("snapshot_id", "bank").agg(
        F.min("started_at").alias("started_at"), *(F.sum(n).cast("long").alias(n) for n in names))
    if closing:
        closed = store.spark.read.parquet(*closing).select("snapshot_id", "bank", "closed_at", "promotions_deactivated")
        sums = sums.join(closed, ["snapshot_id", "bank"], "left")
    else:
        sums = sums.select("*", F.lit(None).cast("timestamp_ntz").alias("closed_at"), F.lit(None).cast("long").alias("promotions_deactivated"))
    return sums.select("snapshot_id", "bank", "started_at", F.col("closed_at").alias("finished_at"),
                       F.when(F.col("closed_at").isNull(), "running").otherwise("success").alias("status"), *names,
                       F.coalesce("promotions_deactivated", F.lit(0)).cast("long").alias("promotions_deactivated"))


def ingest_mixed_batch(store: TableStore, table: str, audit_table: str, rows: DataFrame, batch_id: str, now: str,
                       snapshot_col: str = "snapshot_id", end_col: str = "end_of_snapshot") -> list[str]:
    """Split a micro-batch by its rows' snapshots, ingest each part under an id of its own, and close the snapshots whose
    end it holds; returns the closed ones. The names of a batch's snapshots are collected: a batch holds few.

    Rows of unknown sources would fail every retry of the batch; they go to the table ``<table>_rejects``.
    Rows that come behind their snapshot's end raise; rows of the batch that holds the end still count."""
    ended = F.coalesce(F.col(end_col), F.lit(False)) if end_col in rows.columns else F.lit(False)
    known = F.coalesce(F.col("bank").isin(*SPECS), F.lit(False))
    rows = rows.withColumn("_ended", ended).withColumn("_known", known | F.col("_ended"))
    found = rows.groupBy(snapshot_col).agg(F.max("_ended").alias("ended"), F.count_if(F.col("_known") & ~F.col("_ended")).alias("n"),
                                           F.count_if(~F.col("_known")).alias("n_unknown")).collect()
    if any(r[snapshot_col] is None for r in found):
        raise ValueError("rows without a snapshot: each row must name the snapshot that it is a part of")
    closed = []
    for r in sorted(found, key=lambda r: r[snapshot_col]):
        snapshot = r[snapshot_col]
        part_id = f"{batch_id}-{snapshot}"
        if r.n_unknown:
            unknown = rows.where((F.col(snapshot_col) == snapshot) & ~F.col("_known"))
            store.append(f"{table}_rejects", unknown.select(
                F.lit(snapshot).alias("snapshot_id"), "bank", "hub_slug", F.col("title_raw").alias("title"), "href",
                F.lit("unknown source").alias("reason")), part_id, tag=snapshot)
        if r.n and not store.has_batch(table, part_id):
            if store.has_batch(table, f"close-{snapshot}"):
                raise ValueError(f"snapshot {snapshot!r} is closed and can't take more rows")
            tiles = rows.where((F.col(snapshot_col) == snapshot) & F.col("_known") & ~F.col("_ended"))
            ingest_batch(store, table, audit_table, tiles.drop("_ended", "_known", snapshot_col, end_col), part_id, now, snapshot)
        if r.ended and close_snapshot(store, table, snapshot, now, audit_table):
            closed.append(snapshot)
    return closed


def start_ingest_stream(spark: SparkSession, source_dir: str, tile_schema, table: str = "promotions",
                        audit_table: str = "scrape_runs", store: TableStore | None = None,
                        run_time: Callable[[int], str] | None = None, checkpoint: str | None = None,
                        available_now: bool = True, files_per_batch: int = 1, *,
                        snapshot_of: Callable[[int], str] | None = None, snapshot_col: str | None = None):
    """Start the ingest stream over parquet tile files in ``source_dir``. The rows name their snapshots in
    ``snapshot_col``, or ``snapshot_of`` names the one that a whole micro-batch is a part of."""
    if (snapshot_of is None) == (snapshot_col is None):
        raise TypeError("name either snapshot_col or snapshot_of")
    store = store or TableStore(spark)
    ckpt = checkpoint or (checkpoint_dir(spark).rstrip("/") + f"/stream-{table}")
    clock = run_time or (lambda _bid: dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))

    def on_batch(batch_df: DataFrame, batch_id: int) -> None:
        if snapshot_col:
            ingest_mixed_batch(store, table, audit_table, batch_df, f"stream-{batch_id}", clock(batch_id), snapshot_col)
        else:
            ingest_batch(store, table, audit_table, batch_df, f"stream-{batch_id}", clock(batch_id), snapshot_of(batch_id))

    reader = spark.readStream.schema(tile_schema).option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(source_dir).writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
