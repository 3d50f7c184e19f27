"""Latest state per run from a stream of start/finish audit events.

The folded runs lie in buckets of run ids (``commit_parts``). Each micro-batch is folded
(``max_by`` per run id) together with the buckets that its ids fall into, and only those are
written again, under the batch id: replays are no-ops, and what is written follows the batch,
not the table. The state is one row per run, in the table (not in the streaming state store,
where it would grow without bound); folders that the last versions don't name are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.operators.runs import RUN_COLUMNS, fold_runs
from promospark.plans.store import TableStore
from promospark.session import checkpoint_dir

EVENT_COLUMNS = RUN_COLUMNS + ["event_time"]
#: Buckets of run ids, and versions whose folders are kept for readers that still use them.
BUCKETS = 64
KEPT_VERSIONS = 3


def merge_run_events(previous: DataFrame | None, events: DataFrame) -> DataFrame:
    """Fold new events into the previous run rows (kept with their event time)."""
    ev = events.select(*EVENT_COLUMNS)
    if previous is not None:
        ev = previous.select(*EVENT_COLUMNS).unionByName(ev)
    rest = [c for c in EVENT_COLUMNS if c != "id"]
    latest = ev.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("event_time")).alias("r"))
    return latest.select("id", *[F.col("r." + c).alias(c) for c in rest])


def bucket_of(run_id: str = "id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("string")


def fold_batch(store: TableStore, table: str, events: DataFrame, batch_id: str, keep_versions: int = KEPT_VERSIONS) -> bool:
    """Fold one batch of events into the stored runs; False when its id was already committed."""
    if store.has_batch(table, batch_id):
        return False
    events = events.select(*EVENT_COLUMNS).withColumn("bucket", bucket_of())
    touched = [r.bucket for r in events.select("bucket").distinct().collect()]  # BUCKETS at most
    folded = merge_run_events(store.read_parts(table, touched), events)
    store.commit_parts(table, folded.withColumn("bucket", bucket_of()), batch_id, "bucket", touched)
    store.expire(table, keep_versions)
    return True


def run_state(store: TableStore, table: str = "run_state") -> DataFrame | None:
    """The latest state of every run; None before the first event."""
    rows = store.read_parts(table)
    return None if rows is None else rows.select(*EVENT_COLUMNS)


def start_run_state_stream(spark: SparkSession, events_dir: str, event_schema, table: str = "run_state",
                           store: TableStore | None = None, checkpoint: str | None = None,
                           files_per_batch: int = 1):
    """Stream audit-event files (RUN_COLUMNS + event_time) into the folded runs table (``run_state`` reads it)."""
    store = store or TableStore(spark)
    ckpt = checkpoint or (checkpoint_dir(spark).rstrip("/") + f"/stream-{table}")

    def on_batch(batch_df: DataFrame, batch_id: int) -> None:
        fold_batch(store, table, batch_df, f"stream-{batch_id}")

    q = (spark.readStream.schema(event_schema).option("maxFilesPerTrigger", files_per_batch)
         .parquet(events_dir).writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True))
    return q.start()


__all__ = ["bucket_of", "fold_batch", "merge_run_events", "run_state", "start_run_state_stream", "fold_runs"]
