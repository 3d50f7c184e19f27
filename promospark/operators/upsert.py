"""Set-wise upsert, soft delete and their counts.

The stored table and an incoming batch are combined with joins on the natural
key ``(bank, source_id)``; nothing is looked up row by row.

In-batch repeats of a key (U4) follow the sequential semantics: the first row
of a key that is not stored is an insert; every later row (and the first row of
a stored key) is an update when its checksum differs from the checksum of the
row just before it (or the stored one). The winner is the last row that wrote.

Skew: keys and checksums alone are dealt out by range of (key, order), so that a
key with a third of all rows stands in as many range partitions as its rows fill
(its buckets). Each bucket is reduced to an associative summary (first and last
checksum, changes inside, place of the first and of the last changed row), and a
second, tiny window over the buckets of a key merges the summaries. The winning
row itself is fetched by its place in the end. No task holds more of a key than
one range partition. A batch with one row per key needs none of this
(``plan_unique``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promospark.operators.extract import PROMOTION_COLUMNS

KEY = ["bank", "source_id"]
CONTENT = [c for c in PROMOTION_COLUMNS if c not in ("id", "bank", "source_id")]
STATE_COLUMNS = PROMOTION_COLUMNS + ["is_active", "created_at", "updated_at"]


def _ts(now) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def _content() -> Column:
    return F.struct(*[F.col(c) for c in ["id"] + CONTENT])


def plan_unique(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The plan of ``plan_upsert`` for a batch with one row per key: one join with the stored checksums."""
    stored_c = stored.select(*KEY, F.col("checksum").alias("stored_c"))
    rows = incoming.select(*KEY, F.col("checksum").alias("_c"), _content().alias("_row")).join(stored_c, KEY, "left")
    is_new, changed = F.col("stored_c").isNull(), F.col("stored_c") != F.col("_c")
    return rows.select(*KEY, is_new.alias("is_new"), F.when(changed, 1).otherwise(0).cast("long").alias("n_updates"),
                       F.lit(1).cast("long").alias("n_rows"), F.when(is_new | changed, F.col("_row")).alias("w"))


def plan_upsert(stored: DataFrame, incoming: DataFrame, seq: str = "seq", order: str = "ord",
                bucket_width: int | None = None) -> DataFrame:
    """Per key of ``incoming``: ``is_new``, ``n_updates``, ``n_rows`` and the
    winning content row ``w`` (null when no row wrote).

    ``incoming`` needs the promotion columns plus ``order`` (total order within the
    batch; rows of equal key and order count as given in any order). It is read twice,
    so it should be stored. ``bucket_width`` deals rows out by ranges of ``seq`` (bigint,
    non-decreasing in ``order``) instead of by what a range partition holds.
    """
    narrow = incoming.select(*KEY, F.col(order).alias("_ord"), F.col("checksum").alias("_c"), F.col(seq).alias("_seq"))
    if bucket_width is None:
        rows = narrow.drop("_seq").repartitionByRange(*KEY, "_ord").withColumn("_bucket", F.spark_partition_id())
    else:
        rows = narrow.withColumn("_bucket", F.floor(F.col("_seq") / F.lit(bucket_width)).cast("long")).drop("_seq")
    w1 = Window.partitionBy(*KEY, "_bucket").orderBy("_ord")
    rows = rows.withColumn("_prev", F.lag("_c").over(w1))
    changed = F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_c"))
    buckets = rows.groupBy(*KEY, "_bucket").agg(
        F.min_by("_c", "_ord").alias("first_c"),
        F.max_by("_c", "_ord").alias("last_c"),
        F.count_if(changed).alias("inner_n"),
        F.min("_ord").alias("first_at"),
        F.max(F.when(changed, F.col("_ord"))).alias("last_write"),
        F.count(F.lit(1)).alias("n"),
    )
    stored_c = stored.select(*KEY, F.col("checksum").alias("stored_c"))
    b = buckets.join(stored_c, KEY, "left")
    w2 = Window.partitionBy(*KEY).orderBy("_bucket")
    prev_last = F.coalesce(F.lag("last_c").over(w2), F.col("stored_c"))
    b = b.withColumn("_prev_last", prev_last).withColumn("_first_bucket", F.row_number().over(w2) == 1)
    first_inserts = F.col("_first_bucket") & F.col("stored_c").isNull()
    first_updates = F.col("_prev_last").isNotNull() & (F.col("_prev_last") != F.col("first_c"))
    b = (b.withColumn("_upd", F.col("inner_n") + F.when(first_updates, 1).otherwise(0))
          .withColumn("_win", F.coalesce("last_write", F.when(first_inserts | first_updates, F.col("first_at")))))
    keys = b.groupBy(*KEY).agg(
        F.max(F.when(first_inserts, 1).otherwise(0)).cast("boolean").alias("is_new"),
        F.sum("_upd").cast("long").alias("n_updates"),
        F.sum("n").cast("long").alias("n_rows"),
        F.max("_win").alias("_win"),
    )
    # Contents stay columns until the end, so that those which the caller doesn't use are not shuffled.
    contents = incoming.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col(order).alias("_at"), "id", *CONTENT)
    same = (F.col("bank") == F.col("_bank")) & (F.col("source_id") == F.col("_source_id")) & (F.col("_win") == F.col("_at"))
    fetched = keys.where("_win IS NOT NULL").select(*KEY, "_win").join(contents, same).select(*KEY, "id", *CONTENT).dropDuplicates(KEY) \
        .select(*KEY, _content().alias("w"))
    return keys.drop("_win").join(fetched, KEY, "left").select(*KEY, "is_new", "n_updates", "n_rows", "w")


def apply_upsert(stored: DataFrame, plan: DataFrame, now, reactivate: bool = False,
                 refreshed_banks: DataFrame | None = None) -> DataFrame:
    """Next state. Inserted keys get the run time as created/updated time;
    updated keys keep id, created_at and is_active (Q1; ``reactivate`` flips
    it back on) and take all content from the winning row.

    With ``refreshed_banks`` the soft delete (U5/U6) happens in the same full
    outer join: a stored active row of a refreshed bank that has no plan row
    was not seen and becomes inactive, so the state is shuffled once per run.
    The refreshed-bank list has one row per source at most (bounded by the
    registered specs), so it is broadcast."""
    now = _ts(now)
    s = stored.withColumn("_stored", F.lit(True)).alias("s")
    p = plan.alias("p")
    j = s.join(p, KEY, "full_outer")
    wrote = F.col("p.w").isNotNull()
    inserted = wrote & F.col("s._stored").isNull()
    if refreshed_banks is not None:
        ref = F.broadcast(refreshed_banks.select(F.col("bank").alias("_rbank")).distinct())
        j = j.join(ref, F.col("bank") == F.col("_rbank"), "left")
        gone = (F.col("s._stored").isNotNull() & F.col("s.is_active") & F.col("p.n_rows").isNull()
                & F.col("_rbank").isNotNull())
    else:
        gone = F.lit(False)
    cols = [F.coalesce(F.col("s.id"), F.col("p.w.id")).alias("id"), *[F.col(k) for k in KEY]]
    for c in CONTENT:
        cols.append(F.when(wrote, F.col("p.w." + c)).otherwise(F.col("s." + c)).alias(c))
    active = F.when(inserted, F.lit(True)).otherwise(F.col("s.is_active"))
    if reactivate:
        active = F.when(wrote, F.lit(True)).otherwise(F.col("s.is_active"))
    active = F.when(gone, F.lit(False)).otherwise(active)
    cols += [active.alias("is_active"),
             F.when(inserted, now).otherwise(F.col("s.created_at")).alias("created_at"),
             F.when(wrote | gone, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
             gone.alias("deactivated")]
    out = j.select(*cols)
    return out if refreshed_banks is not None else out.drop("deactivated")


def deactivate_missing(state: DataFrame, seen_keys: DataFrame, refreshed_banks: DataFrame,
                       now) -> DataFrame:
    """Active rows of refreshed banks whose key was not seen become
    inactive (``updated_at`` bumps). ``refreshed_banks`` has one column ``bank``
    and only lists banks whose run succeeded with at least one row; banks not in
    it are untouched, so an empty result never deactivates anything."""
    now = _ts(now)
    seen = seen_keys.select(*KEY).distinct().withColumn("_seen", F.lit(True))
    refreshed = refreshed_banks.select("bank").distinct().withColumn("_refreshed", F.lit(True))
    j = state.join(seen, KEY, "left").join(refreshed, ["bank"], "left")
    gone = F.col("is_active") & F.col("_refreshed").isNotNull() & F.col("_seen").isNull()
    return j.select(
        *[c for c in STATE_COLUMNS if c not in ("is_active", "updated_at")],
        F.when(gone, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(gone, now).otherwise(F.col("updated_at")).alias("updated_at"),
        gone.alias("deactivated"),
    ).select(*STATE_COLUMNS, "deactivated")


def upsert_counts(plan: DataFrame) -> DataFrame:
    """Per bank ``(promotions_new, promotions_updated, promotions_found)``."""
    return plan.groupBy("bank").agg(
        F.count_if("is_new").cast("long").alias("promotions_new"),
        F.sum("n_updates").cast("long").alias("promotions_updated"),
        F.sum("n_rows").cast("long").alias("promotions_found"),
    )


def initial_state(rows: DataFrame, now) -> DataFrame:
    """State of an empty table after inserting de-duplicated rows."""
    now = _ts(now)
    return rows.select(*PROMOTION_COLUMNS, F.lit(True).alias("is_active"),
                       now.alias("created_at"), now.alias("updated_at"))
