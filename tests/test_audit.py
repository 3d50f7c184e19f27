"""Audit life cycle, table store parts, mixed stream batches, run-state buckets."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F
from test_upsert import NOW1, fold, rows_df

from conftest import SF
from promospark.operators.extract import PROMOTION_COLUMNS
from promospark.operators.runs import RUN_COLUMNS, failure_alerts, fold_runs
from promospark.operators.upsert import KEY, apply_upsert, initial_state, plan_unique, plan_upsert, upsert_counts
from promospark.plans import audit as A
from promospark.plans.store import CommitConflict, TableStore
from promospark.sources.feeds import load_promo_tiles, load_run_events
from promospark.streaming.ingest import close_snapshot, ingest_batch, ingest_mixed_batch, start_ingest_stream, stream_audit
from promospark.streaming.runs import bucket_of, fold_batch, run_state


@pytest.fixture
def store(spark):
    return TableStore(spark, tempfile.mkdtemp(prefix="audit-") + "/store")


def runs_of(store):
    return {(r.bank, r.started_at.day): (r.status, r.promotions_found, r.promotions_new, r.promotions_updated, r.error_message,
                                          r.finished_at and r.finished_at.minute) for r in A.audit_runs(store, "audit").collect()}


def test_life_cycle_of_runs(spark, store):
    requested = A.requested_sources(spark, ["ktc", "uob", "bbl"])
    with pytest.raises(KeyError):
        A.requested_sources(spark, ["ktc", "moon"])
    rows = rows_df(spark, [("ktc", "a", "A", "t", 0), ("ktc", "a", "B", "u", 1), ("ktc", "b", "A", "t", 2), ("uob", "x", "A", "t", 3),
                           ("amex", "no", "A", "t", 4)])
    timed_out = spark.createDataFrame([("uob", "timed out"), ("amex", "not asked for")], "bank string, error_message string")
    assert A.execute_run(store, "promotions", "audit", rows, requested, "2026-01-01 06:00:00", "2026-01-01 06:05:00", dry_run=True) is None
    assert A.audit_runs(store, "audit") is None
    A.execute_run(store, "promotions", "audit", rows, requested, "2026-01-01 06:00:00", "2026-01-01 06:05:00")
    assert runs_of(store) == {("ktc", 1): ("success", 2, 2, 0, None, 5), ("uob", 1): ("success", 1, 1, 0, None, 5),
                              ("bbl", 1): ("success", 0, 0, 0, None, 5)}
    assert {(r.bank, r.source_id) for r in store.read("promotions").collect()} == {("ktc", "a"), ("ktc", "b"), ("uob", "x")}
    # between start and finish a run is seen running, and its repetition goes on
    store.append("audit", A.start_events(requested, "2026-01-02 06:00:00"), "start-2026-01-02 06:00:00")
    assert runs_of(store)["ktc", 2] == ("running", 0, 0, 0, None, None)
    alerts = A.execute_run(store, "promotions", "audit", rows.where("bank <> 'uob'"), requested, "2026-01-02 06:00:00", "2026-01-02 06:07:00", timed_out)
    assert runs_of(store)["uob", 2] == ("failed", 0, 0, 0, "timed out", 7) and alerts.collect() == []
    assert len([e for e in A.audit_events(store, "audit").collect() if e.started_at.day == 2]) == 6
    A.execute_run(store, "promotions", "audit", rows.limit(0), requested, "2026-01-03 06:00:00", "2026-01-03 06:07:00", timed_out)
    alerts = A.execute_run(store, "promotions", "audit", rows.limit(0), requested, "2026-01-04 06:00:00", "2026-01-04 06:07:00", timed_out)
    assert [tuple(r) for r in alerts.collect()] == [("uob", 3, "timed out")]
    assert all(r.is_active for r in store.read("promotions").collect())  # empty and failed runs deactivate nothing
    # an error of the ingest itself fails what was asked for, and is raised
    with pytest.raises(Exception):
        A.execute_run(store, "promotions", "audit", rows.withColumn("checksum", F.raise_error(F.lit("broken"))), requested,
                      "2026-01-05 06:00:00", "2026-01-05 06:01:00")
    assert runs_of(store)["ktc", 5][0] == "failed" and "broken" in runs_of(store)["ktc", 5][4]


def test_two_writers_and_parts(spark, store):
    first = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "bank string, v int")
    store.commit_parts("t", first, "one", "bank", ["a", "b", "c", "none"])
    other = TableStore(spark, store.root)
    stale = other.versions("t")
    other.versions = lambda table: stale
    store.commit_parts("t", first.where("bank = 'b'").withColumn("v", F.lit(20)), "two", "bank", ["b"])
    with pytest.raises(CommitConflict):
        other.commit_parts("t", first, "three", "bank", ["a"])
    before, after = store.versions("t")
    assert after["parts"]["a"] == before["parts"]["a"] and after["parts"]["b"] != before["parts"]["b"]
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 20), ("c", 3)]
    assert [tuple(r) for r in store.read_parts("t", ["b"]).collect()] == [("b", 20)]
    assert sorted(map(tuple, store.read("t", 1).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    store.commit_parts("t", first.where("false"), "gone", "bank", ["c"])
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 20)]
    assert store.commit_parts("t", first, "two", "bank", ["a"])["version"] == 2  # a replay
    assert store.expire("t", keep=1) == 2  # the first b and c
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 20)]


def test_appended_versions_are_all_read_and_forgotten_by_tag(spark, store):
    for k in range(3):
        store.append("log", spark.createDataFrame([(k,)], "k int"), f"b{k}", tag="even" if k % 2 == 0 else "odd")
    assert sorted(r.k for r in store.read_all("log").collect()) == [0, 1, 2]
    assert store.forget("log", "even") == 2 and store.has_batch("log", "b0")
    assert [r.k for r in store.read_all("log").collect()] == [1] and store.read_all("log", "even") is None


def test_hot_key_upsert_equals_sequential_fold(spark):
    rnd = random.Random(3)
    batch = [("b1", "hot" if rnd.random() < .4 else f"k{rnd.randrange(300)}", rnd.choice("AB"), f"t{j}", j) for j in range(3000)]
    state1 = initial_state(rows_df(spark, [("b1", "hot", "A", "old", 0), ("b1", "k1", "B", "old", 1)]).select(*PROMOTION_COLUMNS), NOW1)
    rows = rows_df(spark, batch).repartition(6)
    plan = plan_upsert(state1, rows)
    assert [(r.promotions_new, r.promotions_updated) for r in upsert_counts(plan).collect()] == [
        fold({("b1", "hot"): {"checksum": "A"}, ("b1", "k1"): {"checksum": "B"}}, batch)[1:]]
    want = fold({("b1", "hot"): {"checksum": "A", "title": "old"}, ("b1", "k1"): {"checksum": "B", "title": "old"}}, batch)[0]
    got = {(r.bank, r.source_id): (r.checksum, r.title) for r in apply_upsert(state1, plan, NOW1).collect()}
    assert got == {k: (v["checksum"], v["title"]) for k, v in want.items()}
    # the hot key's rows are dealt out over range partitions
    parts = rows.repartitionByRange(8, *KEY, "ord").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    unique = rows_df(spark, [("b1", "hot", "A", "same", 0), ("b1", "k1", "C", "new", 1), ("b2", "z", "Z", "z", 2)])
    a, b = ({(r.bank, r.source_id): (r.is_new, r.n_updates, r.n_rows, r.w and r.w.title) for r in p.collect()}
            for p in (plan_unique(state1, unique), plan_upsert(state1, unique)))
    assert a == b and a["b1", "hot"] == (False, 0, 1, None) and a["b2", "z"] == (True, 0, 1, "z")


def test_failure_alerts_equal_a_scan(spark):
    rnd = random.Random(5)
    rows = [(f"r{k:04d}", rnd.choice(["a", "b", None]), f"2026-01-{rnd.randint(1, 9):02d} {rnd.randrange(24):02d}:00:00",
             rnd.choice(["failed", "failed", "success", "running"]), f"e{k}") for k in range(300)] + [("x", "a", None, "failed", "e")]
    df = spark.createDataFrame(rows, "id string, bank string, started string, status string, error_message string") \
        .withColumn("started_at", F.col("started").cast("timestamp_ntz"))
    want = {}
    for bank in ("a", "b", None):
        streak = 0
        mine = sorted((r for r in rows if r[1] == bank and r[2]), key=lambda r: r[0], reverse=True)
        for r in sorted(mine, key=lambda r: r[2]):
            streak = streak + 1 if r[3] == "failed" else 0
            if streak >= 3:
                want[r[0]] = (streak, r[4])
    got = {r.id: (r.consecutive_failures, r.last_error) for r in failure_alerts(df).collect()}
    assert got == want and len(want) > 20 and max(v[0] for v in want.values()) > 5


def test_two_snapshots_in_one_batch(spark, tmp_path):
    tiles = load_promo_tiles(spark, SF).filter("l_orderkey % 60 = 0").withColumn("_k", (F.col("l_orderkey") + F.col("l_linenumber")) % 4)
    one = tiles.filter("_k <> 2").drop("_k")
    two = tiles.filter("_k <> 0").withColumn("image_raw", F.when(F.col("_k") == 1, "/img/v2.jpg").otherwise(F.col("image_raw"))).drop("_k")
    whole = TableStore(spark, f"{tmp_path}/whole")
    for name, part, now in (("s1", one, "2026-03-01 06:00:00"), ("s2", two, "2026-03-02 06:00:00")):
        ingest_batch(whole, "promotions", "audit", part, name, now, name)
        close_snapshot(whole, "promotions", name, now, "audit")

    def marked(part, name, ended):
        rows = part.withColumn("end_of_snapshot", F.lit(False))
        end = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in part.dtypes), F.lit(True).alias("end_of_snapshot"))
        return (rows.unionByName(end) if ended else rows).withColumn("snapshot_id", F.lit(name))

    half = F.col("l_linenumber") % 2 == 0
    stray = one.limit(2).withColumn("bank", F.lit("moon"))
    files = [marked(one.where(half).unionByName(stray), "s1", False), marked(one.where(~half), "s1", True).unionByName(marked(two.where(half), "s2", False)),
             marked(two.where(~half), "s2", True)]
    for k, rows in enumerate(files):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    mixed = TableStore(spark, f"{tmp_path}/mixed")
    schema = files[0].schema
    q = start_ingest_stream(spark, f"{tmp_path}/in/*", schema, store=mixed, checkpoint=f"{tmp_path}/ckpt", files_per_batch=10,
                            run_time=lambda b: "2026-03-02 06:00:00", snapshot_col="snapshot_id")
    q.awaitTermination(300)
    keys = ["bank", "source_id", "checksum", "is_active"]
    a, b = (sorted(map(tuple, s.read("promotions").select(*keys).collect())) for s in (whole, mixed))
    assert a == b and any(not r[3] for r in a)

    def audit(s):
        return {(r.snapshot_id, r.bank): (r.status, r.promotions_found, r.promotions_new, r.promotions_updated, r.promotions_deactivated)
                for r in stream_audit(s, "audit" if s is whole else "scrape_runs").collect()}

    assert audit(whole) == audit(mixed)  # every batch's audit is readable: one row per source and snapshot
    assert {k[0] for k in audit(whole)} == {"s1", "s2"} and all(v[0] == "success" for v in audit(whole).values())
    assert sum(v[4] for v in audit(whole).values()) == sum(not r[3] for r in a)
    assert [(r.snapshot_id, r.bank, r.reason) for r in mixed.read_all("promotions_rejects").collect()] == [("s1", "moon", "unknown source")] * 2
    assert mixed.read_all("promotions_seen") is None  # keys of closed snapshots are dropped
    # replays do nothing, and a closed snapshot takes no more rows
    assert ingest_mixed_batch(mixed, "promotions", "scrape_runs", files[2], "stream-0", "2026-03-02 06:00:00") == []
    with pytest.raises(ValueError, match="closed"):
        ingest_mixed_batch(mixed, "promotions", "scrape_runs", files[0], "late", "2026-03-03 06:00:00")
    with pytest.raises(ValueError, match="without a snapshot"):
        ingest_mixed_batch(mixed, "promotions", "scrape_runs", files[0].withColumn("snapshot_id", F.lit(None).cast("string")), "x", NOW1)


def test_run_state_rewrites_touched_buckets_alone(spark, store):
    events = load_run_events(spark, SF).cache()
    assert run_state(store) is None
    thirds = [events.where(F.pmod(F.xxhash64("id", "status"), F.lit(3)) == k) for k in range(3)]
    for k, part in enumerate(thirds):
        assert fold_batch(store, "run_state", part, f"b{k}") is True
    assert fold_batch(store, "run_state", thirds[0], "b0") is False
    want = sorted(map(tuple, fold_runs(events).select(*RUN_COLUMNS).collect()), key=str)
    assert sorted(map(tuple, run_state(store).select(*RUN_COLUMNS).collect()), key=str) == want
    one = events.limit(1)
    before = store.latest("run_state")["parts"]
    fold_batch(store, "run_state", one, "again")
    after = store.latest("run_state")["parts"]
    assert [k for k in after if after[k] != before.get(k)] == [one.select(bucket_of().alias("b")).first().b]
    assert sorted(map(tuple, run_state(store).select(*RUN_COLUMNS).collect()), key=str) == want
    events.unpersist()
