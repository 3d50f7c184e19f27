"""The streamed result equals the batch result."""
import os
import tempfile
import types

import pytest
from pyspark.sql import functions as F

from conftest import SF
from promospark.operators.runs import RUN_COLUMNS, fold_runs
from promospark.operators.upsert import STATE_COLUMNS
from promospark.plans import ingest as I
from promospark.plans.store import TableStore
from promospark.sources.feeds import load_promo_tiles, load_run_events
from promospark.streaming.ingest import close_snapshot, ingest_batch, start_ingest_stream
from promospark.streaming.runs import start_run_state_stream


def test_stream_ingest_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(root, "in")
    tiles = load_promo_tiles(spark, SF).withColumn("_k", (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 10)
    s1 = tiles.filter(F.col("_k") != 2).drop("_k")
    s2 = (tiles.filter(F.col("_k") != 0)
          .withColumn("image_raw", F.when(F.col("_k") == 1, F.lit("/img/v2.jpg")).otherwise(F.col("image_raw")))
          .drop("_k"))
    s1.coalesce(1).write.parquet(os.path.join(src, "b1"))
    s2.coalesce(1).write.parquet(os.path.join(src, "b2"))
    # one folder per batch, moved into the watched folder in order
    watched = os.path.join(root, "watched")
    os.makedirs(watched)
    for i, b in enumerate(("b1", "b2")):
        f = [x for x in os.listdir(os.path.join(src, b)) if x.endswith(".parquet")][0]
        os.rename(os.path.join(src, b, f), os.path.join(watched, f"{i}-{f}"))
        os.utime(os.path.join(watched, f"{i}-{f}"), (1_000_000 + i, 1_000_000 + i))
    store = TableStore(spark, os.path.join(root, "store"))
    times = {0: I.NOW_1, 1: I.NOW_2}
    q = start_ingest_stream(spark, watched, s1.schema, store=store, run_time=lambda b: times[b],
                            checkpoint=os.path.join(root, "ckpt"), snapshot_of=lambda b: f"s{b}")
    q.awaitTermination(300)
    assert store.read("promotions").filter("NOT is_active").count() == 0  # not before the snapshot is complete
    assert close_snapshot(store, "promotions", "s1", I.NOW_2) is True
    assert close_snapshot(store, "promotions", "s1", I.NOW_2) is False
    streamed = store.read("promotions").select(*STATE_COLUMNS)
    batch = I.promotions_table(spark, SF)
    cols = ["id", "checksum", "is_active", "created_at", "updated_at"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    assert len(store.versions("promotions")) == 3
    # replaying a committed batch id is a no-op
    assert ingest_batch(store, "promotions", "scrape_runs", s2, "stream-1", I.NOW_2) is False


def test_snapshot_in_three_batches_with_a_loss_between_the_commits(spark):
    root = tempfile.mkdtemp(prefix="parts-")
    tiles = load_promo_tiles(spark, SF).filter("l_orderkey % 40 = 0")
    whole, parts = TableStore(spark, root + "/whole"), TableStore(spark, root + "/parts")
    ingest_batch(whole, "promotions", "audit", tiles, "b0", I.NOW_1, "one")
    for i in range(3):
        part = tiles.filter((F.col("hub_ord") % 3) == i)
        if i == 1:  # the audit was written and the state was not
            parts.commit("audit", spark.range(1).selectExpr("'lost' AS bank"), f"b{i}")
        assert ingest_batch(parts, "promotions", "audit", part, f"b{i}", I.NOW_1, "one") is True
    close_snapshot(parts, "promotions", "one", I.NOW_2)
    keys = ["bank", "source_id", "is_active"]
    a, b = (sorted(map(tuple, s.read("promotions").select(*keys).collect())) for s in (whole, parts))
    assert a == b and all(r[2] for r in a) and len(a) > 0
    assert len(parts.versions("audit")) == 3


@pytest.mark.parametrize("lost_after", ["audit", "promotions_seen", "promotions"])
def test_loss_after_each_commit_and_a_changed_key(spark, monkeypatch, lost_after):
    from promospark.streaming import ingest as W
    columns = ["bank", "source_id", "image_url"]

    def upserted(state, incoming, now, **_):
        old = state.join(incoming, ["bank", "source_id"], "left_anti").select(*columns)
        return types.SimpleNamespace(audit=incoming.groupBy("bank").count(), state=old.unionByName(incoming))

    for name, stub in (("normalize_tiles", lambda df: df), ("first_seen", lambda df: df), ("run_ingest", upserted),
                       ("initial_state", lambda df, now: df), ("STATE_COLUMNS", columns)):
        monkeypatch.setattr(W, name, stub)
    store = TableStore(spark, tempfile.mkdtemp(prefix="losses-") + "/store")

    def brought(*rows):
        return spark.createDataFrame([("ktc", k, v) for k, v in rows], "bank string, source_id string, image_url string")

    def table():
        return {r.source_id: r.image_url for r in store.read("promotions").collect()}

    with pytest.raises(ValueError):
        ingest_batch(store, "promotions", "audit", brought(("a", "1")), "b0", "now")  # no snapshot named
    assert ingest_batch(store, "promotions", "audit", brought(("a", "1")), "b0", "now", "one") is True
    second = brought(("a", "repeated"), ("b", "2"))
    commit = TableStore.commit

    def dying(self, name, *args, **kw):
        out = commit(self, name, *args, **kw)
        if name == lost_after:
            raise OSError("lost")
        return out

    with monkeypatch.context() as lost:
        lost.setattr(TableStore, "commit", dying)
        with pytest.raises(OSError):
            ingest_batch(store, "promotions", "audit", second, "b1", "now", "one")
    assert ingest_batch(store, "promotions", "audit", second, "b1", "now", "one") is (lost_after != "promotions")
    assert table() == {"a": "1", "b": "2"}
    assert sorted(r.source_id for r in W._seen_keys(store, "promotions", "one").collect()) == ["a", "b"]
    assert ingest_batch(store, "promotions", "audit", brought(("a", "changed")), "b2", "now", "two") is True
    assert table() == {"a": "changed", "b": "2"}


def test_stream_needs_snapshot_names(spark):
    with pytest.raises(TypeError):
        start_ingest_stream(spark, "/nowhere", "a INT")


def test_unreadable_version_log_raises(spark):
    root = tempfile.mkdtemp(prefix="log-")
    store = TableStore(spark, root)
    assert store.versions("t") == []
    os.makedirs(f"{root}/t/_versions")
    with open(f"{root}/t/_versions/part-0.json.gz", "wb") as f:
        f.write(b"not gzip")
    with pytest.raises(Exception):
        store.versions("t")


def test_stream_run_state_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="runs-")
    ev = load_run_events(spark, SF)
    ev.write.parquet(os.path.join(root, "events"))
    store = TableStore(spark, os.path.join(root, "store"))
    q = start_run_state_stream(spark, os.path.join(root, "events"), ev.schema, store=store,
                               checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    streamed = store.read("run_state").select(*RUN_COLUMNS)
    batch = fold_runs(ev).select(*RUN_COLUMNS)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
