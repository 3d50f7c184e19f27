"""The set-wise upsert equals a sequential row-by-row fold (the
row-by-row semantics, incl. repeated keys in one batch) on random batches."""
import random

from pyspark.sql import functions as F

from promospark.operators.upsert import (apply_upsert, deactivate_missing, initial_state,
                                         plan_upsert, upsert_counts)
from promospark.operators.extract import PROMOTION_COLUMNS

NOW1, NOW2 = "2026-01-01 00:00:00", "2026-01-02 00:00:00"


def rows_df(spark, rows):
    """rows: (bank, source_id, checksum, title, seq)"""
    data = [(f"{b}/{s}", b, s, "u", t, "", None, [], None, None, None, None, None, None, None, None,
             "{}", c, None, q) for (b, s, c, t, q) in rows]
    schema = ("id STRING, bank STRING, source_id STRING, source_url STRING, title STRING, description STRING, "
              "image_url STRING, card_types ARRAY<STRING>, category STRING, merchant_name STRING, "
              "discount_type STRING, discount_value STRING, minimum_spend DOUBLE, start_date DATE, "
              "end_date DATE, terms_and_conditions STRING, raw_data STRING, checksum STRING, "
              "scraped_at TIMESTAMP_NTZ, seq BIGINT")
    return spark.createDataFrame(data, schema).withColumn("ord", F.struct("seq"))


def fold(stored: dict, batch):
    """Sequential row-by-row semantics; returns (state, new, updated)."""
    state = {k: dict(v) for k, v in stored.items()}
    new = updated = 0
    for (b, s, c, t, q) in sorted(batch, key=lambda r: r[4]):
        cur = state.get((b, s))
        if cur is None:
            state[(b, s)] = {"checksum": c, "title": t, "is_active": True}
            new += 1
        elif cur["checksum"] != c:
            cur["checksum"], cur["title"] = c, t
            updated += 1
    return state, new, updated


def test_upsert_matches_sequential_fold(spark):
    rnd = random.Random(7)
    for trial in range(3):
        keys = [("b1", f"k{i}") for i in range(6)] + [("b2", f"k{i}") for i in range(4)]
        stored_rows = [(b, s, rnd.choice("AB"), "old", i) for i, (b, s) in enumerate(keys) if rnd.random() < 0.5]
        batch = [(*rnd.choice(keys), rnd.choice("ABC"), f"t{j}", j * 3 + rnd.randrange(3))
                 for j in range(40)]
        # unique order: ties broken by position in the batch
        batch = [(b, s, c, t, q * 100 + j) for j, (b, s, c, t, q) in enumerate(batch)]
        state1 = initial_state(rows_df(spark, stored_rows).select(*PROMOTION_COLUMNS), NOW1)
        plan = plan_upsert(state1, rows_df(spark, batch), bucket_width=5 * 100)
        counts = {r["bank"]: (r["promotions_new"], r["promotions_updated"])
                  for r in upsert_counts(plan).collect()}
        nxt = {(r["bank"], r["source_id"]): (r["checksum"], r["title"], r["is_active"])
               for r in apply_upsert(state1, plan, NOW2).collect()}
        stored = {(b, s): {"checksum": c, "title": t, "is_active": True} for (b, s, c, t, _) in stored_rows}
        for bank in ("b1", "b2"):
            exp_state, n, u = fold({k: v for k, v in stored.items() if k[0] == bank},
                                   [r for r in batch if r[0] == bank])
            if any(r[0] == bank for r in batch):
                assert counts[bank] == (n, u), (trial, bank)
            for k, v in exp_state.items():
                assert nxt[k] == (v["checksum"], v["title"], True), (trial, k)


def test_soft_delete_only_refreshed_banks(spark):
    state = initial_state(rows_df(spark, [("b1", "a", "A", "t", 1), ("b1", "b", "A", "t", 2),
                                          ("b2", "c", "A", "t", 3)]).select(*PROMOTION_COLUMNS), NOW1)
    seen = spark.createDataFrame([("b1", "a")], "bank STRING, source_id STRING")
    refreshed = spark.createDataFrame([("b1",)], "bank STRING")
    out = {(r["bank"], r["source_id"]): (r["is_active"], r["deactivated"])
           for r in deactivate_missing(state, seen, refreshed, NOW2).collect()}
    assert out == {("b1", "a"): (True, False), ("b1", "b"): (False, True), ("b2", "c"): (True, False)}


def test_refreshed_sources_are_told_without_the_plan(spark):
    from promospark.plans.ingest import run_ingest
    from test_extract_steps import plan_text
    state = initial_state(rows_df(spark, [(b, s, "c", "t", 1) for b in "xyz" for s in "pq"]).drop("ord", "seq"), NOW1)
    batch = rows_df(spark, [("x", "p", "c", "t", 1), ("x", "p", "d", "t", 2), ("y", "q", "c", "t", 3), ("z", "p", "c", "t", 4)])
    failed = spark.createDataFrame([("z", "timed out")], "bank string, error_message string")
    run = run_ingest(state, batch, NOW2, failed)
    gone = {(r.bank, r.source_id) for r in run.state.where("deactivated").collect()}
    assert gone == {("x", "q"), ("y", "p")}  # z failed, so it isn't refreshed
    raw = run_ingest(state, batch.where("seq <> 2"), NOW2, failed, deduplicated=True, found=batch)
    assert {(r.bank, r.source_id) for r in raw.state.where("deactivated").collect()} == gone
    # One join with the stored checksums and one with the refreshed sources.
    assert plan_text(spark, run_ingest(state, batch, NOW2).state).count("Join LeftOuter") == 2


def test_states_made_in_passes_are_those_of_one_pass(spark, tmp_path, monkeypatch):
    import os
    import shutil
    from conftest import SF
    from promospark.plans import ingest as I
    from promospark.plans.catalog import REGISTRY
    from promospark.plans.store import TableStore
    from pyspark.sql import DataFrameWriter
    written = []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (written.append(path), parquet(self, path, *a, **b)))
    os.mkdir(one := f"{tmp_path}/one")
    os.mkdir(many := f"{tmp_path}/many")
    for t in ("lineitem", "part"):
        for d in (one, many):
            shutil.copy(f"{SF}/{t}.parquet", d)
    names = ["upsert_next_state", "upsert_run_counts", "upsert_batch_repeats", "deactivated_keys", "run_audit", "run_life_cycle",
             "dry_run_audit", "failed_source_isolation", "expiry_status", "detail_work_list", "facets"]
    want = {n: sorted(map(str, REGISTRY[n][0](spark, one).collect())) for n in names}
    monkeypatch.setattr(I, "PASS_BYTES", 30_000)
    passes = I.feed_passes(spark, many)
    assert passes > 3 and I.feed_passes(spark, one) == passes
    for n in names:
        assert sorted(map(str, REGISTRY[n][0](spark, many).collect())) == want[n] != [], n
    store = TableStore(spark)
    assert store.versions(I._promotions_table_name(spark, many))[1]["batch_id"] == "run-2"
    state = [p for p in written if f"{store.root}/{I._promotions_table_name(spark, many)}/" in p]
    assert [p.rsplit("/", 1)[1] for p in state] == [f"_pass={k}" for _ in (1, 2) for k in range(passes)]


def test_rows_are_chosen_by_the_columns_in_use_alone(spark, tmp_path):
    from promospark.operators.dedup import first_seen
    from test_extract_steps import plan_text
    path = f"{tmp_path}/rows"
    rows_df(spark, [("x", "p", "c", "t", 2), ("x", "p", "d", "u", 1), ("x", "q", "c", "t", 3)]).write.parquet(path)
    rows = spark.read.parquet(path)
    stored = initial_state(first_seen(rows.where("seq > 1")), NOW1)
    repeats = plan_upsert(stored, rows)
    assert {(r.source_id, r.w.checksum, r.w.title) for r in repeats.where("w IS NOT NULL").collect()} == {("p", "c", "t")}
    for chosen in (first_seen(rows).select("source_id", "checksum"), repeats.select("source_id", "w.checksum")):
        plan = "".join(line for line in plan_text(spark, chosen).splitlines() if "Relation [" not in line)
        assert "Window" in plan and "raw_data" not in plan and "description" not in plan
    # Rows of a key are reduced in the map tasks, before the shuffle.
    assert first_seen(rows)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
