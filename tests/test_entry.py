"""Driver contract: entry runs, every registered query plans and runs on sf0.001."""
import __spark_entry__ as E
from conftest import SF


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"bank", "discount_type", "n_rows"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_run(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        df.limit(5).collect()
