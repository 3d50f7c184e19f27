"""Coverage-report sink — the A5-A9 DataFrames written as files.

The report is data, not Markdown: the per-bank table (with the grand total)
and the missing-merchant samples are written as CSV (one small folder each)
or parquet; rendering is left to the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promospark.operators import aggregates as A


def write_coverage_report(promotions: DataFrame, path: str, fmt: str = "csv", samples: int = 10) -> dict:
    """Write ``coverage`` (A5-A7), ``samples`` (A8) and ``low_coverage``."""
    out = {
        "coverage": A.coverage_report(promotions).orderBy("bank"),
        "samples": A.missing_merchant_samples(
            promotions, [F.col("scraped_at").desc_nulls_last(), F.col("id")], samples)
        .orderBy("bank", "sample_rank"),
        "low_coverage": A.low_coverage_banks(promotions).orderBy("bank"),
    }
    paths = {}
    for name, df in out.items():
        p = path.rstrip("/") + "/" + name
        w = df.coalesce(1).write.mode("overwrite")
        (w.option("header", True).csv(p) if fmt == "csv" else w.parquet(p))
        paths[name] = p
    return paths
