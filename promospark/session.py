"""Spark session helpers.

The library never creates cluster resources on its own: ``get_spark`` is for
tests, the bench and local runs. On a cluster the caller's session is used
as-is; only ``checkpoint_dir`` reads (and, where unset, fills) the shared
checkpoint location.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a Spark user sets for this workload: AQE for runtime re-planning
# (coalescing, skew-join splitting, broadcast conversion by measured size),
# a bounded broadcast threshold, session time zone fixed to UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Plans carry large CASE expressions (one branch per source); keep the
    # plan descriptions Spark renders for listeners short.
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.maxPlanStringLength": "20000",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "promospark", extra: dict | None = None) -> SparkSession:
    """Local/test session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting names a folder that all executors share and is used unchanged.
    Where it is unset, a scratch folder is made for a local master only; on a
    cluster other executors could not read it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="promospark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="package-code-"), f"{os.path.basename(package)}.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition when ``df`` has fewer partitions than the cluster
    has cores (e.g. a small file stored as one row group), so the CPU-heavy
    projections that follow run on every core. Large inputs already arrive in
    many splits and pass through untouched (no extra shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


RUNTIME_CONF = {
    # HotSpot never compiles methods of more than 8000 bytes: such stages run as one operator after another.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.maxPlanStringLength": "20000",
}


@contextmanager
def setting(spark: SparkSession, conf: dict[str, str]):
    """``conf`` holds inside, in place of what the session says."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings this library relies on to a given session."""
    for k, v in RUNTIME_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 - a locked-down session keeps its own values
            pass
    return spark
