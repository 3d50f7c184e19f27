"""Versioned table store on a shared file system.

There is no table format here (no MERGE target), so a run writes new files under
``<root>/<table>/v=<N>-<batch>/`` and only then records version N in
``<root>/<table>/_versions`` (one JSON file per committed version, with the batch
id that produced it). Readers use the last committed version, so a run that dies
half-way leaves the previous version intact, and a replayed batch id is recognised
and skipped (idempotent re-runs). The record of a version is created only if it
isn't there: of two writers of the same version one fails with ``CommitConflict``.

A version may consist of parts (one folder per source, or per bucket):
``commit_parts`` writes the parts that a run touched, and the new version names the
other parts' folders of the version before. ``append`` and ``read_all`` keep tables
that only grow. ``expire`` and ``forget`` delete files that no kept version names.

The store root lives under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``); writing a table there also cuts the lineage of
the large extraction plans.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.session import checkpoint_dir, setting


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or checkpoint_dir(spark).rstrip("/") + "/promospark-store"

    # -- paths -----------------------------------------------------------
    def _table_dir(self, table: str) -> str:
        return self.root.rstrip("/") + "/" + table

    def _log(self, table: str) -> str:
        return self._table_dir(table) + "/_versions"

    def versions(self, table: str) -> list[dict]:
        """Committed versions (a tiny JSON dataset written through Spark, so any
        Hadoop-compatible file system works)."""
        if not path_exists(self.spark, self._log(table)):
            return []
        rows = self.spark.read.schema(_LOG_SCHEMA).json(self._log(table)).collect()
        return sorted((r.asDict() for r in rows), key=lambda v: v["version"])

    def latest(self, table: str) -> dict | None:
        v = self.versions(table)
        return v[-1] if v else None

    def has_batch(self, table: str, batch_id: str) -> bool:
        return any(v.get("batch_id") == batch_id for v in self.versions(table))

    # -- read / write ----------------------------------------------------
    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self.latest(table) if version is None else next(
            v for v in self.versions(table) if v["version"] == version)
        if entry is None:
            raise FileNotFoundError(f"table {table!r} has no committed version")
        parts = entry.get("parts")
        return self.spark.read.parquet(*[parts[k] for k in sorted(parts)]) if parts else self.spark.read.parquet(entry["path"])

    def read_all(self, table: str, tag: str | None = None) -> DataFrame | None:
        """The rows of every version of a table that only grows, or of those with ``tag``; None where there are none."""
        paths = [v["path"] for v in self.versions(table) if v["path"] and (tag is None or v["tag"] == tag)]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, table: str, df: DataFrame, batch_id: str,
               partition_by: list[str] | None = None, tag: str | None = None) -> dict:
        """Write ``df`` as the next version of ``table`` and record it. A batch id
        that was already committed is not written again."""
        versions = self.versions(table)
        for v in versions:
            if v.get("batch_id") == batch_id:
                return v
        version = (versions[-1]["version"] + 1) if versions else 1
        path = self._table_dir(table) + f"/v={version}-{_short(batch_id)}"
        self._write(df, path, partition_by)
        return self._record(table, {"version": version, "path": path, "batch_id": batch_id, "tag": tag})

    def commit_passes(self, table: str, passes: Iterable[DataFrame], batch_id: str, name: str,
                      partition_by: list[str] | None = None) -> dict:
        """``commit`` of the rows of all ``passes``, which are written one after another, the k-th to the folder
        ``<name>=<k>`` of the version: shuffles need the disk of one pass at a time. Rows read back have the column ``name``."""
        versions = self.versions(table)
        for v in versions:
            if v.get("batch_id") == batch_id:
                return v
        version = (versions[-1]["version"] + 1) if versions else 1
        path = self._table_dir(table) + f"/v={version}-{_short(batch_id)}"
        self._delete(path)  # folders of a writer that died before it recorded the version
        for k, df in enumerate(passes):
            self._write(df, f"{path}/{name}={k}", partition_by)
        return self._record(table, {"version": version, "path": path, "batch_id": batch_id})

    def _write(self, df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
        """Rows are kept compressed, and the shuffle files of the write go as soon as it is done."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with setting(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            writer.parquet(path)

    #: A version of a table that only grows is what one batch brought to it (``read_all``).
    append = commit

    def commit_parts(self, table: str, df: DataFrame, batch_id: str, part: str, touched: list) -> dict:
        """The next version of ``table``: the parts ``touched`` (values of the column ``part``) with the rows of
        ``df``, which has rows of those parts alone, and the other parts as they are."""
        versions = self.versions(table)
        for v in versions:
            if v.get("batch_id") == batch_id:
                return v
        version = (versions[-1]["version"] + 1) if versions else 1
        path = self._table_dir(table) + f"/v={version}-{_short(batch_id)}"
        self._write(df.withColumn("_part", F.col(part).cast("string")), path, ["_part"])
        parts = dict(versions[-1]["parts"] or {}) if versions else {}
        for value in map(str, touched):
            folder = f"{path}/_part={quote(value)}"
            parts.pop(value, None)
            if path_exists(self.spark, folder):
                parts[value] = folder
        # Where a version has no rows at all, its own folder has the schema.
        return self._record(table, {"version": version, "path": path, "batch_id": batch_id, "parts": parts})

    def read_parts(self, table: str, values: list | None = None) -> DataFrame | None:
        """The last version of a table in parts, or its parts ``values`` alone; None where there are none."""
        entry = self.latest(table)
        parts = (entry or {}).get("parts") or {}
        paths = [p for v, p in sorted(parts.items()) if values is None or v in set(map(str, values))]
        return self.spark.read.parquet(*paths) if paths else None

    def _record(self, table: str, entry: dict) -> dict:
        """Record a version unless somebody else has recorded it."""
        fs, path = _file_system(self.spark, self._log(table) + f"/v{entry['version']:08d}.json")
        data = (json.dumps({k: v for k, v in entry.items() if v is not None}, ensure_ascii=False) + "\n").encode()
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise CommitConflict(f"version {entry['version']} of {table!r} was committed by another writer") from e
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return entry

    # -- retention -------------------------------------------------------
    def expire(self, table: str, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions names; returns their number."""
        versions = self.versions(table)

        def named(v: dict) -> set[str]:
            return set((v["parts"] or {}).values()) or {v["path"]}

        kept = set().union(*map(named, versions[-keep:])) if versions else set()
        gone = set().union(*map(named, versions[:-keep])) - kept if len(versions) > keep else set()
        return sum(map(self._delete, gone))

    def forget(self, table: str, tag: str) -> int:
        """Delete the rows of the versions with ``tag`` of a table that only grows; their records stay, so that
        replays of their batches are still recognised, but name no rows any more."""
        gone = [v for v in self.versions(table) if v["tag"] == tag and v["path"]]
        for v in gone:
            fs, path = _file_system(self.spark, self._log(table) + f"/v{v['version']:08d}.json")
            stream = fs.create(path, True)
            stream.write(bytearray((json.dumps({"version": v["version"], "batch_id": v["batch_id"], "tag": tag}) + "\n").encode()))
            stream.close()
            self._delete(v["path"])
        return len(gone)

    def _delete(self, folder: str) -> bool:
        fs, path = _file_system(self.spark, folder)
        return bool(fs.exists(path) and fs.delete(path, True))


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


_LOG_SCHEMA = "version INT, path STRING, batch_id STRING, tag STRING, parts MAP<STRING, STRING>"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on any file system Spark reads; errors raise."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _short(s: str) -> str:
    return hashlib.sha1(s.encode()).hexdigest()[:12]


def _input_files(spark: SparkSession, sf_dir: str, table: str) -> list:
    """The files of an input table, as the file system that Spark reads them from gives them."""
    fs, path = _file_system(spark, f"{sf_dir}/{table}.parquet")
    found = []
    if fs.exists(path):
        files = fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next())
    return found


def input_fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Identity of an input folder: path, sizes and times of the used tables' files."""
    parts = [sf_dir]
    for t in tables:
        parts += sorted(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}" for st in _input_files(spark, sf_dir, t))
    return _short("|".join(parts))


def input_bytes(spark: SparkSession, sf_dir: str, tables: list[str]) -> int:
    """Bytes of the used tables' files."""
    return sum(st.getLen() for t in tables for st in _input_files(spark, sf_dir, t))
