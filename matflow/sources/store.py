"""Versioned snapshots on a shared folder.

Each table has one root directory; every write goes to a fresh
``batch=<tag>`` partition directory under it. A version is one small JSON file
naming, per table, the batch tags that make it up (at most ``MAX_BATCHES``; then
an append rewrites the table as one batch) and the highest id ever given. It
exists only once that file is created, so a half-written batch is never visible.
The file of the next version can be created once: a second writer who started
from the same version fails (``ConcurrentCommit``) and must start again.

A commit can rewrite a table (new tag only), keep it (the previous tags) or
append to it (previous tags plus one): appending jobs or audit rows writes
only the new rows, not the table. A commit can also name the first day that stays
in the batches so far of a table laid out by day. Readers filter on ``batch`` and
day (partition pruning).
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("batches", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("marks", T.MapType(T.StringType(), T.LongType())),
    T.StructField("committed_ms", T.LongType()),
    T.StructField("first_days", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
])

# batch directories of one table in one version
MAX_BATCHES = 32


class ConcurrentCommit(RuntimeError):
    """Another writer has already committed this version."""


# rows per file: bounds file size whatever the number of partitions
MAX_RECORDS_PER_FILE = 5_000_000


def _by_range(df: DataFrame, n: int | None, *cols: str) -> DataFrame:
    return df.repartitionByRange(*cols) if n is None else df.repartitionByRange(n, *cols)


def _layout_stock(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    # id ranges per file: point lookups and id joins skip files by min/max
    return _by_range(df, n, "id").sortWithinPartitions("id"), []


def _layout_users(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    return _by_range(df, n, "id").sortWithinPartitions("id"), []


def _layout_production(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    # disjoint date ranges per file and sorted row groups: date filters and
    # newest-first top-k read few row groups; n files give n scan tasks
    return _by_range(df, n, "date_prod", "id").sortWithinPartitions("date_prod", "id"), []


def _layout_audit(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    # one directory per day (retention drops whole days by partition pruning);
    # range partitioning spreads a hot day over several tasks and keeps the
    # rows of a record together for the history window
    df = df.withColumn("audit_date", F.to_date("timestamp"))
    return (_by_range(df, n, "audit_date", "table_name", "record_id")
            .sortWithinPartitions("audit_date", "table_name", "record_id", "timestamp"),
            ["audit_date"])


def _layout_figures(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    # a row per band, statut and month: one file
    return df.coalesce(1), []


#: Tables laid out in directories by day, and their day column.
DAY_COLUMNS = {"audit": "audit_date"}

LAYOUTS = {"figures": _layout_figures, "stock": _layout_stock, "production": _layout_production,
           "audit": _layout_audit, "users": _layout_users}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def _log(self) -> str:
        return f"{self.root}/_log"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def head(self):
        """(version, root, tables, batches per table, highest ids, first day of batches per
        table) of the newest commit, or None."""
        fs, log = self._fs(self._log)
        if not fs.exists(log):
            return None
        e = self.spark.read.schema(_LOG_SCHEMA).json(self._log).orderBy(F.desc("version")).limit(1).collect()
        if not e:
            return None
        b = {k: list(v) for k, v in (e[0]["batches"] or {}).items()}
        days = {k: dict(v) for k, v in (e[0]["first_days"] or {}).items()}
        return (e[0]["version"], self.root, sorted(b), b, dict(e[0]["marks"] or {}), days)

    def read(self, table: str, head=None) -> DataFrame:
        h = head or self.head()
        if h is None:
            raise FileNotFoundError(f"no snapshot committed under {self.root}")
        first = h[5].get(table, {})
        keep = F.col("batch").isin(h[3][table])
        for day in sorted(set(first.values())):
            cut = [tag for tag, d in first.items() if d == day]
            keep = keep & (~F.col("batch").isin(cut) | (F.col(DAY_COLUMNS[table]) >= F.lit(day).cast("date")))
        return self.spark.read.parquet(f"{self.root}/{table}").where(keep).drop("batch")

    def _write(self, name: str, df: DataFrame, tag: str, n: int | None) -> None:
        layout = LAYOUTS.get(name, lambda d, k: (d, []))
        out, parts = layout(df, n)
        w = out.write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{self.root}/{name}/batch={tag}")

    def _record(self, version: int, batches: dict, marks: dict, first_days: dict) -> None:
        fs, target = self._fs(f"{self._log}/v{version:09d}.json")
        row = {"version": version, "batches": batches, "marks": marks, "committed_ms": int(time.time() * 1000),
               "first_days": first_days}
        try:
            out = fs.create(target, False)     # fails if the file is there
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise ConcurrentCommit(f"version {version} of {self.root} was committed by another writer") from e
            raise
        out.write((json.dumps(row) + "\n").encode())
        out.close()

    def commit(self, tables: dict[str, DataFrame], keep=(), append: dict | None = None,
               marks: dict | None = None, head=None, first_day: dict[str, dt.date] | None = None) -> int:
        """Write a new version: ``tables`` are rewritten, ``keep`` names
        tables taken over as they are, ``append`` adds rows to tables.
        Tables not named are dropped from the version. ``marks``: highest ids given,
        merged with those of the version before. ``head``: the version the batch was
        computed from (default: the newest one). ``first_day``: per table, the day before
        which no row of its batches so far stays (no row is read or written for that);
        appended rows are not concerned."""
        h = head if head is not None else self.head()
        version = 0 if h is None else h[0] + 1
        prev, old_marks = ({}, {}) if h is None else (h[3], h[4])
        tag = f"v{version:06d}-{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        batches = {}
        for name, df in tables.items():
            self._write(name, df, tag, n)
            batches[name] = [tag]
        for name in keep:
            batches[name] = list(prev[name])
        days = {} if h is None else {k: dict(v) for k, v in h[5].items()}
        for name, day in (first_day or {}).items():
            own = days.setdefault(name, {})
            for t in prev[name]:
                own[t] = max(own.get(t, ""), day.isoformat())
        h = h and (*h[:5], days)
        for name, df in (append or {}).items():
            before = list(prev.get(name, []))
            if len(before) >= MAX_BATCHES:
                whole = self.read(name, h).select(df.columns).unionByName(df)
                self._write(name, whole, tag, n)
                batches[name] = [tag]
            else:
                # an appended batch is sized by AQE, not by the table's file count
                self._write(name, df, tag, None)
                batches[name] = before + [tag]
        merged = {**old_marks, **{k: max(int(v or 0), old_marks.get(k, 0)) for k, v in (marks or {}).items()}}
        days = {k: {t: d for t, d in v.items() if t in batches.get(k, ())} for k, v in days.items()}
        self._record(version, batches, merged, {k: v for k, v in days.items() if v})
        return version
