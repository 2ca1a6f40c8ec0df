"""Typed access to the four domain tables.

``open_tables(spark, sf_dir)`` returns the domain tables of one input folder.
By default they are derived once per input snapshot and kept in the snapshot
store under the cluster's shared ``spark.checkpoint.dir``; later queries read
the stored, laid-out copy (as the source application reads its own tables).
With ``on_use`` a table is derived when it is first read, so a query derives and
stores no table that it does not read.
With ``materialize=False`` the tables stay lazy plans over the raw parquet.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import figures
from ..session import ensure_checkpoint_dir
from . import fixtures
from .store import ConcurrentCommit, SnapshotStore

DOMAIN_TABLES = ("stock", "production", "audit", "users")
# bumped when the stored layout changes, so old snapshots are not reused
LAYOUT_VERSION = 5


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str
    stock: DataFrame
    production: DataFrame
    audit: DataFrame          # schema columns plus ``audit_date`` when stored
    users: DataFrame
    store: SnapshotStore | None = None
    head: tuple | None = None     # the version these tables are
    _raw: dict = field(default_factory=dict)

    def mark(self, table: str) -> int:
        """The highest id of ``table`` ever given, as far as commits recorded it."""
        return self.head[4].get(table, 0) if self.head else 0

    def figures(self) -> DataFrame:
        """The partial sums of this version (``operators.figures``): the stored ones, or
        those of the tables where none are kept."""
        if self.store is not None and self.head and figures.TABLE in self.head[3]:
            return self.store.read(figures.TABLE, self.head)
        return figures.partial_sums(self.stock, self.production)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = fixtures.read_raw(self.spark, self.sf_dir, name)
        return self._raw[name]


class StoredTables(Tables):
    """The tables of an input folder in its snapshot store, each derived when it is first read."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: SnapshotStore):
        self.spark, self.sf_dir, self.store = spark, sf_dir, store
        self.head, self._raw = store.head(), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DOMAIN_TABLES:
            raise AttributeError(name)
        self.derive(name)
        setattr(self, name, self.store.read(name, self.head))
        return getattr(self, name)

    def figures(self) -> DataFrame:
        self.derive(figures.TABLE)
        return self.store.read(figures.TABLE, self.head)

    def derive(self, *names: str) -> None:
        """Commit those of the tables that the newest version does not hold."""
        while missing := [n for n in names if self.head is None or n not in self.head[3]]:
            if figures.TABLE in missing:
                new = {figures.TABLE: figures.partial_sums(self.stock, self.production)}
            else:
                new = fixtures.derive_tables(self.spark, self.sf_dir, missing)
            if store_for(self.spark, self.sf_dir).root != self.store.root:
                raise RuntimeError(f"{self.sf_dir} has changed since it was opened: open it again")
            try:
                self.store.commit(new, keep=self.head[3] if self.head else (), head=self.head)
            except ConcurrentCommit:     # perhaps of the same tables
                pass
            self.head = self.store.head()


_STATUS = re.compile(r"path=([^;]*); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+)")


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of path, length and time of every file below the input folder, listed in the
    driver through Hadoop's file system, one call a folder; no job, no content read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, files = [root], []
    while folders:
        listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(folders.pop()))
        for path, is_folder, length, changed in _STATUS.findall(listed):
            if is_folder == "true":
                folders.append(jvm.org.apache.hadoop.fs.Path(path))
            else:
                files.append(f"{path}|{length}|{changed}")
    return hashlib.sha1("\n".join([sf_dir, *sorted(files)]).encode()).hexdigest()[:16]


_CACHE: dict = {}


def store_for(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    root = ensure_checkpoint_dir(spark)
    return SnapshotStore(spark, f"{root.rstrip('/')}/matflow-store/v{LAYOUT_VERSION}-{_fingerprint(spark, sf_dir)}")


def open_tables(spark: SparkSession, sf_dir: str, materialize: bool | None = None, on_use: bool = False) -> Tables:
    if materialize is None:
        materialize = os.environ.get("MATFLOW_MATERIALIZE", "1") != "0"
    if not materialize:
        t = fixtures.derive_tables(spark, sf_dir)
        return Tables(spark, sf_dir, t["stock"], t["production"], t["audit"], t["users"])
    store = store_for(spark, sf_dir)
    key = (spark.sparkContext.applicationId, store.root)
    t = _CACHE.get(key)
    if t is None:
        t = _CACHE[key] = StoredTables(spark, sf_dir, store)
    if not on_use:
        t.derive(*DOMAIN_TABLES)
        t.derive(figures.TABLE)
    return t


def tables_at(spark: SparkSession, store: SnapshotStore, sf_dir: str = "") -> Tables:
    """The current version of ``store``."""
    h = store.head()
    if h is None:
        raise FileNotFoundError(f"no snapshot committed under {store.root}")
    return Tables(spark, sf_dir, store.read("stock", h), store.read("production", h),
                  store.read("audit", h), store.read("users", h), store=store, head=h)


def fork_tables(t: Tables, root: str) -> Tables:
    """Copy the four tables of ``t`` into a new store at ``root`` (version 0)
    and open it: later commits there leave ``t``'s store untouched."""
    store = SnapshotStore(t.spark, root)
    store.commit({"stock": t.stock, "production": t.production,
                  "audit": audit_columns(t.audit), "users": t.users, figures.TABLE: t.figures()})
    return tables_at(t.spark, store, t.sf_dir)


def audit_columns(audit: DataFrame) -> DataFrame:
    """The audit table without its storage partition column."""
    return audit.select([F.col(f.name) for f in schemas.AUDIT.fields])
