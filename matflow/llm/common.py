"""Shared-folder tables and small column helpers of the llm operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matflow.session import delete_at_exit, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``; it is
    deleted when the driver's JVM ends in good order."""
    return delete_at_exit(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}")


#: Most bytes of an Arrow batch on its way to a Python worker (a longer row goes alone).
BATCH_BYTES = 16 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started within send Arrow batches of at most ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release_memory() -> None:
    """In a Python worker: what earlier tasks freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def whole_texts_within(docs: DataFrame, picked: DataFrame, label: str, chars: int) -> list[tuple[str, str]]:
    """(text, label) of the ``picked`` rows (doc_id, label; a bounded number), whole texts in
    the order of the ids' hashes, as many of each label as fit in ``chars`` code points
    (one at least). Of rows with one id the least text counts."""
    texts = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
             .join(F.broadcast(picked), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    before = F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fits = (F.coalesce("before", F.lit(0)) + F.length("text") <= chars) | F.col("before").isNull()
    kept = texts.withColumn("before", before).where(fits).orderBy("doc_id")
    return [(r["text"], r[label]) for r in kept.select("text", label).collect()]


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored copy: lineage is
    cut, and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_folder(spark, label) + "/t"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
