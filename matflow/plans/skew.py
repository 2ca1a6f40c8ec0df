"""Skew-safe building blocks shared by the operators.

* ``left_join_spread_nulls``: a left join whose null keys (which never match)
  are spread over many partitions instead of landing in one hot partition.
* ``dense_sequence``: consecutive ids 1..n in a given order without a global
  window (a single-partition ``row_number`` over all rows).
* ``dense_rank_desc``: DENSE_RANK by a descending time column within a key; a
  key holding a large share of the rows is split over its minutes.

Each is one declarative plan for every size of the data; none runs a job while the
plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# width of the id range that one window task of dense_sequence numbers
IDS_PER_BUCKET = 1 << 20


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key``.

    A null ``left_key`` gets a deterministic negative stand-in (hash of the row)
    so its rows spread over all shuffle partitions; the extra
    ``left_key IS NOT NULL`` condition keeps them from matching anything. With
    a small ``right`` AQE still turns this into a broadcast hash join.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    spread = F.coalesce(F.col(left_key), row_hash.bitwiseOR(F.lit(-(1 << 63))))
    lk = "__jk"
    l2 = left.withColumn(lk, spread)
    cond = (l2[lk] == right[right_key]) & l2[left_key].isNotNull()
    return l2.join(right, cond, "left").drop(lk)


def dense_sequence(df: DataFrame, order_col: str, out_col: str = "seq_no",
                   start: int | F.Column = 1, width: int = IDS_PER_BUCKET) -> DataFrame:
    """Add ``out_col`` = start + (position of the row in ``order_col`` order).

    ``order_col`` must be an integer and unique (an id). Rows are numbered within
    ranges of ``width`` ids by a window over one range, and each range is shifted by
    the rows of the ranges before it: one row per range, joined on the range's
    number. A global window only sees those per-range counts.
    """
    b = df.withColumn("__b", F.floor(F.col(order_col) / F.lit(width)))
    counts = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.select(
        "__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__b").orderBy(order_col))
    start_c = start if isinstance(start, F.Column) else F.lit(start)
    return (b.withColumn("__r", local).join(offs, "__b")
            .withColumn(out_col, (start_c + F.col("__off") + F.col("__r") - 1).cast("long"))
            .drop("__b", "__r", "__off"))


def dense_rank_desc(df: DataFrame, keys: list[str], order_col: str, out_col: str = "version") -> DataFrame:
    """DENSE_RANK() OVER (PARTITION BY keys ORDER BY order_col DESC), nulls last,
    for a TIMESTAMP_NTZ column; null keys are one key, as in the window.

    Rows are ranked within their key and minute and shifted by the distinct times of the
    key's later minutes, so a key with any share of the rows, in one day too, is spread
    over its minutes. Rows are shuffled once: the shifts, a row per key and minute
    counted on the map side first, meet them by the same partitioning. The keys go as one
    struct, whose null fields are equal in a join.
    """
    t = F.col(order_col)
    minute = F.unix_date(F.to_date(t)).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    rows = (df.withColumn("__key", F.struct(F.lit(0).alias("_"), *keys))
            .withColumn("__cell", F.coalesce(minute, F.lit(-1 << 63))))
    cell = ["__cell", "__key"]   # sorted by a number first
    later = Window.partitionBy("__key").orderBy(F.col("__cell").desc())
    # no time comes last: its minute shifts none
    shift = (rows.groupBy(*cell).agg(F.count_distinct(order_col).alias("__n"))
             .select(*cell, (F.sum("__n").over(later) - F.col("__n")).alias("__off")))
    local = F.dense_rank().over(Window.partitionBy(*cell).orderBy(t.desc()))
    return (rows.withColumn("__r", local).join(shift, cell)
            .select(*df.columns, (F.col("__off") + F.col("__r")).cast("int").alias(out_col)))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
