"""Exact deduplication with a heavy-hitter split.

1. Every row becomes (doc_id, digest, code points, row id): one scan of the
   texts, written to the shared folder; everything after reads about 60 bytes a
   row.
2. ``approx_top_k`` (a frequent-items sketch of the Misra-Gries family: a fixed
   number of counters, decremented when full, merged in two levels: the tasks'
   sketches into at most ``MERGES``, and those into one) names at
   most ``candidates`` frequent digests. Any digest with more than about
   rows / ``counters`` rows is among them.
3. The candidates are verified by an exact aggregate (count, winner); at most
   ``candidates`` verified winners are broadcast, so rows of frequent digests
   are resolved on the map side and never shuffled.
4. The other digests are aggregated with map-side combining, and their rows
   joined to the winners by an ordinary shuffle.

A digest that the sketch misses only takes the ordinary way, so the result does
not depend on the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

#: Broadcast bound: digests that may take the map-side way.
CANDIDATES = 1000
#: Counters of the frequent-items sketch.
COUNTERS = 16384
#: Sketches that the first level of the merge leaves to the second.
MERGES = 512

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text):
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def frequent_digests(rows: DataFrame, candidates: int = CANDIDATES, counters: int = COUNTERS,
                     merges: int = MERGES) -> DataFrame:
    """(digest): at most ``candidates`` digests that the merged sketches name as frequent."""
    return (rows.groupBy((F.spark_partition_id() % merges).alias("part"))
            .agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("sketch"))
            # grouped by a constant: no rows give no sketch
            .groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
            .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {candidates})")).alias("top"))
            .select(F.col("top.item").alias("digest")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the one with the most code points stays,
    then the smallest id; null ids come last, and of rows equal in both (repeated
    rows) exactly one stays. Null text counts as empty. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = shared_table(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        F.monotonically_increasing_id().alias("rid")), "exact")

    frequent = frequent_digests(rows, candidates, counters)
    # least struct = most code points, then id present, smallest id, row id
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                     F.col("doc_id"), F.col("rid"))

    def winners(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))

    heavy = shared_table(
        winners(rows.join(F.broadcast(frequent), "digest", "left_semi"))
        .where("group_size > 1"), "exact-heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    both = (split.where(F.col("best").isNotNull())
            .unionByName(light.join(winners(light), "digest")))
    return both.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
