"""Connected components of an edge table, by rounds of joins.

Each round does a large-star and a small-star step (every node sends its larger,
then its smaller neighbours to the least neighbour it knows); the edge table ends
as one star per component. Rounds grow with the logarithm of the component size;
each round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges, a <> b -> (a, b): b is the least node of a's component,
    for every node a but that least node itself."""
    now = shared_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "edges")
    before = _state(now)
    while before[0]:
        # large-star leaves edges (larger, smaller), as small-star wants them
        now = shared_table(_small_star(_large_star(now)), "edges")
        state = _state(now)
        if state == before:
            break
        before = state
    return now
