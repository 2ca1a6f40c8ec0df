"""Stock ledger: greedy deduction of requested amounts (M7) and the stock it
leaves (M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fold import greedy_deduction
from ..plans.skew import left_join_spread_nulls

REASON_UNKNOWN = "materiau_inconnu"
REASON_SHORT = "stock_insuffisant"


def consume_stock(requests: DataFrame, stock: DataFrame,
                  order: tuple[str, ...] = ("date_prod", "req_id"), levels: bool = False) -> DataFrame:
    """M7: per material, in arrival order, accept a request when what remains
    covers it and deduct it; otherwise reject it and leave the stock as is.

    ``requests``: req_id, stock_id (null = no material), qte, and the
    ``order`` columns. A request for an unknown material is rejected. A
    request without material, or with an amount <= 0, is accepted without
    deduction.

    With ``levels`` also ``disponible`` and ``restant``, the stock before and after
    each request that was folded (null for the others).

    Requests that need stock take ``greedy_deduction``, one plan for materials of
    any size; requests without material are kept out of the one hot null key.
    """
    order = list(order)
    r = requests.select("req_id", "stock_id", F.col("qte").cast("long").alias("qte"), *[
        c for c in order if c != "req_id"])
    opening = stock.select(F.col("id").alias("_sid"), F.col("quantite").cast("long").alias("opening"))
    j = left_join_spread_nulls(r, opening, "stock_id", "_sid")
    known = F.col("_sid").isNotNull()
    needs = known & (F.col("qte") > 0)

    free = j.where(~needs).select(
        "req_id", "stock_id", "qte",
        (known | F.col("stock_id").isNull()).alias("accepted"),
        F.when(F.col("stock_id").isNotNull() & ~known, F.lit(REASON_UNKNOWN)).alias("motif"))

    want = j.where(needs)
    folded = greedy_deduction(want, order)
    hard_out = folded.select("req_id", "stock_id", "qte", "accepted",
                             F.when(~F.col("accepted"), F.lit(REASON_SHORT)).alias("motif"))
    if levels:
        hard_out = folded.select(*[F.col(c) for c in ("req_id", "stock_id", "qte", "accepted")],
                                 F.when(~F.col("accepted"), F.lit(REASON_SHORT)).alias("motif"),
                                 "disponible", "restant")
        free = free.withColumns({c: F.lit(None).cast("long") for c in ("disponible", "restant")})
    return free.unionByName(hard_out)


def stock_after_consumption(stock: DataFrame, decisions: DataFrame) -> DataFrame:
    """M8: opening stock minus the accepted amounts (pre-aggregated per
    material before the join)."""
    used = (decisions.where(F.col("accepted") & F.col("stock_id").isNotNull() & (F.col("qte") > 0))
            .groupBy("stock_id").agg(F.sum("qte").alias("_used")))
    j = stock.join(used, stock.id == used.stock_id, "left")
    return j.select("id", "materiel", F.col("quantite").alias("quantite_initiale"),
                    F.coalesce(F.col("_used"), F.lit(0)).cast("long").alias("consomme"),
                    (F.col("quantite") - F.coalesce(F.col("_used"), F.lit(0))).cast("long")
                    .alias("quantite"))
