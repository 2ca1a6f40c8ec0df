"""Search and alert feed: G1, G2, A11."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

SOURCES = ["stock", "production"]


def alert_feed(stock: DataFrame, production: DataFrame) -> DataFrame:
    """G1: stock alerts then job alerts in one list with a ``source`` tag.

    ``pos`` keeps the display order: stock alerts by quantity, then job alerts
    newest first.
    """
    s = (stock.where(F.col("quantite") < C.CRITICAL_STOCK)
         .select(F.lit("stock").alias("source"), "id", F.col("materiel").alias("libelle"),
                 F.col("quantite").cast("string").alias("detail"),
                 F.lit(0).alias("_g"), F.col("quantite").alias("_q"),
                 F.lit(None).cast("date").alias("_d")))
    p = (production.where(F.col("statut").isin(*C.ALERT_STATUTS))
         .select(F.lit("production").alias("source"), "id", F.col("produit").alias("libelle"),
                 F.col("statut").alias("detail"),
                 F.lit(1).alias("_g"), F.lit(None).cast("int").alias("_q"),
                 F.col("date_prod").alias("_d")))
    return (s.unionByName(p)
            .orderBy("_g", "_q", F.desc("_d"), F.when(F.col("_g") == 0, F.col("id")),
                     F.desc("id"))
            .drop("_g", "_q", "_d"))


def global_search(stock: DataFrame, production: DataFrame, word: str) -> DataFrame:
    """Literal, case-insensitive word search over materials (name) and jobs
    (product, owner, material name). An empty word gives no rows."""
    q = word.strip().lower()
    if not q:
        return (stock.where(F.lit(False)).select(F.lit("stock").alias("source"), "id",
                                                 F.col("materiel").alias("libelle")))
    s = (stock.where(F.lower("materiel").contains(q))
         .select(F.lit("stock").alias("source"), "id", F.col("materiel").alias("libelle")))
    # jobs that match by themselves need no join; of the others only those of a
    # matching material, whose filtered ids are the short side
    own = F.lower("produit").contains(q) | F.lower("responsable").contains(q)
    own = F.coalesce(own, F.lit(False))
    by_material = (production.where(~own & F.col("stock_id").isNotNull())
                   .join(s.select(F.col("id").alias("stock_id")), "stock_id", "left_semi"))
    columns = [F.lit("production").alias("source"), "id", F.col("produit").alias("libelle")]
    return s.unionByName(production.where(own).select(*columns)).unionByName(by_material.select(*columns))


def global_search_counts(stock: DataFrame, production: DataFrame, word: str) -> DataFrame:
    """Hits per source, 0 for a source without hits.

    Both counts come from one conditional aggregate (no join), unpivoted to the
    two source rows.
    """
    hits = global_search(stock, production, word)
    a = hits.agg(F.count_if(F.col("source") == "stock").alias("stock"),
                 F.count_if(F.col("source") == "production").alias("production"))
    return a.select(F.expr("stack(2, 'stock', stock, 'production', production)")
                    .alias("source", "hits"))
