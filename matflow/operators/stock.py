"""Material (stock) operators: P1-P6, P9, P10, T1, T2, T6, J3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs as X


def stock_state(stock: DataFrame) -> DataFrame:
    """Id, materiel, quantite, date_ajout plus ``etat`` and ``alerte``."""
    q = F.col("quantite")
    return stock.select("id", "materiel", "quantite", "date_ajout",
                        X.stock_etat(q).alias("etat"), X.stock_alerte(q).alias("alerte"))


def stock_list(stock: DataFrame, search: str | None = None) -> DataFrame:
    """P2 (and P3 with ``search``): state rows, ISO date text, newest first."""
    s = stock if search is None else stock_search(stock, search)
    # ordered as stored; texts are made once, after the sort's sampling and shuffle
    st = stock_state(s.orderBy(F.desc("date_ajout"), "id"))
    return st.withColumn("date_ajout", X.iso_date(F.col("date_ajout")))


def like_pattern(search: str) -> str:
    """``%search%``; ``%`` and ``_`` typed by the user stay wildcards (as in LIKE)."""
    return f"%{search}%"


def stock_search(stock: DataFrame, search: str) -> DataFrame:
    """``materiel LIKE %search%`` with a case-insensitive collation."""
    return stock.where(F.col("materiel").ilike(like_pattern(search)))


def stock_contains(stock: DataFrame, q: str) -> DataFrame:
    """Literal, case-insensitive substring filter (client-side filter)."""
    return stock.where(F.lower(F.col("materiel")).contains(q.lower()))


def stock_alerts(stock: DataFrame) -> DataFrame:
    """P5: materials under the critical level, lowest first (state is CRITIQUE)."""
    return (stock.where(F.col("quantite") < C.CRITICAL_STOCK)
            .select("id", "materiel", "quantite", F.lit(C.STATE_CRITICAL).alias("etat"))
            .orderBy("quantite", "id"))


def stock_by_id(stock: DataFrame, id_: int) -> DataFrame:
    """Point lookup; the predicate reaches the parquet scan."""
    return stock.where(F.col("id") == F.lit(id_).cast("long"))


def stock_fill_pct(stock: DataFrame) -> DataFrame:
    """Fill gauge percent and level."""
    q = F.col("quantite")
    return stock.select("id", "materiel", "quantite", X.fill_pct(q).alias("pct"),
                        X.fill_level(q).alias("level"), X.stock_etat(q).alias("etat"))


def stock_band_colour(stock: DataFrame) -> DataFrame:
    """P10: colour band of every material."""
    return stock.select("id", "materiel", "quantite", X.band_colour(F.col("quantite")).alias("couleur"))


def top_stock(stock: DataFrame, n: int = 10) -> DataFrame:
    """The n largest quantities with their colour (TakeOrderedAndProject)."""
    return (stock.orderBy(F.desc("quantite"), "id").limit(n)
            .select("id", "materiel", "quantite", X.band_colour(F.col("quantite")).alias("couleur")))


def lowest_stock(stock: DataFrame, n: int = 10) -> DataFrame:
    """The n smallest quantities with their state."""
    return (stock.orderBy("quantite", "id").limit(n)
            .select("id", "materiel", "quantite", X.stock_etat(F.col("quantite")).alias("etat")))


def stock_report(stock: DataFrame) -> DataFrame:
    """Every material with state, lowest quantity first, French date."""
    return (stock.select("id", "materiel", "quantite", "date_ajout",
                         X.format_date_fr(F.col("date_ajout")).alias("date_fr"),
                         X.stock_etat(F.col("quantite")).alias("etat"))
            .orderBy("quantite", "id"))


def stock_usage(stock: DataFrame, production: DataFrame) -> DataFrame:
    """Number of jobs that use each material (0 when none).

    Jobs are counted per stock_id first (partial aggregation on the map side,
    so a hot material is pre-reduced), then joined to the materials.
    """
    used = (production.where(F.col("stock_id").isNotNull())
            .groupBy("stock_id").agg(F.count(F.lit(1)).alias("cnt")))
    return (stock.select("id", "materiel")
            .join(used, F.col("id") == used.stock_id, "left")
            .select("id", "materiel", F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("cnt")))
