"""Sinks: CSV exports (K1, K2). The audit append (K3) is in
``operators.audit`` and the dashboard bundle (K4) in ``operators.dashboard``.

Exports are written in parallel by the executors (one part file per task);
nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.production import production_with_material

BOM = "\ufeff"

# ---------------------------------------------------------------------------
# FIXED VALUES: CSV header names of the source application's exports
# ---------------------------------------------------------------------------
STOCK_CSV_HEADER = ["ID", "Matériau", "Quantité", "Date ajout", "État"]
PRODUCTION_CSV_HEADER = ["ID", "Produit", "Quantité", "Responsable", "Date", "Coût (MAD)",
                         "Statut", "Matériau"]


def stock_csv_rows(stock: DataFrame) -> DataFrame:
    """K1 projection: id, name, quantity, French date, state; by id."""
    return (stock.select(F.col("id").alias("id"), F.col("materiel"), F.col("quantite"),
                         X.format_date_fr(F.col("date_ajout")).alias("date_ajout"),
                         X.stock_etat(F.col("quantite")).alias("etat"))
            .orderBy("id"))


def production_csv_rows(production: DataFrame, stock: DataFrame) -> DataFrame:
    """K2 projection: jobs with material name ('' if none), newest first."""
    j = production_with_material(
        production, stock, ["id", "produit", "quantite", "responsable", "date_prod", "cout",
                            "statut", "stock_id"])
    # ordered as stored; texts are made once, after the sort's sampling and shuffle
    return (j.orderBy(F.desc("date_prod"), F.desc("id"))
            .select("id", "produit", "quantite", "responsable",
                    X.format_date_fr(F.col("date_prod")).alias("date"),
                    F.col("cout").cast("string").alias("cout"), "statut",
                    F.coalesce(F.col("materiel_nom"), F.lit("")).alias("materiel")))


def write_csv(rows: DataFrame, path: str, header: list[str], mode: str = "overwrite") -> None:
    """``;``-separated UTF-8 CSV with a BOM before the first header name of
    every part file; inner quotes are doubled (RFC 4180), unlike the source."""
    names = [BOM + header[0], *header[1:]]
    (rows.toDF(*names).write.mode(mode)
     .option("sep", ";").option("header", True).option("quote", '"').option("escape", '"')
     .option("encoding", "UTF-8").csv(path))


def write_stock_csv(stock: DataFrame, path: str) -> None:
    write_csv(stock_csv_rows(stock), path, STOCK_CSV_HEADER)


def write_production_csv(production: DataFrame, stock: DataFrame, path: str) -> None:
    write_csv(production_csv_rows(production, stock), path, PRODUCTION_CSV_HEADER)
