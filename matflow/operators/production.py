"""Production (job) operators: P7, P8, P11, J1, T3-T5, T7, A2-A5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs as X
from ..plans.skew import left_join_spread_nulls

JOB_COLUMNS = ["id", "produit", "quantite", "responsable", "date_prod", "cout", "statut",
               "stock_id", "qte_consommee"]


def production_with_material(production: DataFrame, stock: DataFrame,
                             columns: list[str] | None = None) -> DataFrame:
    """Jobs LEFT JOIN materials -> ``materiel_nom`` (null without material).

    Jobs without a material all share the null key; they are spread over many
    partitions so a sort-merge join has no hot partition (AQE may also pick a
    broadcast of the material side when it is small).
    """
    cols = columns or JOB_COLUMNS
    mats = stock.select(F.col("id").alias("_sid"), F.col("materiel").alias("materiel_nom"))
    j = left_join_spread_nulls(production.select(*cols), mats, "stock_id", "_sid")
    return j.drop("_sid")


def production_list(production: DataFrame, stock: DataFrame) -> DataFrame:
    """J1 as listed: ISO date text, newest first."""
    j = production_with_material(production, stock)
    return (j.withColumn("_d", F.col("date_prod"))
            .withColumn("date_prod", X.iso_date(F.col("date_prod")))
            .orderBy(F.desc("_d"), F.desc("id")).drop("_d"))


def production_alerts(production: DataFrame) -> DataFrame:
    """Jobs in an alert statut, newest first."""
    return (production.where(F.col("statut").isin(*C.ALERT_STATUTS))
            .select("id", "produit", "responsable", "statut", "date_prod")
            .orderBy(F.desc("date_prod"), F.desc("id")))


def production_by_id(production: DataFrame, stock: DataFrame, id_: int) -> DataFrame:
    """One job (all columns) with its material name; the filter runs before
    the join."""
    p = production.where(F.col("id") == F.lit(id_).cast("long"))
    return production_with_material(p, stock, [*JOB_COLUMNS, "created_at", "updated_at", "updated_by"])


def status_labels(production: DataFrame) -> DataFrame:
    """Display class of each job's statut ('' for an unknown one)."""
    return production.select("id", "statut", X.status_class(F.col("statut")).alias("classe"))


def recent_production(production: DataFrame, stock: DataFrame, n: int = 5) -> DataFrame:
    """The n newest jobs with material name.

    Top-k first (TakeOrderedAndProject on the jobs), then the join on n rows;
    safe because the join is on the unique material id.
    """
    top = production.orderBy(F.desc("date_prod"), F.desc("id")).limit(n)
    cols = ["id", "produit", "quantite", "responsable", "date_prod", "cout", "statut", "stock_id"]
    return production_with_material(top, stock, cols).drop("stock_id")


def latest_created(production: DataFrame, n: int = 10) -> DataFrame:
    """T4: the n most recently created jobs."""
    return (production.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
            .select("id", "produit", "quantite", "responsable", "date_prod", "cout", "statut"))


def top_production_qty(production: DataFrame, n: int = 5) -> DataFrame:
    """T5: the n jobs with the largest quantity."""
    return (production.orderBy(F.desc("quantite"), "id").limit(n)
            .select("id", "produit", "quantite", "responsable", "statut"))


def production_report(production: DataFrame, stock: DataFrame) -> DataFrame:
    """Every job with material, newest first, French date and money."""
    cols = ["id", "produit", "quantite", "responsable", "date_prod", "cout", "statut",
            "qte_consommee", "stock_id"]
    j = production_with_material(production, stock, cols)
    return (j.select("id", "produit", "quantite", "responsable", "date_prod", "cout", "statut",
                     "qte_consommee", F.col("materiel_nom").alias("materiau"),
                     X.format_date_fr(F.col("date_prod")).alias("date_fr"),
                     X.format_mad(F.col("cout")).alias("cout_fr"))
            .orderBy(F.desc("date_prod"), F.desc("id")))


def production_by_status(production: DataFrame) -> DataFrame:
    """A2: jobs per statut."""
    return production.groupBy("statut").agg(F.count(F.lit(1)).alias("nombre"))


def status_share(production: DataFrame) -> DataFrame:
    """A3: jobs per statut and rounded percent of all jobs (0 when no job).

    The total is summed over the per-statut rows themselves (one row per
    statut, so the unpartitioned window is bounded by the statut vocabulary).
    """
    per = production_by_status(production)
    total = F.sum("nombre").over(Window.partitionBy())
    pct = F.when(total > 0, F.floor(F.col("nombre") * 100.0 / total + 0.5)).otherwise(F.lit(0))
    return per.select("statut", "nombre", pct.cast("long").alias("pct"))


def production_by_month(production: DataFrame) -> DataFrame:
    """A4: jobs per (year, month), newest first."""
    return (production.groupBy(F.year("date_prod").alias("annee"), F.month("date_prod").alias("mois"))
            .agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("annee"), F.desc("mois")))


def production_total(production: DataFrame) -> DataFrame:
    """A5: number of jobs."""
    return production.agg(F.count(F.lit(1)).alias("total"))
