"""Change application on snapshots: J4-J6, M1-M6, M9.

Parquet tables take no UPDATE, so each operator takes a snapshot and a batch
of requests and returns the next snapshot (the store writes it as a new
version). All are joins and aggregates; nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import exprs as X
from ..plans.skew import dense_sequence, left_join_spread_nulls
from .stock import stock_usage


def requests_existing(requests: DataFrame, table: DataFrame, key: str = "target_id") -> DataFrame:
    """Requests whose target id exists (left semi join)."""
    return requests.join(table.select(F.col("id").alias(key)), key, "left_semi")


def requests_missing(requests: DataFrame, table: DataFrame, key: str = "target_id") -> DataFrame:
    """Requests whose target id does not exist (the 404 branch)."""
    return requests.join(table.select(F.col("id").alias(key)), key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Old and new row by id; the missing side tells CREATE or DELETE."""
    b = before.select("id", *[F.col(c).alias(f"{c}_avant") for c in cols], F.lit(1).alias("_b"))
    a = after.select(F.col("id").alias("_aid"), *[F.col(c).alias(f"{c}_apres") for c in cols],
                     F.lit(1).alias("_a"))
    j = b.join(a, b.id == a._aid, "full_outer")
    same = None
    for c in cols:
        e = F.col(f"{c}_avant").eqNullSafe(F.col(f"{c}_apres"))
        same = e if same is None else (same & e)
    change = (F.when(F.col("_b").isNull(), F.lit("CREATE")).when(F.col("_a").isNull(), F.lit("DELETE"))
              .when(same, F.lit("SAME")).otherwise(F.lit("UPDATE")))
    return j.select(F.coalesce(F.col("id"), F.col("_aid")).alias("id"), change.alias("change"),
                    *[f"{c}_avant" for c in cols], *[f"{c}_apres" for c in cols])


def _latest_per_target(requests: DataFrame, cols: list[str]) -> DataFrame:
    """Last request (highest ``seq``) per target id; ``max_by`` aggregates
    partially, so a hot target is pre-reduced before the shuffle."""
    return (requests.groupBy("target_id")
            .agg(F.max_by(F.struct(*cols), F.col("seq")).alias("r"))
            .select("target_id", *[F.col(f"r.{c}").alias(f"_n_{c}") for c in cols]))


def next_base(table: DataFrame, mark: int = 0) -> F.Column:
    """The id before the next identity value: of the rows left, or ``mark``, the
    highest id ever given (an identity value is never given again)."""
    return table.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(mark)).cast("long")).scalar()


def insert_stock(stock: DataFrame, inserts: DataFrame, today: dt.date,
                 now: dt.datetime, mark: int = 0) -> DataFrame:
    """M1: append materials with the next identity values, in ``seq`` order.

    max(id) is a scalar subquery; the positions come from ``dense_sequence``
    (no global window).
    """
    base = next_base(stock, mark)
    new = dense_sequence(inserts.select("seq", "materiel", "quantite", "date_ajout"), "seq", "_pos")
    rows = new.select(
        (base + F.col("_pos")).alias("id"),
        X.js_trim(F.col("materiel")).alias("materiel"),
        F.col("quantite").cast("int").alias("quantite"),
        F.coalesce(F.col("date_ajout"), F.lit(today)).alias("date_ajout"),
        X.ts_lit(now).alias("created_at"),
        F.lit(None).alias("updated_at"), F.lit(None).alias("updated_by"))
    return schemas.conform(stock, schemas.STOCK).unionByName(schemas.conform(rows, schemas.STOCK))


def update_stock(stock: DataFrame, updates: DataFrame, today: dt.date) -> DataFrame:
    """M2: replace name, quantity and date by id (last request wins)."""
    latest = _latest_per_target(updates, ["materiel", "quantite", "date_ajout"])
    j = stock.join(latest, stock.id == latest.target_id, "left")
    hit = F.col("target_id").isNotNull()
    out = j.select(
        "id",
        F.when(hit, X.js_trim(F.col("_n_materiel"))).otherwise(F.col("materiel")).alias("materiel"),
        F.when(hit, F.col("_n_quantite")).otherwise(F.col("quantite")).alias("quantite"),
        F.when(hit, F.coalesce(F.col("_n_date_ajout"), F.lit(today))).otherwise(F.col("date_ajout"))
        .alias("date_ajout"),
        "created_at", "updated_at", "updated_by")
    return schemas.conform(out, schemas.STOCK)


def delete_stock(stock: DataFrame, deletes: DataFrame) -> DataFrame:
    """M3 (materials): drop the deleted ids."""
    return stock.join(deletes.select(F.col("target_id").alias("id")), "id", "left_anti")


def detach_deleted_stock(production: DataFrame, deletes: DataFrame) -> DataFrame:
    """M3 (jobs): ON DELETE SET NULL for jobs that used a deleted material.

    The deleted ids are de-duplicated first, so the left join keeps one row
    per job.
    """
    d = deletes.select(F.col("target_id").alias("_del")).distinct()
    j = left_join_spread_nulls(production, d, "stock_id", "_del")
    return schemas.conform(
        j.withColumn("stock_id", F.when(F.col("_del").isNotNull(), F.lit(None).cast("long"))
                     .otherwise(F.col("stock_id"))), schemas.PRODUCTION)


def dissociated_counts(stock: DataFrame, production: DataFrame, deletes: DataFrame) -> DataFrame:
    """M9: for each deleted (existing) material, its name and how many jobs
    it loses (the message count of the delete)."""
    d = deletes.select(F.col("target_id").alias("id")).distinct()
    return stock_usage(stock.join(d, "id", "left_semi"), production)


def new_production_rows(production: DataFrame, accepted: DataFrame, now: dt.datetime, mark: int = 0) -> DataFrame:
    """The rows M4 adds: accepted jobs (typed by V3, amounts by M7) with the
    next identity values in ``req_id`` order."""
    base = next_base(production, mark)
    new = dense_sequence(accepted, "req_id", "_pos")
    rows = new.select(
        (base + F.col("_pos")).alias("id"), "produit", "quantite", "responsable", "date_prod",
        "cout", "statut", "stock_id", "qte_consommee",
        X.ts_lit(now).alias("created_at"),
        F.lit(None).alias("updated_at"), F.lit(None).alias("updated_by"))
    return schemas.conform(rows, schemas.PRODUCTION)


def insert_production(production: DataFrame, accepted: DataFrame, now: dt.datetime) -> DataFrame:
    """M4: the job table with the accepted jobs appended.

    ``accepted`` has req_id, produit, quantite, responsable, date_prod, cout,
    statut, stock_id, qte_consommee; ids follow ``req_id`` order.
    """
    return (schemas.conform(production, schemas.PRODUCTION)
            .unionByName(new_production_rows(production, accepted, now)))


PRODUCTION_UPDATE_COLUMNS = ["produit", "quantite", "responsable", "date_prod", "cout", "statut",
                             "stock_id", "qte_consommee"]


def job_values(of, today: dt.date) -> dict[str, F.Column]:
    """The 8 job columns that an update writes; ``of``: a column of the request by name."""
    return {
        "produit": X.js_trim(of("produit")),
        "quantite": F.coalesce(F.nullif(of("quantite"), F.lit(0)), F.lit(1)),
        "responsable": F.coalesce(X.js_trim(of("responsable")), F.lit("")),
        "date_prod": F.coalesce(of("date_prod"), F.lit(today)),
        "cout": F.coalesce(of("cout"), F.lit(0).cast("decimal(12,2)")),
        "statut": F.coalesce(F.nullif(of("statut"), F.lit("")), F.lit("En cours")),
        "stock_id": of("stock_id"),
        "qte_consommee": F.coalesce(F.nullif(of("qte_consommee"), F.lit(0)), F.lit(0)),
    }


def update_production(production: DataFrame, updates: DataFrame, today: dt.date) -> DataFrame:
    """M5: replace the 8 job columns by id with the defaults of the update
    route; the stock is not deducted again. A request with a blank product is
    refused, so it takes no part."""
    sound = updates.where(X.clean_text(F.col("produit")).isNotNull())
    latest = _latest_per_target(sound, PRODUCTION_UPDATE_COLUMNS)
    j = production.join(latest, production.id == latest.target_id, "left")
    hit = F.col("target_id").isNotNull()
    new = job_values(lambda c: F.col(f"_n_{c}"), today)
    out = j.select("id", *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c)
                           for c in PRODUCTION_UPDATE_COLUMNS],
                   "created_at", "updated_at", "updated_by")
    return schemas.conform(out, schemas.PRODUCTION)


def delete_production(production: DataFrame, deletes: DataFrame) -> DataFrame:
    """M6: drop the deleted jobs; the stock is not given back."""
    return production.join(deletes.select(F.col("target_id").alias("id")), "id", "left_anti")
