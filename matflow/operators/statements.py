"""Audit rows statement by statement (U1, U2) and the answers to job changes (M5, M6).

The triggers fire once a statement, so three updates of one row leave three audit
rows, each from the values that the one before it left. A statement replaces all audited
columns, so the values before it are those of the statement before it on the same id, or
the stored row's; what comes after a row's first DELETE, or names no row, changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs as X
from ..functions.exprs import ts_lit
from . import changes, validate
from .audit import ENTRY_COLUMNS

#: Order numbers of one window of ``lag_spread``.
SPREAD = 100_000
# not a text of the source
MSG_MISSING = "introuvable"


def lag_spread(df: DataFrame, key: str, order: str, value: str, name: str, per: int = SPREAD) -> DataFrame:
    """``df`` with the ``value`` of the row before (by ``order``, unique within ``key``).

    Rows of a key are windowed by ranges of ``per`` order numbers; the first row of a range
    takes the last value of the key's range before it, so a key with any share of the rows
    is spread, and its own window has one row a range."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(per)))
    within = Window.partitionBy(key, "_range").orderBy(order)
    last = ranged.groupBy(key, "_range").agg(F.max_by(value, order).alias("_last"))
    entry = last.select(key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_entry"))
    inside = (ranged.withColumn("_inside", F.lag(value).over(within))
              .withColumn("_nth", F.row_number().over(within)))
    return (inside.join(entry, [key, "_range"])
            .withColumn(name, F.when(F.col("_nth") == 1, F.col("_entry")).otherwise(F.col("_inside")))
            .drop("_range", "_inside", "_nth", "_entry"))


def _statement_rows(before: DataFrame, requests: DataFrame, table: str, cols: list[str],
                    values: dict[str, F.Column], at: dt.datetime, per: int) -> DataFrame:
    kinds = {f.name: f.dataType for f in before.schema.fields}
    new = F.struct(*[values[c].cast(kinds[c]).alias(c) for c in cols])
    is_update = F.col("op") == "UPDATE"
    asked = (requests.where(F.col("op").isin("UPDATE", "DELETE"))
             .select("seq", "op", "target_id", F.when(is_update, new).alias("_new")))
    gone = asked.where(~is_update).groupBy("target_id").agg(F.min("seq").alias("_gone"))
    stored = before.select(F.col("id").alias("target_id"), F.struct(*cols).alias("_stored"), "updated_by")
    live = (asked.join(gone, "target_id", "left").where(F.col("_gone").isNull() | (F.col("seq") <= F.col("_gone")))
            .join(stored, "target_id"))
    chained = lag_spread(live, "target_id", "seq", "_new", "_before", per)
    null = F.lit(None).cast("string")
    out = {
        "utilisateur": F.when(is_update, F.coalesce("updated_by", F.lit(C.SYSTEM_USER))).otherwise(F.lit(C.SYSTEM_USER)),
        "role_utilisateur": null,
        "action": F.when(is_update, F.lit(C.ACTION_UPDATE)).otherwise(F.lit(C.ACTION_DELETE)),
        "table_name": F.lit(table), "record_id": F.col("target_id"),
        "ancienne_valeur": F.to_json(F.coalesce("_before", "_stored")), "nouvelle_valeur": F.to_json("_new"),
        "details": null, "ip_address": null, "user_agent": null, "timestamp": ts_lit(at)}
    return chained.select(*[out[c].alias(c) for c in ENTRY_COLUMNS], "seq")


def stock_statements(stock: DataFrame, requests: DataFrame, today: dt.date, at: dt.datetime,
                     per: int = SPREAD) -> DataFrame:
    """One audit row per UPDATE or DELETE that met a row, with the request's ``seq``
    (unique; requests as ``fixtures.stock_change_requests``)."""
    values = {"materiel": X.js_trim(F.col("materiel")), "quantite": F.col("quantite"),
              "date_ajout": F.coalesce("date_ajout", F.lit(today))}
    return _statement_rows(stock, requests, C.TABLE_STOCK, C.STOCK_AUDIT_COLUMNS, values, at, per)


def production_statements(production: DataFrame, requests: DataFrame, today: dt.date, at: dt.datetime,
                          per: int = SPREAD) -> DataFrame:
    """The same for jobs; an update with a blank product is refused before it
    becomes a statement."""
    sound = requests.where((F.col("op") == "DELETE") | X.clean_text(F.col("produit")).isNotNull())
    return _statement_rows(production, sound, C.TABLE_PRODUCTION, C.PRODUCTION_AUDIT_COLUMNS,
                           changes.job_values(F.col, today), at, per)


def created_stock(new: DataFrame, at: dt.datetime) -> DataFrame:
    """Audit rows of the stock trigger for appended materials: one CREATE each."""
    null = F.lit(None).cast("string")
    out = {c: null for c in ENTRY_COLUMNS}
    out |= {"utilisateur": F.coalesce("updated_by", F.lit(C.SYSTEM_USER)), "action": F.lit(C.ACTION_CREATE),
            "table_name": F.lit(C.TABLE_STOCK), "record_id": F.col("id"),
            "nouvelle_valeur": F.to_json(F.struct(*C.STOCK_AUDIT_COLUMNS)), "timestamp": ts_lit(at)}
    return new.select(*[out[c].alias(c) for c in ENTRY_COLUMNS])


def job_change_decisions(production: DataFrame, requests: DataFrame) -> DataFrame:
    """seq, code and reason of each job change: 404 where the job does not exist (or was
    deleted by an earlier request), 400 for an update with a blank product, else 200."""
    gone = (requests.where(F.col("op") == "DELETE").groupBy("target_id").agg(F.min("seq").alias("_gone")))
    there = production.select(F.col("id").alias("target_id"), F.lit(True).alias("_there"))
    r = requests.join(there, "target_id", "left").join(gone, "target_id", "left")
    missing = F.col("_there").isNull() | F.coalesce(F.col("seq") > F.col("_gone"), F.lit(False))
    blank = (F.col("op") == "UPDATE") & X.clean_text(F.col("produit")).isNull()
    return r.select("seq", F.when(missing, 404).when(blank, 400).otherwise(200).alias("code"),
                    F.when(missing, F.lit(MSG_MISSING)).when(blank, F.lit(validate.MSG_PRODUIT_REQUIRED))
                    .alias("reject_reason"))
