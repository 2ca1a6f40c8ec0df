"""Audit trail: J2, W1, W2, U1-U5, K3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import ts_lit
from ..plans.skew import dense_rank_desc

HISTORY_COLUMNS = ["id", "utilisateur", "role_utilisateur", "action", "ancienne_valeur",
                   "nouvelle_valeur", "details", "timestamp"]
ENTRY_COLUMNS = ["utilisateur", "role_utilisateur", "action", "table_name", "record_id",
                 "ancienne_valeur", "nouvelle_valeur", "details", "ip_address", "user_agent",
                 "timestamp"]


def audit_with_role(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Fill ``role_utilisateur`` from the user of the same name.

    ``username`` is unique, so the left join keeps one row per audit row. A
    user with a large share of the rows is a skewed key on the audit side;
    AQE splits such partitions (or broadcasts a small users table).
    """
    u = users.select(F.col("username").alias("_u"), F.col("role").alias("_role"))
    j = audit.join(u, audit.utilisateur == u._u, "left")
    return j.select("id", "utilisateur",
                    F.coalesce(F.col("role_utilisateur"), F.col("_role")).alias("role_utilisateur"),
                    "action", "table_name", "record_id", "timestamp")


def audit_history(audit: DataFrame, table_name: str, record_id: int) -> DataFrame:
    """History of one record, version 1 = newest (DENSE_RANK by time)."""
    a = audit.where((F.col("table_name") == table_name)
                    & (F.col("record_id") == F.lit(record_id).cast("long")))
    return dense_rank_desc(a.select(*HISTORY_COLUMNS), [], "timestamp", "version") \
        .select(*HISTORY_COLUMNS, "version")


def audit_versions(audit: DataFrame) -> DataFrame:
    """W1 for every record at once; a record with a large share of the
    rows is spread over its minutes (see ``dense_rank_desc``)."""
    cols = ["table_name", "record_id", *HISTORY_COLUMNS]
    return dense_rank_desc(audit.select(*cols), ["table_name", "record_id"], "timestamp",
                           "version").select(*cols, "version")


def _capture(before: DataFrame, after: DataFrame, table: str, cols: list[str],
             at: dt.datetime, touched: DataFrame | None = None) -> DataFrame:
    """Snapshot diff -> trigger rows: CREATE (only after), DELETE (only
    before), UPDATE (both, some column differs null-safely, or the id is in
    ``touched``: the trigger logs an update that changes nothing, too)."""
    other = [c for c in before.columns if c != "id"]
    b = before.select("id", *[F.col(c).alias(f"b_{c}") for c in other], F.lit(True).alias("_b"))
    a = after.select(F.col("id").alias("_aid"), *[F.col(c).alias(f"a_{c}") for c in other],
                     F.lit(True).alias("_a"))
    j = b.join(a, b.id == a._aid, "full_outer")
    if touched is not None:
        hit = touched.select(F.col("id").alias("_tid")).distinct().withColumn("_hit", F.lit(True))
        j = j.join(hit, j._aid == hit._tid, "left")
    in_b, in_a = F.col("_b").isNotNull(), F.col("_a").isNotNull()
    changed = None
    for c in other:
        d = ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
        changed = d if changed is None else (changed | d)
    action = (F.when(in_a & ~in_b, F.lit(C.ACTION_CREATE))
              .when(in_b & ~in_a, F.lit(C.ACTION_DELETE))
              .when(changed if touched is None else changed | F.col("_hit").isNotNull(),
                    F.lit(C.ACTION_UPDATE)))
    # FOR JSON keys are the column names, not the prefixed ones
    old_json = F.to_json(F.struct(*[F.col(f"b_{c}").alias(c) for c in cols]))
    new_json = F.to_json(F.struct(*[F.col(f"a_{c}").alias(c) for c in cols]))
    author = F.when(F.col("_act") == C.ACTION_DELETE, F.lit(C.SYSTEM_USER)) \
        .otherwise(F.coalesce(F.col("a_updated_by"), F.lit(C.SYSTEM_USER)))
    return (j.withColumn("_act", action).where(F.col("_act").isNotNull())
            .select(author.alias("utilisateur"),
                    F.lit(None).cast("string").alias("role_utilisateur"),
                    F.col("_act").alias("action"),
                    F.lit(table).alias("table_name"),
                    F.coalesce(F.col("id"), F.col("_aid")).alias("record_id"),
                    F.when(in_b, old_json).alias("ancienne_valeur"),
                    F.when(in_a, new_json).alias("nouvelle_valeur"),
                    F.lit(None).cast("string").alias("details"),
                    F.lit(None).cast("string").alias("ip_address"),
                    F.lit(None).cast("string").alias("user_agent"),
                    ts_lit(at).alias("timestamp")))


def capture_stock_changes(before: DataFrame, after: DataFrame, at: dt.datetime,
                          touched: DataFrame | None = None) -> DataFrame:
    """Audit rows of the stock trigger for one snapshot change."""
    return _capture(before, after, C.TABLE_STOCK, C.STOCK_AUDIT_COLUMNS, at, touched)


def capture_production_changes(before: DataFrame, after: DataFrame, at: dt.datetime,
                               touched: DataFrame | None = None) -> DataFrame:
    """Audit rows of the production trigger for one snapshot change."""
    return _capture(before, after, C.TABLE_PRODUCTION, C.PRODUCTION_AUDIT_COLUMNS, at, touched)


def deduction_rows(decisions: DataFrame, stock: DataFrame, at: dt.datetime) -> DataFrame:
    """Audit rows of the stock trigger for a batch of deductions: one UPDATE per
    accepted request that took stock, from the amount before it to the amount after
    it, with the request's id. ``decisions``: M7 with ``levels``."""
    took = decisions.where(F.col("accepted") & F.col("disponible").isNotNull())
    s = stock.select(F.col("id").alias("_sid"), "materiel", "date_ajout", "updated_by")
    j = took.join(s, took.stock_id == s._sid)

    def value(level: str):
        return F.to_json(F.struct("materiel", F.col(level).cast("int").alias("quantite"), "date_ajout"))
    null = F.lit(None).cast("string")
    return j.select(
        F.coalesce("updated_by", F.lit(C.SYSTEM_USER)).alias("utilisateur"), null.alias("role_utilisateur"),
        F.lit(C.ACTION_UPDATE).alias("action"), F.lit(C.TABLE_STOCK).alias("table_name"),
        F.col("stock_id").alias("record_id"), value("disponible").alias("ancienne_valeur"),
        value("restant").alias("nouvelle_valeur"), null.alias("details"), null.alias("ip_address"),
        null.alias("user_agent"), ts_lit(at).alias("timestamp"), "req_id")


def creation_rows(new: DataFrame, at: dt.datetime) -> DataFrame:
    """Audit rows of the production trigger for appended jobs: one CREATE each."""
    null = F.lit(None).cast("string")
    return new.select(
        F.coalesce("updated_by", F.lit(C.SYSTEM_USER)).alias("utilisateur"), null.alias("role_utilisateur"),
        F.lit(C.ACTION_CREATE).alias("action"), F.lit(C.TABLE_PRODUCTION).alias("table_name"),
        F.col("id").alias("record_id"), null.alias("ancienne_valeur"),
        F.to_json(F.struct(*C.PRODUCTION_AUDIT_COLUMNS)).alias("nouvelle_valeur"), null.alias("details"),
        null.alias("ip_address"), null.alias("user_agent"), ts_lit(at).alias("timestamp"))


def audit_entries(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows for user actions, with the user's role looked up.

    ``actions`` carries utilisateur, action, table_name, record_id and
    optionally ancienne_valeur, nouvelle_valeur, details, ip_address,
    user_agent, timestamp.
    """
    a = actions
    for c in ENTRY_COLUMNS:
        if c not in a.columns and c != "role_utilisateur":
            a = a.withColumn(c, F.lit(None).cast("timestamp_ntz" if c == "timestamp" else "string"))
    u = users.select(F.col("username").alias("_u"), F.col("role").alias("role_utilisateur"))
    return a.join(u, a.utilisateur == u._u, "left").select(*ENTRY_COLUMNS)


def retention_cutoff(as_of: dt.datetime, days: int = C.AUDIT_RETENTION_DAYS) -> dt.datetime:
    return as_of - dt.timedelta(days=days)


def _keep_predicate(audit: DataFrame, cutoff: dt.datetime) -> F.Column:
    keep = F.col("timestamp") >= ts_lit(cutoff)
    if "audit_date" in audit.columns:
        # partition column: whole days before the cutoff are never read
        keep = (F.col("audit_date") >= F.lit(cutoff.date())) & keep
    return keep


def audit_retention(audit: DataFrame, as_of: dt.datetime,
                    days: int = C.AUDIT_RETENTION_DAYS) -> DataFrame:
    """U4: the audit rows kept by the clean-up (``timestamp >= as_of - days``)."""
    return audit.where(_keep_predicate(audit, retention_cutoff(as_of, days)))


def audit_retention_count(audit: DataFrame, as_of: dt.datetime,
                          days: int = C.AUDIT_RETENTION_DAYS) -> DataFrame:
    """How many rows the clean-up removes."""
    cutoff = retention_cutoff(as_of, days)
    old = F.col("timestamp") < ts_lit(cutoff)
    a = audit
    if "audit_date" in audit.columns:
        a = a.where(F.col("audit_date") <= F.lit(cutoff.date()))
    return a.agg(F.count_if(old).alias("supprimes"))


def audit_append(entries: DataFrame, path: str) -> None:
    """K3: append audit rows to a date-partitioned parquet table."""
    (entries.withColumn("audit_date", F.to_date("timestamp"))
     .write.mode("append").partitionBy("audit_date").parquet(path))
