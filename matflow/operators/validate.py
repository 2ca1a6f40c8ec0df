"""Validation of change requests and stored data: V1-V4."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs as X

# ---------------------------------------------------------------------------
# FIXED VALUES: error texts of the source application's validations
# ---------------------------------------------------------------------------
MSG_MATERIEL_REQUIRED = "Le nom du matériau est requis."
MSG_QUANTITE_POSITIVE = "La quantité doit être un nombre positif."
MSG_OWN_ONLY = "Tu peux seulement créer tes propres productions"
MSG_PRODUIT_REQUIRED = "Le nom du produit est requis."
MSG_QUANTITE_MIN1 = "La quantité doit être ≥ 1."
MSG_RESPONSABLE_REQUIRED = "Le responsable est requis."
MSG_STATUT_INVALID = "Statut invalide."
MSG_ROLE_DENIED = "Accès refusé"
# not a text of the source, which fails at the INSERT here
MSG_OUT_OF_RANGE = "Valeur hors limites."

PRODUCTION_CREATE_ROLES = ["admin", "responsable", "chef_equipe"]


def validate_stock_requests(requests: DataFrame) -> DataFrame:
    """V1: every failed rule is reported (express-validator style).

    ``materiel`` must not be blank; ``quantite`` must be an integer text
    (``isInt``: sign, no leading zeros) with value >= 0 that fits the column.
    """
    q = F.col("quantite")
    int_text = F.coalesce(q.rlike("^[-+]?(0|[1-9][0-9]*)$"), F.lit(False))
    bad_q = ~int_text | q.try_cast("int").isNull() | (q.try_cast("int") < 0)
    errs = F.filter(F.array(
        F.when(X.clean_text(F.col("materiel")).isNull(), F.lit(MSG_MATERIEL_REQUIRED)),
        F.when(bad_q, F.lit(MSG_QUANTITE_POSITIVE))), lambda e: e.isNotNull())
    return requests.select(
        "req_id", (F.size(errs) == 0).alias("accepted"), F.size(errs).alias("n_errors"),
        F.array_join(errs, " | ").alias("errors"))


def validate_production_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """V2: the first failing rule wins: role, owner, product, quantity >= 1,
    owner present, statut valid, numbers within their columns' ranges. A
    non-numeric quantity is rejected (the source lets ``NaN < 1`` pass; this
    engine does not)."""
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias("_uname"),
                     F.col("role").alias("_role"))
    r = requests.join(u, requests.req_user_id == u._uid, "left")
    qn = X.parse_int_or_null(F.col("quantite"))
    blank_q = F.coalesce(F.col("quantite") == "", F.lit(True))
    reason = (F.when(~F.coalesce(F.col("_role").isin(*PRODUCTION_CREATE_ROLES), F.lit(False)),
                     F.lit(MSG_ROLE_DENIED))
              .when((F.col("_role") == "responsable") & ~F.col("responsable").eqNullSafe(F.col("_uname")),
                    F.lit(MSG_OWN_ONLY))
              .when(X.clean_text(F.col("produit")).isNull(), F.lit(MSG_PRODUIT_REQUIRED))
              .when(blank_q | (qn.isNull() & ~X.int_overflow(F.col("quantite"))) | (qn < 1),
                    F.lit(MSG_QUANTITE_MIN1))
              .when(X.clean_text(F.col("responsable")).isNull(), F.lit(MSG_RESPONSABLE_REQUIRED))
              .when(F.col("statut").isNotNull() & (F.col("statut") != "")
                    & ~F.col("statut").isin(*C.STATUTS), F.lit(MSG_STATUT_INVALID))
              .when(X.int_overflow(F.col("quantite")) | X.int_overflow(F.col("stock_id"))
                    | X.int_overflow(F.col("qte_consommee")) | X.lenient_decimal(F.col("cout")).isNull(),
                    F.lit(MSG_OUT_OF_RANGE)))
    code = (F.when(reason.isNull(), F.lit(201))
            .when(reason.isin(MSG_ROLE_DENIED, MSG_OWN_ONLY), F.lit(403)).otherwise(F.lit(400)))
    return r.select("req_id", reason.isNull().alias("accepted"), reason.alias("reject_reason"),
                    code.alias("code"))


def production_defaults(requests: DataFrame, today: dt.date, for_update: bool = False) -> DataFrame:
    """V3: typed job values from the form text, with the defaults.

    Insert: quantite = parseInt(q); update: parseInt(q) || 1. stock_id only
    when parseInt > 0 (update: any non-empty text), amount parseInt || 0 and
    only with a material. A number out of range is null (V2 rejects such a
    request).
    """
    qn = X.parse_int_or_null(F.col("quantite"))
    sid = X.parse_int_or_null(F.col("stock_id"))
    has_stock = (sid > 0) if not for_update else F.coalesce(F.col("stock_id") != "", F.lit(False))
    statut = F.when(F.coalesce(F.col("statut"), F.lit("")) == "", F.lit(C.DEFAULT_STATUT)) \
        .otherwise(F.col("statut"))
    date = F.coalesce(F.nullif(F.col("date_prod"), F.lit("")).try_cast("date"), F.lit(today))
    return requests.select(
        "req_id",
        X.js_trim(F.col("produit")).alias("produit"),
        (F.coalesce(F.nullif(qn, F.lit(0)), F.lit(1)) if for_update else qn).alias("quantite"),
        F.coalesce(X.js_trim(F.col("responsable")), F.lit("")).alias("responsable"),
        date.alias("date_prod"),
        X.lenient_decimal(F.col("cout")).alias("cout"),
        statut.alias("statut"),
        F.when(has_stock, sid.cast("long")).alias("stock_id"),
        F.when(has_stock, X.lenient_int(F.col("qte_consommee"), 0)).otherwise(F.lit(0))
        .alias("qte_consommee"),
    )


def _nulls(columns: list[str]) -> list:
    return [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in columns]


def _stock_rules() -> list:
    return [F.count_if(F.col("quantite") < 0).alias("quantite_negative"), *_nulls(C.STOCK_NOT_NULL)]


def _production_rules() -> list:
    return [F.count_if(F.col("quantite") <= 0).alias("quantite_not_positive"),
            F.count_if(F.col("statut").isNull() | ~F.col("statut").isin(*C.STATUTS)).alias("statut_invalid"),
            *_nulls(C.PRODUCTION_NOT_NULL)]


def _unpivot(counts: DataFrame, table: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as bigint)" for c in counts.columns)
    return counts.select(F.lit(table).alias("table_name"),
                         F.expr(f"stack({len(counts.columns)}, {pairs})").alias("rule", "violations"))


def constraint_violations(stock: DataFrame, production: DataFrame, users: DataFrame,
                          audit: DataFrame | None = None) -> DataFrame:
    """V4: rows that break the table rules, one row per rule with a count: CHECK,
    UNIQUE, the foreign key and every NOT NULL column (of the audit table too, if
    given).

    One conditional-aggregate pass per table, an aggregate for UNIQUE and an
    anti join for the foreign key; the per-rule rows are unpivoted with stack.
    """
    s = stock.agg(*_stock_rules())
    p = production.agg(*_production_rules())
    fk = (production.where(F.col("stock_id").isNotNull()).select("stock_id")
          .join(stock.select(F.col("id").alias("stock_id")), "stock_id", "left_anti")
          .agg(F.count(F.lit(1)).alias("stock_id_missing")))
    dup = (users.groupBy("username").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
           .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("username_duplicate")))
    nul_u = users.agg(*_nulls(C.USERS_NOT_NULL))
    out = (_unpivot(s, "Stock").unionByName(_unpivot(p, "Production"))
           .unionByName(_unpivot(fk, "Production")).unionByName(_unpivot(dup, "Utilisateurs"))
           .unionByName(_unpivot(nul_u, "Utilisateurs")))
    return out if audit is None else out.unionByName(_unpivot(audit.agg(*_nulls(C.AUDIT_NOT_NULL)), "Historique"))


def changed_violations(stock: DataFrame, production: DataFrame,
                       stock_change: tuple[DataFrame, DataFrame] | None = None,
                       job_change: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """V4 for a change: table_name, rule and the violations ``before`` and ``after``, counted
    over the rows the change touches alone. What a rule gains over whole tables is
    ``after - before``, as all other rows stay.

    ``stock`` and ``production`` are the tables before it; a change is (the changed rows
    as they were, as they will be), with the deleted rows in the first only and the new
    ones in the second only. Row rules read the changed rows, the foreign key also the
    ids of ``stock`` and, if materials come or go, the jobs that use those.
    """
    parts = []
    for change, rules, table in ((stock_change, _stock_rules(), "Stock"),
                                 (job_change, _production_rules(), "Production")):
        if change is not None:
            both = [_unpivot(df.agg(*rules), table).select(
                "table_name", "rule", *[(F.col("violations") if i == j else F.lit(0).cast("long")).alias(n)
                                        for j, n in enumerate(("before", "after"))]) for i, df in enumerate(change)]
            parts.append(both[0].unionByName(both[1]).groupBy("table_name", "rule")
                         .agg(F.sum("before").alias("before"), F.sum("after").alias("after")))
    parts.append(_foreign_key_change(stock, production, stock_change, job_change))
    return reduce(DataFrame.unionByName, parts)


def _foreign_key_change(stock, production, stock_change, job_change) -> DataFrame:
    """The foreign key's row of ``changed_violations``. References are counted by material
    before they meet its id, so a material that many jobs use is one row there."""
    refs = production.limit(0).select("stock_id", F.lit(False).alias("new"))
    if job_change is not None:
        refs = (job_change[0].select("stock_id", F.lit(False).alias("new"))
                .unionByName(job_change[1].select("stock_id", F.lit(True).alias("new"))))
    ids = stock.select(F.col("id").alias("stock_id"), F.lit(1).alias("_was"))
    moved = None
    if stock_change is not None:
        # -1: deleted, 1: new
        moved = (stock_change[0].select(F.col("id").alias("stock_id"), F.lit(-1).alias("_d"))
                 .unionByName(stock_change[1].select(F.col("id").alias("stock_id"), F.lit(1).alias("_d")))
                 .groupBy("stock_id").agg(F.sum("_d").alias("_d")).where("_d <> 0"))
        users = production.join(moved.select("stock_id"), "stock_id", "left_semi").select("id", "stock_id")
        if job_change is not None:
            users = users.join(job_change[0].select("id"), "id", "left_anti")
        refs = refs.unionByName(users.select("stock_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("new")))
    counts = refs.where(F.col("stock_id").isNotNull()).groupBy("stock_id", "new").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(ids, "stock_id", "left")
    known = known.join(moved, "stock_id", "left") if moved is not None else known.withColumn("_d", F.lit(0))
    there = F.coalesce("_was", F.lit(0)) + F.when(F.col("new"), F.coalesce("_d", F.lit(0))).otherwise(F.lit(0))
    lost = known.where(there <= 0)
    return lost.agg(*[F.coalesce(F.sum(F.when(F.col("new") == F.lit(is_new), F.col("n"))), F.lit(0)).cast("long").alias(n)
                      for n, is_new in (("before", False), ("after", True))]).select(
        F.lit("Production").alias("table_name"), F.lit("stock_id_missing").alias("rule"), "before", "after")
