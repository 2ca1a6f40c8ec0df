"""Registered queries: one per operator of the inventory, each with its
DuckDB SQL twin where one exists.

Every query reads the domain tables of ``sf_dir`` it needs (derived by Spark from the
driver's tables when first read, see ``sources.catalog``) and runs over all their rows. The
fixed parameters below are query arguments (a search word, a record id, a
clock), not row filters.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs as X
from ..operators import (access, audit, changes, dashboard, figures, ledger, production, search, statements, stock,
                         validate, writes)
from ..session import delete_at_exit
from ..sources import fixtures, sinks
from ..sources.catalog import Tables, audit_columns, open_tables
from ..streaming import guards
from . import sql_twins as S

# ---------------------------------------------------------------------------
# Query parameters
# ---------------------------------------------------------------------------
SEARCH = "ring"            # P3 LIKE word
CONTAINS = "BOLT"          # P4 literal word (case-insensitive)
WORD = "small"             # G2 / A11 global search word
STOCK_ID = 42              # P6 point lookup
PROD_ID = 42               # P8 point lookup
HIST_TABLE, HIST_RECORD = C.TABLE_STOCK, 42   # W1
TODAY = dt.date(2024, 6, 1)
NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
AS_OF = dt.datetime(2025, 1, 15)             # U4/U5 clock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(open_tables(spark, sf_dir, on_use=True))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_ETAT = S.etat()
_ALERTS = ", ".join(f"'{s}'" for s in C.ALERT_STATUTS)
_STATUTS = ", ".join(f"'{s}'" for s in C.STATUTS)

# ---------------------------------------------------------------------------
# 2.1 Sources
# ---------------------------------------------------------------------------


@register("stock_table", S.q("SELECT * FROM stock"))
def _s1(t: Tables):
    return t.stock


@register("production_table", S.q("SELECT * FROM production"))
def _s2(t: Tables):
    return t.production


@register("audit_table", S.q("SELECT * FROM audit"))
def _s3(t: Tables):
    return audit_columns(t.audit)


@register("users_table", S.q("SELECT * FROM users"))
def _s4(t: Tables):
    return t.users


# ---------------------------------------------------------------------------
# 2.2 Sinks
# ---------------------------------------------------------------------------


@register("stock_csv", S.q(f"""SELECT id, materiel, quantite, {S.fr_date('date_ajout')} AS date_ajout,
  {_ETAT} AS etat FROM stock"""))
def _k1(t: Tables):
    return sinks.stock_csv_rows(t.stock)


@register("production_csv", S.q(f"""SELECT p.id, p.produit, p.quantite, p.responsable,
  {S.fr_date('p.date_prod')} AS date, CAST(p.cout AS VARCHAR) AS cout, p.statut,
  COALESCE(s.materiel, '') AS materiel
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id"""))
def _k2(t: Tables):
    return sinks.production_csv_rows(t.production, t.stock)






# ---------------------------------------------------------------------------
# 2.3 Projections, filters, predicates
# ---------------------------------------------------------------------------

@register("stock_state", S.q(f"""SELECT id, materiel, quantite, date_ajout, {_ETAT} AS etat,
  CASE WHEN quantite < {C.CRITICAL_STOCK} THEN 1 ELSE 0 END AS alerte FROM stock"""))
def _p1(t: Tables):
    return stock.stock_state(t.stock)


_LIST = f"""SELECT id, materiel, quantite, strftime(date_ajout, '%Y-%m-%d') AS date_ajout, {_ETAT} AS etat,
  CASE WHEN quantite < {C.CRITICAL_STOCK} THEN 1 ELSE 0 END AS alerte FROM stock"""


@register("stock_list", S.q(_LIST))
def _p2(t: Tables):
    return stock.stock_list(t.stock)


@register("stock_search", S.q(_LIST + f" WHERE materiel ILIKE '%{SEARCH}%'"))
def _p3(t: Tables):
    return stock.stock_list(t.stock, SEARCH)


@register("stock_contains", S.q(f"SELECT * FROM stock WHERE contains(lower(materiel), '{CONTAINS.lower()}')"))
def _p4(t: Tables):
    return stock.stock_contains(t.stock, CONTAINS)


@register("stock_alerts", S.q(f"""SELECT id, materiel, quantite, '{C.STATE_CRITICAL}' AS etat
  FROM stock WHERE quantite < {C.CRITICAL_STOCK}"""))
def _p5(t: Tables):
    return stock.stock_alerts(t.stock)


@register("stock_by_id", S.q(f"SELECT * FROM stock WHERE id = {STOCK_ID}"))
def _p6(t: Tables):
    return stock.stock_by_id(t.stock, STOCK_ID)


@register("production_alerts", S.q(f"""SELECT id, produit, responsable, statut, date_prod
  FROM production WHERE statut IN ({_ALERTS})"""))
def _p7(t: Tables):
    return production.production_alerts(t.production)


_JOB_COLS = "p.id, p.produit, p.quantite, p.responsable, p.date_prod, p.cout, p.statut, p.stock_id, p.qte_consommee"


@register("production_by_id", S.q(f"""SELECT {_JOB_COLS}, p.created_at, p.updated_at, p.updated_by,
  s.materiel AS materiel_nom
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id WHERE p.id = {PROD_ID}"""))
def _p8(t: Tables):
    return production.production_by_id(t.production, t.stock, PROD_ID)


@register("stock_fill_pct", S.q(f"""SELECT id, materiel, quantite,
  CAST(least(100, floor(quantite / {C.FILL_REFERENCE} * 100 + 0.5)) AS INTEGER) AS pct,
  CASE WHEN quantite < {C.CRITICAL_STOCK} THEN 'low' WHEN quantite < {C.LOW_STOCK} THEN 'medium'
       ELSE 'high' END AS level, {_ETAT} AS etat FROM stock"""))
def _p9(t: Tables):
    return stock.stock_fill_pct(t.stock)


_COLOUR = (f"CASE WHEN quantite < {C.CRITICAL_STOCK} THEN '{C.COLOUR_CRITICAL}' "
           f"WHEN quantite < {C.LOW_STOCK} THEN '{C.COLOUR_LOW}' ELSE '{C.COLOUR_OK}' END")


@register("stock_band_colour", S.q(f"SELECT id, materiel, quantite, {_COLOUR} AS couleur FROM stock"))
def _p10(t: Tables):
    return stock.stock_band_colour(t.stock)


@register("status_labels", S.q(f"""SELECT id, statut,
  {S.case('statut', C.STATUS_CLASSES, C.STATUS_CLASS_DEFAULT)} AS classe FROM production"""))
def _p11(t: Tables):
    return production.status_labels(t.production)


@register("role_labels", S.q(f"""SELECT id, username, role,
  {S.case('role', C.ROLE_LABELS, C.ROLE_LABEL_DEFAULT)} AS libelle FROM users""".replace(
    "'Chef d'équipe'", "'Chef d''équipe'")))
def _p12(t: Tables):
    return access.role_labels(t.users)


# ---------------------------------------------------------------------------
# 2.4 Joins
# ---------------------------------------------------------------------------

@register("production_with_material", S.q(f"""SELECT p.id, p.produit, p.quantite, p.responsable,
  strftime(p.date_prod, '%Y-%m-%d') AS date_prod, p.cout, p.statut, p.stock_id, p.qte_consommee,
  s.materiel AS materiel_nom
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id"""))
def _j1(t: Tables):
    return production.production_list(t.production, t.stock)


@register("audit_with_role", S.q("""SELECT a.id, a.utilisateur, COALESCE(a.role_utilisateur, u.role) AS role_utilisateur,
  a.action, a.table_name, a.record_id, a."timestamp"
  FROM audit a LEFT JOIN users u ON a.utilisateur = u.username"""))
def _j2(t: Tables):
    return audit.audit_with_role(t.audit, t.users)


@register("stock_usage", S.q("""SELECT s.id, s.materiel, COALESCE(u.cnt, 0) AS cnt FROM stock s
  LEFT JOIN (SELECT stock_id, COUNT(*) AS cnt FROM production WHERE stock_id IS NOT NULL GROUP BY stock_id) u
  ON s.id = u.stock_id"""))
def _j3(t: Tables):
    return stock.stock_usage(t.stock, t.production)


_SREQ = f", req AS ({S.STOCK_CHANGE_REQUESTS})"


@register("requests_existing", S.q(_SREQ + """ SELECT * FROM req r WHERE op IN ('UPDATE', 'DELETE')
  AND EXISTS (SELECT 1 FROM stock s WHERE s.id = r.target_id)"""))
def _j4(t: Tables):
    r = fixtures.stock_change_requests(t.stock).where(F.col("op").isin("UPDATE", "DELETE"))
    return changes.requests_existing(r, t.stock).select(
        "seq", "op", "target_id", "materiel", "quantite", "date_ajout")


@register("requests_missing", S.q(_SREQ + """ SELECT * FROM req r WHERE op IN ('UPDATE', 'DELETE')
  AND NOT EXISTS (SELECT 1 FROM stock s WHERE s.id = r.target_id)"""))
def _j5(t: Tables):
    r = fixtures.stock_change_requests(t.stock).where(F.col("op").isin("UPDATE", "DELETE"))
    return changes.requests_missing(r, t.stock).select(
        "seq", "op", "target_id", "materiel", "quantite", "date_ajout")


@register("snapshot_diff", S.q(f""", aft AS ({S.snapshot_after_sql('stock')})
SELECT COALESCE(b.id, a.id) AS id,
  CASE WHEN b.id IS NULL THEN 'CREATE' WHEN a.id IS NULL THEN 'DELETE'
       WHEN b.materiel IS NOT DISTINCT FROM a.materiel AND b.quantite IS NOT DISTINCT FROM a.quantite
       THEN 'SAME' ELSE 'UPDATE' END AS change,
  b.materiel AS materiel_avant, b.quantite AS quantite_avant,
  a.materiel AS materiel_apres, a.quantite AS quantite_apres
FROM stock b FULL OUTER JOIN aft a ON b.id = a.id"""))
def _j6(t: Tables):
    return changes.snapshot_diff(t.stock, fixtures.snapshot_after(t.stock), ["materiel", "quantite"])


# ---------------------------------------------------------------------------
# 2.5 Aggregations
# ---------------------------------------------------------------------------

_KPIS = f"""SELECT (SELECT COUNT(*) FROM stock) AS total_materiaux,
  (SELECT CAST(COALESCE(SUM(quantite), 0) AS BIGINT) FROM stock) AS total_unites,
  (SELECT COUNT(*) FROM production) AS total_productions,
  (SELECT CAST(COALESCE(SUM(cout), 0) AS DECIMAL(22,2)) FROM production) AS cout_total,
  (SELECT COUNT(*) FROM stock WHERE quantite < {C.CRITICAL_STOCK}) AS alertes_stock,
  (SELECT COUNT(*) FROM production WHERE statut IN ({_ALERTS})) AS alertes_prod"""


@register("dashboard_kpis", S.q(_KPIS))
def _a1(t: Tables):
    return dashboard.dashboard_kpis(t.stock, t.production)


@register("production_by_status", S.q("SELECT statut, COUNT(*) AS nombre FROM production GROUP BY statut"))
def _a2(t: Tables):
    return production.production_by_status(t.production)


@register("status_share", S.q("""SELECT statut, nombre,
  CAST(CASE WHEN total > 0 THEN floor(CAST(nombre AS DOUBLE) * 100 / total + 0.5) ELSE 0 END AS BIGINT) AS pct
  FROM (SELECT statut, COUNT(*) AS nombre, SUM(COUNT(*)) OVER () AS total FROM production GROUP BY statut)"""))
def _a3(t: Tables):
    return production.status_share(t.production)


@register("production_by_month", S.q("""SELECT CAST(year(date_prod) AS INTEGER) AS annee,
  CAST(month(date_prod) AS INTEGER) AS mois, COUNT(*) AS total FROM production GROUP BY 1, 2"""))
def _a4(t: Tables):
    return production.production_by_month(t.production)


@register("production_total", S.q("SELECT COUNT(*) AS total FROM production"))
def _a5(t: Tables):
    return production.production_total(t.production)


@register("stock_report_kpis", S.q(f"""SELECT COUNT(*) AS total,
  COUNT(*) FILTER (WHERE quantite < {C.CRITICAL_STOCK}) AS critiques,
  COUNT(*) FILTER (WHERE quantite >= {C.CRITICAL_STOCK} AND quantite < {C.LOW_STOCK}) AS faibles,
  CAST(COALESCE(SUM(quantite), 0) AS BIGINT) AS total_unites FROM stock"""))
def _a6(t: Tables):
    return dashboard.stock_report_kpis(t.stock)


@register("production_report_kpis", S.q(f"""SELECT COUNT(*) AS total,
  COUNT(*) FILTER (WHERE statut = '{C.FINISHED_STATUT}') AS termines,
  COUNT(*) FILTER (WHERE statut IN ({_ALERTS})) AS critiques,
  CAST(COALESCE(SUM(cout), 0) AS DECIMAL(22,2)) AS cout_total,
  CAST(COALESCE(SUM(quantite), 0) AS BIGINT) AS qte_totale FROM production"""))
def _a7(t: Tables):
    return dashboard.production_report_kpis(t.production)


@register("stats_kpis", S.q(f""", k AS (SELECT (SELECT COUNT(*) FROM stock) AS materiaux,
  (SELECT COUNT(*) FROM production WHERE statut = '{C.FINISHED_STATUT}') AS terminees,
  (SELECT COUNT(*) FROM production) AS n,
  (SELECT CAST(COALESCE(SUM(cout), 0) AS DECIMAL(22,2)) FROM production) AS cout_total)
SELECT materiaux, terminees,
  CAST(CASE WHEN n > 0 THEN CAST((CAST(cout_total * 100 AS HUGEINT) * 2 + n) // (2 * n) AS DECIMAL(22,0)) * 0.01
       ELSE 0 END AS DECIMAL(22,2)) AS cout_moyen,
  cout_total FROM k"""))
def _a8(t: Tables):
    return dashboard.stats_kpis(t.stock, t.production)


@register("users_by_role", S.q("""SELECT role, COUNT(*) AS nombre_utilisateurs,
  COUNT(*) FILTER (WHERE actif) AS actifs FROM users GROUP BY role"""))
def _a9(t: Tables):
    return access.users_by_role(t.users)


@register("alert_summary", S.q(f""", k AS ({_KPIS})
SELECT alertes_stock, alertes_prod, alertes_stock + alertes_prod AS total_alertes,
  alertes_stock + alertes_prod > 0 AS cloche, alertes_stock > 0 AS badge_stock,
  alertes_prod > 0 AS badge_prod FROM k"""))
def _a10(t: Tables):
    return dashboard.alert_summary(t.stock, t.production)


def _bundle_sql() -> str:
    kp = S.json_obj([(c, c, "num") for c in ("total_materiaux", "total_unites", "total_productions",
                                             "cout_total", "alertes_stock", "alertes_prod")])
    sc = S.json_obj([("materiel", "materiel", "str"), ("quantite", "quantite", "num"),
                     ("couleur", "couleur", "str"), ("id", "id", "num")])
    pc = S.json_obj([("statut", "statut", "str"), ("nombre", "nombre", "num")])
    rc = S.json_obj([("produit", "produit", "str"), ("quantite", "quantite", "num"),
                     ("responsable", "responsable", "str"), ("date_prod", "date_prod", "date"),
                     ("cout", "cout", "num"), ("statut", "statut", "str"),
                     ("materiel_nom", "materiel_nom", "str"), ("id", "id", "num")])
    al = S.json_obj([("id", "id", "num"), ("materiel", "materiel", "str"), ("quantite", "quantite", "num")])
    ap = S.json_obj([("id", "id", "num"), ("produit", "produit", "str"), ("statut", "statut", "str"),
                     ("responsable", "responsable", "str")])
    return S.q(f""", k AS ({_KPIS}),
sc AS (SELECT id, materiel, quantite, {_COLOUR} AS couleur FROM stock ORDER BY quantite DESC, id LIMIT 10),
pc AS (SELECT statut, COUNT(*) AS nombre FROM production GROUP BY statut),
rc AS (SELECT p.id, p.produit, p.quantite, p.responsable, p.date_prod, p.cout, p.statut,
         s.materiel AS materiel_nom
       FROM (SELECT * FROM production ORDER BY date_prod DESC, id DESC LIMIT 5) p
       LEFT JOIN stock s ON p.stock_id = s.id)
SELECT 'kpis' AS part, CAST(0 AS INTEGER) AS pos, {kp} AS item FROM k
UNION ALL SELECT 'stockChart', CAST(row_number() OVER (ORDER BY quantite DESC, id) - 1 AS INTEGER), {sc} FROM sc
UNION ALL SELECT 'prodChart', CAST(row_number() OVER (ORDER BY statut) - 1 AS INTEGER), {pc} FROM pc
UNION ALL SELECT 'recent', CAST(row_number() OVER (ORDER BY date_prod DESC, id DESC) - 1 AS INTEGER), {rc} FROM rc
UNION ALL SELECT 'alertesStock', NULL, {al} FROM stock WHERE quantite < {C.CRITICAL_STOCK}
UNION ALL SELECT 'alertesProd', NULL, {ap} FROM production WHERE statut IN ({_ALERTS})""")


@register("dashboard_bundle", _bundle_sql())
def _k4(t: Tables):
    """K4 checked flattened: one row per item of its six parts."""
    return dashboard.dashboard_summary_flat(t.stock, t.production)


@register("dashboard_bundle_kept", _bundle_sql())
def _k4_kept(t: Tables):
    """K4 with its figures and the chart per statut from the stored sums."""
    return dashboard.dashboard_summary_flat(t.stock, t.production, t.figures())


# A1, A2, A4, A6-A8 from the stored sums: the rows, so the twins, of the whole-table queries
for _name in ("dashboard_kpis", "production_by_status", "production_by_month", "stock_report_kpis",
              "production_report_kpis", "stats_kpis"):
    register(f"{_name}_kept", ORACLES[_name])(lambda t, f=getattr(figures, _name): f(t.figures()))


_W = WORD.lower()
_HITS = f"""SELECT 'stock' AS source, id, materiel AS libelle FROM stock WHERE contains(lower(materiel), '{_W}')
  UNION ALL
  SELECT 'production' AS source, p.id, p.produit AS libelle
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id
  WHERE contains(lower(p.produit), '{_W}') OR contains(lower(p.responsable), '{_W}')
     OR contains(lower(COALESCE(s.materiel, '')), '{_W}')"""


@register("global_search_counts", S.q(f""", hits AS ({_HITS}), src(source) AS (VALUES ('stock'), ('production'))
SELECT src.source, COUNT(h.source) AS hits FROM src LEFT JOIN hits h ON h.source = src.source
GROUP BY src.source"""))
def _a11(t: Tables):
    return search.global_search_counts(t.stock, t.production, WORD)


# ---------------------------------------------------------------------------
# 2.6 Windows
# ---------------------------------------------------------------------------

_HIST = "id, utilisateur, role_utilisateur, action, ancienne_valeur, nouvelle_valeur, details, \"timestamp\""


@register("audit_history", S.q(f"""SELECT {_HIST},
  CAST(dense_rank() OVER (ORDER BY "timestamp" DESC) AS INTEGER) AS version
  FROM audit WHERE table_name = '{HIST_TABLE}' AND record_id = {HIST_RECORD}"""))
def _w1(t: Tables):
    return audit.audit_history(t.audit, HIST_TABLE, HIST_RECORD)


@register("audit_versions", S.q(f"""SELECT table_name, record_id, {_HIST},
  CAST(dense_rank() OVER (PARTITION BY table_name, record_id ORDER BY "timestamp" DESC) AS INTEGER) AS version
  FROM audit"""))
def _w2(t: Tables):
    return audit.audit_versions(t.audit)


# ---------------------------------------------------------------------------
# 2.7 Sorts, limits, top-k (ties broken by id)
# ---------------------------------------------------------------------------

@register("top_stock", S.q(f"""SELECT id, materiel, quantite, {_COLOUR} AS couleur FROM stock
  ORDER BY quantite DESC, id LIMIT 10"""))
def _t1(t: Tables):
    return stock.top_stock(t.stock)


@register("lowest_stock", S.q(f"SELECT id, materiel, quantite, {_ETAT} AS etat FROM stock ORDER BY quantite, id LIMIT 10"))
def _t2(t: Tables):
    return stock.lowest_stock(t.stock)


@register("recent_production", S.q("""SELECT p.id, p.produit, p.quantite, p.responsable, p.date_prod, p.cout,
  p.statut, s.materiel AS materiel_nom
  FROM (SELECT * FROM production ORDER BY date_prod DESC, id DESC LIMIT 5) p
  LEFT JOIN stock s ON p.stock_id = s.id"""))
def _t3(t: Tables):
    return production.recent_production(t.production, t.stock)


@register("latest_created", S.q("""SELECT id, produit, quantite, responsable, date_prod, cout, statut
  FROM production ORDER BY created_at DESC, id DESC LIMIT 10"""))
def _t4(t: Tables):
    return production.latest_created(t.production)


@register("top_production_qty", S.q("""SELECT id, produit, quantite, responsable, statut FROM production
  ORDER BY quantite DESC, id LIMIT 5"""))
def _t5(t: Tables):
    return production.top_production_qty(t.production)


@register("stock_report", S.q(f"""SELECT id, materiel, quantite, date_ajout, {S.fr_date('date_ajout')} AS date_fr,
  {_ETAT} AS etat FROM stock"""))
def _t6(t: Tables):
    return stock.stock_report(t.stock)


@register("production_report", S.q(f"""SELECT p.id, p.produit, p.quantite, p.responsable, p.date_prod, p.cout,
  p.statut, p.qte_consommee, s.materiel AS materiau, {S.fr_date('p.date_prod')} AS date_fr,
  {S.fr_money('p.cout')} AS cout_fr
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id"""))
def _t7(t: Tables):
    return production.production_report(t.production, t.stock)


# ---------------------------------------------------------------------------
# 2.8 Set operations
# ---------------------------------------------------------------------------

@register("alert_feed", S.q(f"""SELECT 'stock' AS source, id, materiel AS libelle, CAST(quantite AS VARCHAR) AS detail
  FROM stock WHERE quantite < {C.CRITICAL_STOCK}
  UNION ALL
  SELECT 'production', id, produit, statut FROM production WHERE statut IN ({_ALERTS})"""))
def _g1(t: Tables):
    return search.alert_feed(t.stock, t.production)


@register("global_search", S.q(_HITS))
def _g2(t: Tables):
    return search.global_search(t.stock, t.production, WORD)


# ---------------------------------------------------------------------------
# 2.9 Scalar functions
# ---------------------------------------------------------------------------

@register("format_date_fr", S.q(f"SELECT id, {S.fr_date('date_prod')} AS date_fr FROM production"))
def _f1(t: Tables):
    return t.production.select("id", X.format_date_fr(F.col("date_prod")).alias("date_fr"))


@register("format_mad", S.q(f"SELECT id, {S.fr_money('cout')} AS cout_fr FROM production"))
def _f2(t: Tables):
    return t.production.select("id", X.format_mad(F.col("cout")).alias("cout_fr"))


@register("format_mad0", S.q(f"SELECT id, {S.fr_money('cout', 0)} AS cout_fr FROM production"))
def _f3(t: Tables):
    return t.production.select("id", X.format_mad0(F.col("cout")).alias("cout_fr"))


@register("iso_date", S.q("SELECT id, strftime(date_ajout, '%Y-%m-%d') AS date_iso FROM stock"))
def _f4(t: Tables):
    return t.stock.select("id", X.iso_date(F.col("date_ajout")).alias("date_iso"))


_PREQ = f", req AS ({S.PRODUCTION_TEXT_REQUESTS})"


def _text_requests(t: Tables) -> DataFrame:
    return fixtures.production_text_requests(t.production, t.raw("orders"))


@register("lenient_int", S.q(_PREQ + f" SELECT req_id, quantite, {S.lenient_int('quantite', '1')} AS quantite_int FROM req"))
def _f5(t: Tables):
    r = fixtures.production_text_requests(t.production)
    return r.select("req_id", "quantite", X.lenient_int(F.col("quantite"), 1).alias("quantite_int"))


@register("lenient_decimal", S.q(_PREQ + f" SELECT req_id, cout, {S.lenient_decimal('cout')} AS cout_dec FROM req"))
def _f6(t: Tables):
    r = fixtures.production_text_requests(t.production)
    return r.select("req_id", "cout", X.lenient_decimal(F.col("cout")).alias("cout_dec"))


@register("clean_text", S.q(_PREQ + f" SELECT req_id, produit, {S.clean_text('produit')} AS produit_net FROM req"))
def _f7(t: Tables):
    r = fixtures.production_text_requests(t.production)
    return r.select("req_id", "produit", X.clean_text(F.col("produit")).alias("produit_net"))


@register("audit_json", S.q(f"SELECT id, {S.json_of(S.PRODUCTION_JSON, '')} AS json FROM production"))
def _f8(t: Tables):
    return t.production.select("id", X.audit_json(*C.PRODUCTION_AUDIT_COLUMNS).alias("json"))


# ---------------------------------------------------------------------------
# 2.10 Change application and stock ledger
# ---------------------------------------------------------------------------

_STOCK_COLS = "id, materiel, quantite, date_ajout, created_at, updated_at, updated_by"


@register("insert_stock", S.q(_SREQ + f""" SELECT {_STOCK_COLS} FROM stock
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM stock) + row_number() OVER (ORDER BY seq) AS id,
  {S.js_trim('materiel')} AS materiel, quantite, COALESCE(date_ajout, DATE '{TODAY}') AS date_ajout,
  TIMESTAMP '{NOW}' AS created_at, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
FROM req WHERE op = 'INSERT'"""))
def _m1(t: Tables):
    ins = fixtures.stock_change_requests(t.stock).where(F.col("op") == "INSERT")
    return changes.insert_stock(t.stock, ins, TODAY, NOW)


@register("update_stock", S.q(_SREQ + f""", latest AS (
  SELECT target_id, arg_max(materiel, seq) AS materiel, arg_max(quantite, seq) AS quantite,
         arg_max(date_ajout, seq) AS date_ajout FROM req WHERE op = 'UPDATE' GROUP BY target_id)
SELECT s.id,
  CASE WHEN l.target_id IS NOT NULL THEN {S.js_trim('l.materiel')} ELSE s.materiel END AS materiel,
  CASE WHEN l.target_id IS NOT NULL THEN l.quantite ELSE s.quantite END AS quantite,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(l.date_ajout, DATE '{TODAY}') ELSE s.date_ajout END AS date_ajout,
  s.created_at, s.updated_at, s.updated_by
FROM stock s LEFT JOIN latest l ON s.id = l.target_id"""))
def _m2(t: Tables):
    upd = fixtures.stock_change_requests(t.stock).where(F.col("op") == "UPDATE")
    return changes.update_stock(t.stock, upd, TODAY)


@register("delete_stock", S.q(_SREQ + """ SELECT * FROM stock s WHERE NOT EXISTS (
  SELECT 1 FROM req r WHERE r.op = 'DELETE' AND r.target_id = s.id)"""))
def _m3(t: Tables):
    d = fixtures.stock_change_requests(t.stock).where(F.col("op") == "DELETE")
    return changes.delete_stock(t.stock, d)


@register("delete_stock_detach", S.q(_SREQ + """ SELECT p.* REPLACE (
  CASE WHEN EXISTS (SELECT 1 FROM req r WHERE r.op = 'DELETE' AND r.target_id = p.stock_id)
       THEN NULL ELSE p.stock_id END AS stock_id) FROM production p"""))
def _m3b(t: Tables):
    d = fixtures.stock_change_requests(t.stock).where(F.col("op") == "DELETE")
    return changes.detach_deleted_stock(t.production, d)


def _accepted_inserts(t: Tables) -> DataFrame:
    """Text requests -> V2 -> V3 -> M7 (against the current stock) -> rows to insert."""
    reqs = _text_requests(t)
    ok = validate.validate_production_requests(reqs, t.users).where("accepted").select("req_id")
    # read several times below (range split, join, numbering): stored once
    typed = validate.production_defaults(reqs.join(ok, "req_id", "left_semi"), TODAY).checkpoint()
    dec = ledger.consume_stock(
        typed.select("req_id", "stock_id", F.col("qte_consommee").alias("qte"),
                     F.col("req_id").alias("_ord")), t.stock, ("_ord", "req_id"))
    return typed.join(dec.where("accepted").select("req_id"), "req_id", "left_semi").checkpoint()


_ROLES_CREATE = ", ".join(f"'{r}'" for r in validate.PRODUCTION_CREATE_ROLES)
_V2_REASON = f"""CASE WHEN NOT COALESCE(u.role IN ({_ROLES_CREATE}), false) THEN '{validate.MSG_ROLE_DENIED}'
  WHEN u.role = 'responsable' AND r.responsable IS DISTINCT FROM u.username THEN '{validate.MSG_OWN_ONLY}'
  WHEN {S.clean_text("r.produit")} IS NULL THEN '{validate.MSG_PRODUIT_REQUIRED}'
  WHEN COALESCE(r.quantite = '', true) OR ({S.parse_int("r.quantite")} IS NULL AND NOT {S.int_overflow("r.quantite")})
       OR {S.parse_int("r.quantite")} < 1 THEN '{validate.MSG_QUANTITE_MIN1}'
  WHEN {S.clean_text("r.responsable")} IS NULL THEN '{validate.MSG_RESPONSABLE_REQUIRED}'
  WHEN r.statut IS NOT NULL AND r.statut <> '' AND r.statut NOT IN ({_STATUTS}) THEN '{validate.MSG_STATUT_INVALID}'
  WHEN {S.int_overflow("r.quantite")} OR {S.int_overflow("r.stock_id")} OR {S.int_overflow("r.qte_consommee")}
       OR {S.decimal_overflow("r.cout")} THEN '{validate.MSG_OUT_OF_RANGE}'
END"""

_V2_CTE = _PREQ + f""", v2 AS (SELECT r.req_id, {_V2_REASON} AS reason FROM req r
  LEFT JOIN users u ON r.req_user_id = u.id)"""

_V3_SELECT = """SELECT r.req_id, {trim_produit} AS produit, {qn} AS quantite,
  COALESCE({trim_resp}, '') AS responsable,
  COALESCE(TRY_CAST(NULLIF(r.date_prod, '') AS DATE), DATE '{today}') AS date_prod,
  {cout} AS cout,
  CASE WHEN COALESCE(r.statut, '') = '' THEN '{default}' ELSE r.statut END AS statut,
  CASE WHEN {sid} > 0 THEN CAST({sid} AS BIGINT) END AS stock_id,
  CASE WHEN {sid} > 0 THEN {qte} ELSE 0 END AS qte_consommee
FROM req r""".format(trim_produit=S.js_trim("r.produit"), qn=S.parse_int("r.quantite"),
                     trim_resp=S.js_trim("r.responsable"), today=TODAY, cout=S.lenient_decimal("r.cout"),
                     default=C.DEFAULT_STATUT, sid=S.parse_int("r.stock_id"),
                     qte=S.lenient_int("r.qte_consommee", "0"))


@register("insert_production", S.q(_V2_CTE + f""", v3 AS ({_V3_SELECT}
  WHERE r.req_id IN (SELECT req_id FROM v2 WHERE reason IS NULL)),
r2 AS (SELECT v.req_id, v.stock_id, CAST(v.qte_consommee AS BIGINT) AS qte,
  CAST(s.quantite AS BIGINT) AS opening, s.id AS sid FROM v3 v LEFT JOIN stock s ON v.stock_id = s.id)"""
    + S.greedy_fold_ctes("SELECT req_id, stock_id, qte, opening, row_number() OVER (PARTITION BY stock_id "
                         "ORDER BY req_id) AS rn FROM r2 WHERE sid IS NOT NULL AND qte > 0") + f""",
ok AS (SELECT req_id FROM fold WHERE accepted
  UNION ALL SELECT req_id FROM r2 WHERE NOT (sid IS NOT NULL AND qte > 0) AND (sid IS NOT NULL OR stock_id IS NULL))
SELECT id, produit, quantite, responsable, date_prod, cout, statut, stock_id, qte_consommee,
  created_at, updated_at, updated_by FROM production
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM production) + row_number() OVER (ORDER BY v.req_id) AS id,
  v.produit, v.quantite, v.responsable, v.date_prod, v.cout, v.statut, v.stock_id, v.qte_consommee,
  TIMESTAMP '{NOW}' AS created_at, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
FROM v3 v WHERE v.req_id IN (SELECT req_id FROM ok)""", recursive=True))
def _m4(t: Tables):
    return changes.insert_production(t.production, _accepted_inserts(t), NOW)


_PCREQ = f", req AS ({S.PRODUCTION_CHANGE_REQUESTS})"


_UPDATED_JOBS = f""", latest AS (
  SELECT target_id, arg_max(produit, seq) AS produit, arg_max(quantite, seq) AS quantite,
    arg_max(responsable, seq) AS responsable, arg_max(date_prod, seq) AS date_prod,
    arg_max(cout, seq) AS cout, arg_max(statut, seq) AS statut, arg_max(stock_id, seq) AS stock_id,
    arg_max(qte_consommee, seq) AS qte_consommee
  FROM req WHERE op = 'UPDATE' AND {S.clean_text('produit')} IS NOT NULL GROUP BY target_id)
SELECT p.id,
  CASE WHEN l.target_id IS NOT NULL THEN {S.js_trim('l.produit')} ELSE p.produit END AS produit,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(NULLIF(l.quantite, 0), 1) ELSE p.quantite END AS quantite,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE({S.js_trim('l.responsable')}, '') ELSE p.responsable END AS responsable,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(l.date_prod, DATE '{TODAY}') ELSE p.date_prod END AS date_prod,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(l.cout, CAST(0 AS DECIMAL(12,2))) ELSE p.cout END AS cout,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(NULLIF(l.statut, ''), '{C.DEFAULT_STATUT}') ELSE p.statut END AS statut,
  CASE WHEN l.target_id IS NOT NULL THEN l.stock_id ELSE p.stock_id END AS stock_id,
  CASE WHEN l.target_id IS NOT NULL THEN COALESCE(NULLIF(l.qte_consommee, 0), 0) ELSE p.qte_consommee END AS qte_consommee,
  p.created_at, p.updated_at, p.updated_by
FROM production p LEFT JOIN latest l ON p.id = l.target_id"""


@register("update_production", S.q(_PCREQ + _UPDATED_JOBS))
def _m5(t: Tables):
    upd = fixtures.production_change_requests(t.production).where(F.col("op") == "UPDATE")
    return changes.update_production(t.production, upd, TODAY)


@register("delete_production", S.q(_PCREQ + """ SELECT * FROM production p WHERE NOT EXISTS (
  SELECT 1 FROM req r WHERE r.op = 'DELETE' AND r.target_id = p.id)"""))
def _m6(t: Tables):
    d = fixtures.production_change_requests(t.production).where(F.col("op") == "DELETE")
    return changes.delete_production(t.production, d)


# the jobs after the whole batch: updates, then deletes
_JOBS_AFTER = _PCREQ + _UPDATED_JOBS.replace("\nSELECT p.id,", ", updated AS (SELECT p.id,") + """),
jobs AS (SELECT * FROM updated u WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.op = 'DELETE' AND r.target_id = u.id))"""


@register("figures_after_job_changes", S.q(_JOBS_AFTER + f""", k AS (
  SELECT '{figures.STATUT}' AS part, statut AS cle, quantite, cout FROM jobs
  UNION ALL SELECT '{figures.MONTH}', CAST(year(date_prod) AS VARCHAR) || '/' || CAST(month(date_prod) AS VARCHAR),
    quantite, cout FROM jobs
  UNION ALL SELECT '{figures.BAND}', {_ETAT}, quantite, NULL FROM stock)
SELECT part, cle, COUNT(*) AS n, CAST(COALESCE(SUM(quantite), 0) AS BIGINT) AS unites,
  CAST(COALESCE(SUM(cout), 0) AS DECIMAL(32,2)) AS cout FROM k GROUP BY part, cle"""))
def _k4_after(t: Tables):
    """The dashboard's partial sums after a batch of job changes: the stored sums with the
    changed rows taken out and put in again; the jobs left alone are not added up."""
    _, changed = writes.changed_jobs(t, fixtures.production_change_requests(t.production), TODAY)
    return figures.change(t.figures(), production=changed)


def _m7_requests(t: Tables) -> DataFrame:
    return t.production.select(F.col("id").alias("req_id"), "stock_id",
                               F.col("qte_consommee").alias("qte"), "date_prod")


@register("consume_stock", S.q(S.M7_CTES + " SELECT * FROM m7", recursive=True))
def _m7(t: Tables):
    return ledger.consume_stock(_m7_requests(t), t.stock)


@register("stock_after_consumption", S.q(S.M7_CTES + """ SELECT s.id, s.materiel, s.quantite AS quantite_initiale,
  CAST(COALESCE(u.used, 0) AS BIGINT) AS consomme, CAST(s.quantite - COALESCE(u.used, 0) AS BIGINT) AS quantite
  FROM stock s LEFT JOIN (SELECT stock_id, SUM(qte) AS used FROM m7
    WHERE accepted AND stock_id IS NOT NULL AND qte > 0 GROUP BY stock_id) u ON s.id = u.stock_id""",
    recursive=True))
def _m8(t: Tables):
    return ledger.stock_after_consumption(t.stock, ledger.consume_stock(_m7_requests(t), t.stock))


@register("dissociated_counts", S.q(_SREQ + """ SELECT s.id, s.materiel,
  (SELECT COUNT(*) FROM production p WHERE p.stock_id = s.id) AS cnt
  FROM stock s WHERE s.id IN (SELECT target_id FROM req WHERE op = 'DELETE')"""))
def _m9(t: Tables):
    d = fixtures.stock_change_requests(t.stock).where(F.col("op") == "DELETE")
    return changes.dissociated_counts(t.stock, t.production, d)


# ---------------------------------------------------------------------------
# 2.11 Validation, audit, access
# ---------------------------------------------------------------------------

_V1_ERRS = (f"list_filter([CASE WHEN {S.clean_text('materiel')} IS NULL THEN '{validate.MSG_MATERIEL_REQUIRED}' END, "
            f"CASE WHEN NOT COALESCE(regexp_matches(quantite, '^[-+]?(0|[1-9][0-9]*)$'), false) "
            f"OR TRY_CAST(quantite AS INTEGER) IS NULL OR TRY_CAST(quantite AS INTEGER) < 0 THEN '{validate.MSG_QUANTITE_POSITIVE}' END], lambda x: x IS NOT NULL)")


@register("validate_stock_requests", S.q(f", req AS ({S.STOCK_TEXT_REQUESTS}), e AS (SELECT req_id, {_V1_ERRS} AS errs FROM req)"
                                         """ SELECT req_id, len(errs) = 0 AS accepted, CAST(len(errs) AS INTEGER) AS n_errors,
  array_to_string(errs, ' | ') AS errors FROM e"""))
def _v1(t: Tables):
    return validate.validate_stock_requests(fixtures.stock_text_requests(t.stock))


@register("validate_production_requests", S.q(_V2_CTE + """ SELECT req_id, reason IS NULL AS accepted,
  reason AS reject_reason,
  CASE WHEN reason IS NULL THEN 201 WHEN reason IN ('""" + validate.MSG_ROLE_DENIED + "', '" + validate.MSG_OWN_ONLY + """')
       THEN 403 ELSE 400 END AS code FROM v2"""))
def _v2(t: Tables):
    return validate.validate_production_requests(_text_requests(t), t.users)


@register("production_defaults", S.q(_PREQ + " " + _V3_SELECT))
def _v3(t: Tables):
    return validate.production_defaults(fixtures.production_text_requests(t.production), TODAY)


def _not_null(label: str, table: str, columns: list[str]) -> str:
    return "\n".join(f"""UNION ALL SELECT '{label}', '{c}_null', (SELECT COUNT(*) FROM {table} WHERE "{c}" IS NULL)"""
                     for c in columns)


@register("constraint_violations", S.q(f"""SELECT 'Stock' AS table_name, 'quantite_negative' AS rule,
  (SELECT COUNT(*) FROM stock WHERE quantite < 0) AS violations
{_not_null('Stock', 'stock', C.STOCK_NOT_NULL)}
UNION ALL SELECT 'Production', 'quantite_not_positive', (SELECT COUNT(*) FROM production WHERE quantite <= 0)
UNION ALL SELECT 'Production', 'statut_invalid',
  (SELECT COUNT(*) FROM production WHERE statut IS NULL OR statut NOT IN ({_STATUTS}))
{_not_null('Production', 'production', C.PRODUCTION_NOT_NULL)}
UNION ALL SELECT 'Production', 'stock_id_missing', (SELECT COUNT(*) FROM production p
  WHERE p.stock_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stock s WHERE s.id = p.stock_id))
UNION ALL SELECT 'Utilisateurs', 'username_duplicate', (SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM
  (SELECT username, COUNT(*) AS n FROM users GROUP BY username HAVING COUNT(*) > 1))
{_not_null('Utilisateurs', 'users', C.USERS_NOT_NULL)}
{_not_null('Historique', 'audit', C.AUDIT_NOT_NULL)}"""))
def _v4(t: Tables):
    return validate.constraint_violations(t.stock, t.production, t.users, t.audit)


def _capture_parts(table: str, spec, label: str) -> tuple[str, str]:
    """(extra CTEs, final SELECT) of the trigger capture twin."""
    other = ["materiel", "quantite", "date_ajout", "created_at", "updated_at", "updated_by"] \
        if table == "stock" else ["produit", "quantite", "responsable", "date_prod", "cout", "statut",
                                  "stock_id", "qte_consommee", "created_at", "updated_at", "updated_by"]
    same = " AND ".join(f"b.{c} IS NOT DISTINCT FROM a.{c}" for c in other)
    ctes = f""", aft AS ({S.snapshot_after_sql(table)}),
j AS (SELECT b.*, a.id AS a_id, a.updated_by AS a_updated_by, {', '.join(f'a.{c} AS a_{c}' for c in other if c != 'updated_by')},
  CASE WHEN b.id IS NULL THEN 'CREATE' WHEN a.id IS NULL THEN 'DELETE' WHEN NOT ({same}) THEN 'UPDATE' END AS act
  FROM {table} b FULL OUTER JOIN aft a ON b.id = a.id)"""
    select = f"""SELECT CASE WHEN act = 'DELETE' THEN '{C.SYSTEM_USER}' ELSE COALESCE(a_updated_by, '{C.SYSTEM_USER}') END AS utilisateur,
  CAST(NULL AS VARCHAR) AS role_utilisateur, act AS action, '{label}' AS table_name,
  COALESCE(id, a_id) AS record_id,
  CASE WHEN id IS NOT NULL THEN {S.json_of(spec, '')} END AS ancienne_valeur,
  CASE WHEN a_id IS NOT NULL THEN {S.json_of(spec, 'a_')} END AS nouvelle_valeur,
  CAST(NULL AS VARCHAR) AS details, CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS user_agent,
  TIMESTAMP '{NOW}' AS "timestamp"
FROM j WHERE act IS NOT NULL"""
    return ctes, select


def _capture_sql(table: str, spec, label: str) -> str:
    ctes, select = _capture_parts(table, spec, label)
    return S.q(ctes + "\n" + select)


@register("capture_stock_changes", _capture_sql("stock", S.STOCK_JSON, C.TABLE_STOCK))
def _u1(t: Tables):
    return audit.capture_stock_changes(t.stock, fixtures.snapshot_after(t.stock), NOW)


@register("capture_production_changes", _capture_sql("production", S.PRODUCTION_JSON, C.TABLE_PRODUCTION))
def _u2(t: Tables):
    return audit.capture_production_changes(t.production, fixtures.snapshot_after(t.production), NOW)


def _statement_sql(table: str, spec, label: str, request: str, date: str, values: dict[str, str], sound: str) -> str:
    """Twin of the trigger firing once a statement: each live statement beside the
    latest earlier update of its row."""
    star = ", ".join(f"r.{c}" for c in values if c not in ("quantite", date))
    old = ", ".join(f"CASE WHEN p.p IS NULL THEN s.{c} ELSE o.{c} END AS b_{c}" for c in values)
    return S.q(request + f""", st AS (
  SELECT r.seq * 10 + u.k AS seq, CASE WHEN r.op = 'DELETE' AND u.k = 4 THEN 'DELETE' ELSE 'UPDATE' END AS op,
         r.target_id, {star}, r.quantite + u.k AS quantite, CASE WHEN u.k <> 2 THEN r.{date} END AS {date}
  FROM req r, unnest(range(1, CASE WHEN r.op = 'DELETE' THEN 6 ELSE 4 END)) AS u(k) WHERE r.op <> 'INSERT'),
gone AS (SELECT target_id, min(seq) AS g FROM st WHERE op = 'DELETE' GROUP BY target_id),
live AS (
  SELECT st.seq, st.op, st.target_id, {", ".join(f"{e} AS {c}" for c, e in values.items())}
  FROM st JOIN {table} s ON s.id = st.target_id LEFT JOIN gone ON gone.target_id = st.target_id
  WHERE (g IS NULL OR st.seq <= g) AND (st.op = 'DELETE' OR {sound})),
p AS (SELECT a.seq, max(b.seq) AS p FROM live a
      LEFT JOIN live b ON b.target_id = a.target_id AND b.seq < a.seq AND b.op = 'UPDATE' GROUP BY a.seq),
j AS (
  SELECT v.*, s.updated_by, {old}
  FROM live v JOIN p ON p.seq = v.seq JOIN {table} s ON s.id = v.target_id LEFT JOIN live o ON o.seq = p.p)
SELECT CASE WHEN op = 'DELETE' THEN '{C.SYSTEM_USER}' ELSE COALESCE(updated_by, '{C.SYSTEM_USER}') END AS utilisateur,
  CAST(NULL AS VARCHAR) AS role_utilisateur, op AS action, '{label}' AS table_name, target_id AS record_id,
  {S.json_of(spec, 'b_')} AS ancienne_valeur, CASE WHEN op = 'UPDATE' THEN {S.json_of(spec, '')} END AS nouvelle_valeur,
  CAST(NULL AS VARCHAR) AS details, CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS user_agent,
  TIMESTAMP '{NOW}' AS "timestamp", seq
FROM j""")


@register("stock_statement_audit", _statement_sql(
    "stock", S.STOCK_JSON, C.TABLE_STOCK, _SREQ, "date_ajout",
    {"materiel": S.js_trim("st.materiel"), "quantite": "st.quantite",
     "date_ajout": f"COALESCE(st.date_ajout, DATE '{TODAY}')"}, "true"))
def _u1c(t: Tables):
    """U1 statement by statement: several updates of a material, a delete last."""
    asked = fixtures.statement_requests(fixtures.stock_change_requests(t.stock), "date_ajout")
    return statements.stock_statements(t.stock, asked, TODAY, NOW)


@register("production_statement_audit", _statement_sql(
    "production", S.PRODUCTION_JSON, C.TABLE_PRODUCTION, _PCREQ, "date_prod",
    {"produit": S.js_trim("st.produit"), "quantite": "COALESCE(NULLIF(st.quantite, 0), 1)",
     "responsable": f"COALESCE({S.js_trim('st.responsable')}, '')",
     "date_prod": f"COALESCE(st.date_prod, DATE '{TODAY}')", "cout": "COALESCE(st.cout, 0)",
     "statut": "COALESCE(NULLIF(st.statut, ''), 'En cours')", "stock_id": "st.stock_id",
     "qte_consommee": "COALESCE(NULLIF(st.qte_consommee, 0), 0)"},
    f"{S.clean_text('st.produit')} IS NOT NULL"))
def _u2c(t: Tables):
    """U2 statement by statement."""
    asked = fixtures.statement_requests(fixtures.production_change_requests(t.production), "date_prod")
    return statements.production_statements(t.production, asked, TODAY, NOW)


@register("job_change_decisions", S.q(_PCREQ + f""" SELECT r.seq,
  CASE WHEN p.id IS NULL THEN 404 WHEN r.op = 'UPDATE' AND {S.clean_text('r.produit')} IS NULL THEN 400 ELSE 200 END AS code,
  CASE WHEN p.id IS NULL THEN '{statements.MSG_MISSING}' WHEN r.op = 'UPDATE' AND {S.clean_text('r.produit')} IS NULL
       THEN '{validate.MSG_PRODUIT_REQUIRED}' END AS reject_reason
FROM req r LEFT JOIN production p ON p.id = r.target_id"""))
def _m56(t: Tables):
    """M5, M6: the answer to each job change."""
    return statements.job_change_decisions(t.production, fixtures.production_change_requests(t.production))


def _deduction_audit_sql() -> str:
    old = S.json_of([(k, e if k != "quantite" else "rem + CASE WHEN accepted THEN qte ELSE 0 END", kind)
                     for k, e, kind in S.STOCK_JSON], "")
    new = S.json_of([(k, e if k != "quantite" else "rem", kind) for k, e, kind in S.STOCK_JSON], "")
    return S.q(S.M7_CTES + f""", d AS (SELECT f.req_id, f.stock_id, f.qte, f.accepted, f.rem, s.materiel, s.date_ajout,
  s.updated_by FROM fold f JOIN stock s ON s.id = f.stock_id WHERE f.accepted)
SELECT COALESCE(updated_by, '{C.SYSTEM_USER}') AS utilisateur, CAST(NULL AS VARCHAR) AS role_utilisateur,
  'UPDATE' AS action, '{C.TABLE_STOCK}' AS table_name, stock_id AS record_id, {old} AS ancienne_valeur,
  {new} AS nouvelle_valeur, CAST(NULL AS VARCHAR) AS details, CAST(NULL AS VARCHAR) AS ip_address,
  CAST(NULL AS VARCHAR) AS user_agent, TIMESTAMP '{NOW}' AS "timestamp", req_id FROM d""", recursive=True)


@register("deduction_audit", _deduction_audit_sql())
def _u1b(t: Tables):
    """U1 for a batch of deductions: one audit row per accepted request."""
    dec = ledger.consume_stock(_m7_requests(t), t.stock, levels=True)
    return audit.deduction_rows(dec, t.stock, NOW)


def _append_sql() -> str:
    ctes, select = _capture_parts("stock", S.STOCK_JSON, C.TABLE_STOCK)
    return S.q(ctes + f", cap AS ({select})\nSELECT *, CAST(\"timestamp\" AS DATE) AS audit_date FROM cap")


@register("audit_append", _append_sql())
def _k3(t: Tables):
    """K3: append the captured stock changes to a date-partitioned audit
    table in the shared folder, then read the table back."""
    root = t.store.root if t.store is not None else t.spark.sparkContext.getCheckpointDir()
    path = delete_at_exit(t.spark, f"{root}/audit-append-{uuid.uuid4().hex[:12]}") + "/t"
    entries = audit.capture_stock_changes(t.stock, fixtures.snapshot_after(t.stock), NOW)
    audit.audit_append(entries, path)
    return t.spark.read.parquet(path)


def _actions(t: Tables) -> DataFrame:
    r = fixtures.production_change_requests(t.production)
    return r.select(F.col("responsable").alias("utilisateur"), F.col("op").alias("action"),
                    F.lit(C.TABLE_PRODUCTION).alias("table_name"), F.col("target_id").alias("record_id"),
                    F.concat(F.lit("req "), F.col("seq").cast("string")).alias("details"),
                    X.ts_lit(NOW).alias("timestamp"))


@register("audit_entries", S.q(_PCREQ + f""" SELECT r.responsable AS utilisateur, u.role AS role_utilisateur,
  r.op AS action, '{C.TABLE_PRODUCTION}' AS table_name, r.target_id AS record_id,
  CAST(NULL AS VARCHAR) AS ancienne_valeur, CAST(NULL AS VARCHAR) AS nouvelle_valeur,
  'req ' || CAST(r.seq AS VARCHAR) AS details, CAST(NULL AS VARCHAR) AS ip_address,
  CAST(NULL AS VARCHAR) AS user_agent, TIMESTAMP '{NOW}' AS "timestamp"
  FROM req r LEFT JOIN users u ON r.responsable = u.username"""))
def _u3(t: Tables):
    return audit.audit_entries(_actions(t), t.users)


_CUTOFF = audit.retention_cutoff(AS_OF)


@register("audit_retention", S.q(f"SELECT * FROM audit WHERE \"timestamp\" >= TIMESTAMP '{_CUTOFF}'"))
def _u4(t: Tables):
    return audit_columns(audit.audit_retention(t.audit, AS_OF))


@register("audit_retention_count", S.q(f"SELECT COUNT(*) FILTER (WHERE \"timestamp\" < TIMESTAMP '{_CUTOFF}') AS supprimes FROM audit"))
def _u5(t: Tables):
    return audit.audit_retention_count(t.audit, AS_OF)


@register("permission_matrix", S.q(f""", m AS ({S.permission_values()}),
  r AS (SELECT role, COUNT(*) AS comptes FROM users WHERE actif GROUP BY role)
SELECT m.role, m.resource, m.action, COALESCE(r.comptes, 0) AS comptes FROM m LEFT JOIN r ON m.role = r.role"""))
def _x1(t: Tables):
    return access.permission_matrix(t.users)


_ACCESS = f""", m AS ({S.permission_values(C.ROUTE_PERMISSIONS)}),
lg AS (SELECT e.event_id, e.user_id, e.ts,
  {S.case('e.event_type', fixtures.EVENT_TO_RESOURCE)} AS resource,
  {S.case('e.event_type', fixtures.EVENT_TO_REQUEST_ACTION)} AS action, u.username, u.role
  FROM events e LEFT JOIN users u ON e.user_id = u.id),
az AS (SELECT lg.*, EXISTS (SELECT 1 FROM m WHERE m.role = lg.role AND m.resource = lg.resource
  AND m.action = lg.action) AS allowed FROM lg)"""


def _authorized(t: Tables) -> DataFrame:
    """X2 by what the routes check (the permission table is X1's)."""
    return access.authorize_requests(fixtures.access_log(t.raw("events"), t.users), C.ROUTE_PERMISSIONS)


@register("authorize_requests", S.q(_ACCESS + " SELECT * FROM az"))
def _x2(t: Tables):
    return _authorized(t)


@register("ownership_violations", S.q(_PREQ + """ SELECT r.req_id, r.req_user_id, u.username AS req_username,
  r.responsable FROM req r LEFT JOIN users u ON r.req_user_id = u.id
  WHERE u.role = 'responsable' AND r.responsable IS DISTINCT FROM u.username"""))
def _x3(t: Tables):
    return access.ownership_violations(_text_requests(t), t.users)


@register("denied_summary", S.q(_ACCESS + """ SELECT COALESCE(role, 'anonyme') AS role, action, COUNT(*) AS refus
  FROM az WHERE NOT allowed GROUP BY 1, 2"""))
def _x4(t: Tables):
    return access.denied_summary(_authorized(t))


# ---------------------------------------------------------------------------
# 2.12 Guards over the event log (batch twins of the streams)
# ---------------------------------------------------------------------------

def _win_sql(where: str, limit: int) -> str:
    return S.q(f"""SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS debut,
  time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS fin, COUNT(*) AS requetes,
  COUNT(*) > {limit} AS depasse, CAST(greatest(COUNT(*) - {limit}, 0) AS BIGINT) AS refusees
  FROM events {where} GROUP BY 1, 2, 3""")


@register("rate_limit_windows", _win_sql("", C.RATE_LIMIT))
def _r1(t: Tables):
    return guards.rate_limit_windows(fixtures.request_log(t.raw("events")))


_FAILS = ", ".join(f"'{e}'" for e in C.LOGIN_FAILURE_EVENTS)


@register("login_rate_windows", _win_sql(f"WHERE event_type IN ({_FAILS})", C.LOGIN_RATE_LIMIT))
def _r2(t: Tables):
    return guards.login_rate_windows(fixtures.login_attempts(t.raw("events")))


def _first_hit_sql(where: str, limit: int) -> str:
    return S.q(f""", h AS (SELECT user_id, ts FROM events {where}),
w AS (
  SELECT user_id, min(ts) AS debut FROM h GROUP BY user_id
  UNION ALL
  SELECT w.user_id, (SELECT min(h.ts) FROM h WHERE h.user_id IS NOT DISTINCT FROM w.user_id
                     AND h.ts >= w.debut + INTERVAL 24 HOUR) AS debut
  FROM w WHERE w.debut IS NOT NULL),
n AS (
  SELECT w.user_id, w.debut, count(*) AS requetes FROM w JOIN h ON h.user_id IS NOT DISTINCT FROM w.user_id
    AND h.ts >= w.debut AND h.ts < w.debut + INTERVAL 24 HOUR GROUP BY w.user_id, w.debut)
SELECT user_id, debut, debut + INTERVAL 24 HOUR AS fin, requetes, requetes > {limit} AS depasse,
  greatest(requetes - {limit}, 0) AS refusees FROM n""", recursive=True)


@register("rate_limit_first_hit", _first_hit_sql("", 2))
def _r1b(t: Tables):
    """R1 with windows from a client's first hit, a day wide, two hits allowed."""
    return guards.first_hit_windows(fixtures.request_log(t.raw("events")), "24 hours", 2)


@register("login_rate_first_hit", _first_hit_sql(f"WHERE event_type IN ({_FAILS})", 1))
def _r2b(t: Tables):
    failed = fixtures.login_attempts(t.raw("events")).where(~F.col("success"))
    return guards.first_hit_windows(failed, "24 hours", 1)


@register("login_lockout", S.q(S.lockout_ctes() + """ SELECT event_id, user_id, ts, success, outcome,
  CAST(cnt AS INTEGER) AS tentatives, until AS bloque_jusqu FROM lk
UNION ALL SELECT e.event_id, e.user_id, e.ts, e.event_type NOT IN (""" + _FAILS + """), 'INCONNU', 0, NULL
  FROM events e WHERE e.user_id IS NULL OR e.user_id NOT IN (SELECT id FROM users)""", recursive=True))
def _r3(t: Tables):
    return guards.login_lockout(fixtures.login_attempts(t.raw("events")), t.users)


@register("server_error_windows", S.q(f"""SELECT debut, debut + INTERVAL 15 MINUTE AS fin, requetes, erreurs,
  CAST(tot AS DECIMAL(20,2)) AS duree_totale,
  CAST(CAST((CAST(tot * 100 AS HUGEINT) * 20 + requetes) // (2 * requetes) AS DECIMAL(38,0)) * 0.001 AS DECIMAL(20,3))
    AS duree_moyenne
  FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS debut, COUNT(*) AS requetes,
    COUNT(*) FILTER (WHERE event_type = '{C.SERVER_ERROR_EVENT}') AS erreurs,
    SUM(CAST(value AS DECIMAL(18,2))) AS tot FROM events GROUP BY 1)"""))
def _r4(t: Tables):
    return guards.server_error_windows(fixtures.request_log(t.raw("events")))
