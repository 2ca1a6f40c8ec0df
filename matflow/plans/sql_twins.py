"""DuckDB SQL twins of the fixture mapping and of the request streams.

The oracle of every registered query starts from the driver's raw tables
(region ... conversations are views in the checking engine) and rebuilds the
four domain tables with the same mapping as ``sources.fixtures``; the query
body then runs on top. Nothing here runs on Spark.
"""

from __future__ import annotations

from .. import constants as C


def case(col: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    d = "NULL" if default is None else f"'{default}'"
    return f"CASE {whens} ELSE {d} END"


LEAD_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
              "l_tax, l_returnflag, l_linestatus, l_shipdate")

BASE_CTES = f"""
stock AS (
  SELECT p_partkey AS id, p_name AS materiel, p_size AS quantite,
         CAST(DATE '{C.FIXTURE_DATE_ORIGIN}' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS date_ajout,
         CAST(CAST(DATE '{C.FIXTURE_DATE_ORIGIN}' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS TIMESTAMP) AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS updated_by
  FROM part),
lead_line AS (
  SELECT l_orderkey, l_partkey, l_quantity FROM (
    SELECT l_orderkey, l_partkey, l_quantity,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY {LEAD_ORDER}) AS rn
    FROM lineitem) WHERE rn = 1),
production AS (
  SELECT o.o_orderkey AS id, COALESCE(pt.p_type, 'NONE') AS produit,
         COALESCE(CAST(l.l_quantity AS INTEGER), 1) AS quantite,
         c.c_name AS responsable, CAST(o.o_orderdate AS DATE) AS date_prod,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS cout,
         {case('o.o_orderpriority', C.PRIORITY_TO_STATUT)} AS statut,
         l.l_partkey AS stock_id, COALESCE(CAST(l.l_quantity AS INTEGER), 0) AS qte_consommee,
         o.o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
         CAST(NULL AS VARCHAR) AS updated_by
  FROM orders o LEFT JOIN lead_line l ON o.o_orderkey = l.l_orderkey
  LEFT JOIN part pt ON l.l_partkey = pt.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
users AS (
  SELECT c_custkey AS id, c_name AS username,
         {case('c_mktsegment', C.SEGMENT_TO_ROLE, C.DEFAULT_ROLE)} AS role,
         CAST(0 AS INTEGER) AS tentatives, CAST(NULL AS BIGINT) AS bloque_jusqu,
         CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_login,
         c_acctbal >= 0 AS actif
  FROM customer),
audit AS (
  SELECT e.event_id AS id, COALESCE(c.c_name, 'user' || CAST(e.user_id AS VARCHAR)) AS utilisateur,
         CAST(NULL AS VARCHAR) AS role_utilisateur,
         {case('e.event_type', C.EVENT_TO_ACTION)} AS action,
         CASE WHEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 2 = 0
              THEN '{C.TABLE_STOCK}' ELSE '{C.TABLE_PRODUCTION}' END AS table_name,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS record_id,
         CAST(NULL AS VARCHAR) AS ancienne_valeur, e.props AS nouvelle_valeur,
         CAST(NULL AS VARCHAR) AS details, CAST(NULL AS VARCHAR) AS ip_address,
         CAST(NULL AS VARCHAR) AS user_agent, e.ts AS "timestamp"
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey)"""


def q(body: str, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <domain tables> <body>``; ``body`` is either a
    SELECT or more CTEs starting with a comma."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {BASE_CTES}\n{body}"


# --- expressions shared by several oracles --------------------------------

WS = r"[ \t\n\r\f\x0b\x{00a0}\x{feff}]"


def etat(col: str = "quantite") -> str:
    return (f"CASE WHEN {col} < {C.CRITICAL_STOCK} THEN '{C.STATE_CRITICAL}' "
            f"WHEN {col} < {C.LOW_STOCK} THEN '{C.STATE_LOW}' ELSE '{C.STATE_OK}' END")


def fr_date(col: str) -> str:
    return f"COALESCE(strftime({col}, '%d/%m/%Y'), '{C.MISSING_TEXT}')"


def fr_money(col: str, decimals: int = 2) -> str:
    num = col if decimals == 2 else f"round({col}, 0)"
    return (f"COALESCE(translate(format('{{:,.{decimals}f}}', {num}), ',.', '{C.FR_GROUP}{C.FR_DECIMAL}') "
            f"|| ' {C.CURRENCY}', '{C.MISSING_TEXT}')")


def parse_int(col: str) -> str:
    return f"TRY_CAST(regexp_extract({col}, '^{WS}*([+-]?[0-9]+)', 1) AS INTEGER)"


def int_text(col: str) -> str:
    return f"regexp_extract({col}, '^{WS}*([+-]?[0-9]+)', 1)"


def int_overflow(col: str) -> str:
    return f"(COALESCE({int_text(col)}, '') <> '' AND {parse_int(col)} IS NULL)"


def lenient_int(col: str, default: str) -> str:
    return f"CASE WHEN NOT {int_overflow(col)} THEN COALESCE(NULLIF({parse_int(col)}, 0), {default}) END"


def lenient_decimal(col: str) -> str:
    return (f"CASE WHEN COALESCE({decimal_text(col)}, '') = '' THEN CAST(0 AS DECIMAL(12,2)) "
            f"ELSE TRY_CAST({decimal_text(col)} AS DECIMAL(12,2)) END")


def decimal_text(col: str) -> str:
    pat = f"^{WS}*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)"
    return f"regexp_extract({col}, '{pat}', 1)"


def decimal_overflow(col: str) -> str:
    return f"({lenient_decimal(col)} IS NULL)"


def js_trim(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def clean_text(col: str) -> str:
    return f"NULLIF({js_trim(col)}, '')"


def json_obj(fields: list[tuple[str, str, str]]) -> str:
    """JSON object text, null fields left out. fields: (key, expr, kind) with
    kind in str / num / date."""
    parts = []
    for k, e, kind in fields:
        if kind == "str":
            v = f"CAST(to_json({e}) AS VARCHAR)"
        elif kind == "date":
            v = f"'\"' || strftime({e}, '%Y-%m-%d') || '\"'"
        else:
            v = f"CAST({e} AS VARCHAR)"
        parts.append(f"CASE WHEN {e} IS NULL THEN NULL ELSE '\"{k}\":' || {v} END")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


STOCK_JSON = [("materiel", "{p}materiel", "str"), ("quantite", "{p}quantite", "num"),
              ("date_ajout", "{p}date_ajout", "date")]
PRODUCTION_JSON = [("produit", "{p}produit", "str"), ("quantite", "{p}quantite", "num"),
                   ("responsable", "{p}responsable", "str"), ("date_prod", "{p}date_prod", "date"),
                   ("cout", "{p}cout", "num"), ("statut", "{p}statut", "str"),
                   ("stock_id", "{p}stock_id", "num"), ("qte_consommee", "{p}qte_consommee", "num")]


def json_of(spec, prefix: str) -> str:
    return json_obj([(k, e.format(p=prefix), kind) for k, e, kind in spec])


# --- request streams (twins of sources.fixtures) ---------------------------

def snapshot_after_sql(table: str) -> str:
    return (f"SELECT * REPLACE (CASE WHEN id % 10 = 1 THEN quantite + 1 ELSE quantite END AS quantite) "
            f"FROM {table} WHERE id % 10 <> 0 "
            f"UNION ALL SELECT * REPLACE (-id AS id) FROM {table} WHERE id % 10 = 2")


STOCK_CHANGE_REQUESTS = """
  SELECT id AS seq,
         CASE id % 10 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'UPDATE' END AS op,
         CASE WHEN id % 10 = 3 THEN -id WHEN id % 10 = 2 THEN NULL ELSE id END AS target_id,
         materiel, quantite + CASE WHEN id % 10 = 1 THEN 1 ELSE 0 END AS quantite, date_ajout
  FROM stock WHERE id % 10 < 4"""

PRODUCTION_CHANGE_REQUESTS = f"""
  SELECT id AS seq,
         CASE WHEN id % 10 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op,
         CASE WHEN id % 10 = 3 THEN -id ELSE id END AS target_id,
         CASE WHEN id % 100 = 21 THEN '   ' ELSE produit END AS produit,
         quantite + 1 AS quantite, responsable, date_prod, cout,
         '{C.FINISHED_STATUT}' AS statut, stock_id, qte_consommee
  FROM production WHERE id % 10 IN (0, 1, 3)"""

PRODUCTION_TEXT_REQUESTS = """
  SELECT p.id AS req_id, CAST(o.o_custkey + (p.id // 8) % 2 AS BIGINT) AS req_user_id,
         CASE WHEN p.id % 8 = 0 THEN '   ' ELSE p.produit END AS produit,
         CASE p.id % 8 WHEN 1 THEN '12abc' WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN ''
              WHEN 5 THEN '-' || CAST(p.quantite AS VARCHAR)
              WHEN 7 THEN CASE WHEN p.id % 64 = 63 THEN '99999999999' ELSE CAST(p.quantite AS VARCHAR) END ELSE CAST(p.quantite AS VARCHAR) END AS quantite,
         p.responsable,
         CASE WHEN p.id % 3 = 0 THEN NULL ELSE strftime(p.date_prod, '%Y-%m-%d') END AS date_prod,
         CASE WHEN p.id % 5 = 0 THEN 'n/a' WHEN p.id % 64 = 23 THEN '99999999999.5'
              ELSE CAST(p.cout AS VARCHAR) END AS cout,
         CASE WHEN p.id % 8 = 6 THEN 'Annulé' WHEN p.id % 16 = 7 THEN NULL ELSE p.statut END AS statut,
         CASE WHEN p.id % 64 = 39 THEN '99999999999' ELSE CAST(p.stock_id AS VARCHAR) END AS stock_id,
         CASE WHEN p.id % 64 = 55 THEN '99999999999' ELSE CAST(p.qte_consommee AS VARCHAR) END AS qte_consommee
  FROM production p JOIN orders o ON p.id = o.o_orderkey"""

STOCK_TEXT_REQUESTS = """
  SELECT id AS req_id, CASE WHEN id % 8 = 0 THEN '  ' ELSE materiel END AS materiel,
         CASE id % 8 WHEN 1 THEN '12abc' WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN ''
              WHEN 5 THEN '-' || CAST(quantite AS VARCHAR)
              WHEN 6 THEN CASE WHEN id % 32 = 6 THEN '99999999999' ELSE CAST(quantite AS VARCHAR) END
              WHEN 7 THEN CASE WHEN id % 32 = 7 THEN '12345678901234567890' ELSE CAST(quantite AS VARCHAR) END
              ELSE CAST(quantite AS VARCHAR) END AS quantite
  FROM stock"""


def greedy_fold_ctes(want: str) -> str:
    """Recursive greedy deduction over ``want`` (req_id, stock_id, qte,
    opening, rn = arrival rank within stock_id)."""
    return f""", want AS ({want}),
fold AS (
  SELECT stock_id, rn, req_id, qte, opening >= qte AS accepted,
         CASE WHEN opening >= qte THEN opening - qte ELSE opening END AS rem
  FROM want WHERE rn = 1
  UNION ALL
  SELECT w.stock_id, w.rn, w.req_id, w.qte, f.rem >= w.qte,
         CASE WHEN f.rem >= w.qte THEN f.rem - w.qte ELSE f.rem END
  FROM fold f JOIN want w ON w.stock_id = f.stock_id AND w.rn = f.rn + 1)"""


# M7 on the jobs in (date_prod, id) order: the full decision table "m7"
M7_CTES = """, req AS (
  SELECT p.id AS req_id, p.stock_id, CAST(p.qte_consommee AS BIGINT) AS qte, p.date_prod,
         CAST(s.quantite AS BIGINT) AS opening, s.id AS sid
  FROM production p LEFT JOIN stock s ON p.stock_id = s.id)""" + greedy_fold_ctes(
    "SELECT req_id, stock_id, qte, opening, row_number() OVER (PARTITION BY stock_id "
    "ORDER BY date_prod, req_id) AS rn FROM req WHERE sid IS NOT NULL AND qte > 0") + """,
m7 AS (
  SELECT req_id, stock_id, qte, accepted,
         CASE WHEN NOT accepted THEN 'stock_insuffisant' END AS motif FROM fold
  UNION ALL
  SELECT req_id, stock_id, qte, (sid IS NOT NULL OR stock_id IS NULL) AS accepted,
         CASE WHEN stock_id IS NOT NULL AND sid IS NULL THEN 'materiau_inconnu' END AS motif
  FROM req WHERE NOT (sid IS NOT NULL AND qte > 0))"""


def lockout_ctes(max_failures: int = C.MAX_FAILURES, lock_minutes: int = C.LOCK_MINUTES) -> str:
    fails = ", ".join(f"'{e}'" for e in C.LOGIN_FAILURE_EVENTS)
    lock = f"INTERVAL {lock_minutes} MINUTE"
    return f""", att AS (
  SELECT event_id, user_id, ts, event_type NOT IN ({fails}) AS success,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         u.tentatives AS c0, CAST(make_timestamp(u.bloque_jusqu * 1000) AS TIMESTAMP) AS u0
  FROM events JOIN users u ON u.id = user_id),
lk AS (
  SELECT user_id, rn, event_id, ts, success,
         CASE WHEN u0 IS NOT NULL AND ts < u0 THEN 'REFUSE'
              WHEN success THEN 'OK' WHEN c0 + 1 >= {max_failures} THEN 'BLOQUE' ELSE 'ECHEC' END AS outcome,
         CASE WHEN u0 IS NOT NULL AND ts < u0 THEN c0
              WHEN success OR c0 + 1 >= {max_failures} THEN 0 ELSE c0 + 1 END AS cnt,
         CASE WHEN u0 IS NOT NULL AND ts < u0 THEN u0 WHEN success THEN NULL
              WHEN c0 + 1 >= {max_failures} THEN ts + {lock} ELSE u0 END AS until
  FROM att WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.event_id, a.ts, a.success,
         CASE WHEN l.until IS NOT NULL AND a.ts < l.until THEN 'REFUSE'
              WHEN a.success THEN 'OK' WHEN l.cnt + 1 >= {max_failures} THEN 'BLOQUE' ELSE 'ECHEC' END,
         CASE WHEN l.until IS NOT NULL AND a.ts < l.until THEN l.cnt
              WHEN a.success THEN 0 WHEN l.cnt + 1 >= {max_failures} THEN 0 ELSE l.cnt + 1 END,
         CASE WHEN l.until IS NOT NULL AND a.ts < l.until THEN l.until
              WHEN a.success THEN NULL WHEN l.cnt + 1 >= {max_failures} THEN a.ts + {lock}
              ELSE l.until END
  FROM lk l JOIN att a ON a.user_id = l.user_id AND a.rn = l.rn + 1)"""


def permission_values(matrix: dict = C.PERMISSIONS) -> str:
    rows = [f"('{r}', '{res}', '{a}')" for r, d in matrix.items()
            for res, acts in d.items() for a in acts]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS m(role, resource, action)"
