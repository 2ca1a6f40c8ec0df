"""Domain tables and request streams derived from the driver's parquet tables.

The mapping is the one of FIXTURES.md section 4. Every function is a pure
DataFrame transformation, so its work grows with the input tables and Catalyst
prunes the columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.exprs import lookup


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Domain tables
# ---------------------------------------------------------------------------

def stock_from_part(part: DataFrame) -> DataFrame:
    date_ajout = F.date_add(F.lit(C.FIXTURE_DATE_ORIGIN).cast("date"),
                            (F.col("p_partkey") % 365).cast("int"))
    return schemas.conform(part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("materiel"),
        F.col("p_size").alias("quantite"),
        date_ajout.alias("date_ajout"),
        date_ajout.cast("timestamp_ntz").alias("created_at"),
        F.lit(None).alias("updated_at"),
        F.lit(None).alias("updated_by"),
    ), schemas.STOCK)


# tie-break order of the lead line of an order, as far as its result: lines that agree in
# these columns give the same row, so the later ones need not be read, sorted and shuffled
LEAD_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def lead_lines(lineitem: DataFrame) -> DataFrame:
    """Smallest line of each order by the full column tuple (its first four decide).

    ``min(struct)`` aggregates partially on the map side, so at most one row per
    order and map partition crosses the shuffle; a hot order is pre-reduced.
    """
    return (lineitem.groupBy("l_orderkey")
            .agg(F.min(F.struct(*LEAD_LINE_ORDER)).alias("lead"))
            .select("l_orderkey",
                    F.col("lead.l_partkey").alias("l_partkey"),
                    F.col("lead.l_quantity").alias("l_quantity")))


def production_from_orders(orders: DataFrame, customer: DataFrame,
                           lineitem: DataFrame, part: DataFrame) -> DataFrame:
    lead = lead_lines(lineitem)
    # the aggregate is hash-partitioned on l_orderkey: joining on it reuses that
    # partitioning, so only `orders` is shuffled for this join
    o = orders.join(lead, orders.o_orderkey == lead.l_orderkey, "left")
    o = o.join(part.select("p_partkey", "p_type"), o.l_partkey == F.col("p_partkey"), "left")
    o = o.join(customer.select("c_custkey", "c_name"), o.o_custkey == F.col("c_custkey"), "left")
    return schemas.conform(o.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(F.col("p_type"), F.lit("NONE")).alias("produit"),
        F.coalesce(F.col("l_quantity").cast("int"), F.lit(1)).alias("quantite"),
        F.col("c_name").alias("responsable"),
        F.to_date("o_orderdate").alias("date_prod"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("cout"),
        lookup(F.col("o_orderpriority"), C.PRIORITY_TO_STATUT).alias("statut"),
        F.col("l_partkey").alias("stock_id"),
        F.coalesce(F.col("l_quantity").cast("int"), F.lit(0)).alias("qte_consommee"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).alias("updated_at"),
        F.lit(None).alias("updated_by"),
    ), schemas.PRODUCTION)


def users_from_customer(customer: DataFrame) -> DataFrame:
    return schemas.conform(customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        lookup(F.col("c_mktsegment"), C.SEGMENT_TO_ROLE, C.DEFAULT_ROLE).alias("role"),
        F.lit(0).alias("tentatives"),
        F.lit(None).alias("bloque_jusqu"),
        F.lit(None).alias("created_at"),
        F.lit(None).alias("last_login"),
        (F.col("c_acctbal") >= 0).alias("actif"),
    ), schemas.USERS)


def audit_from_events(events: DataFrame, customer: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.withColumn("_k", k)
    e = e.join(customer.select("c_custkey", "c_name"), e.user_id == F.col("c_custkey"), "left")
    return schemas.conform(e.select(
        F.col("event_id").alias("id"),
        F.coalesce(F.col("c_name"), F.concat(F.lit("user"), F.col("user_id").cast("string")))
        .alias("utilisateur"),
        F.lit(None).alias("role_utilisateur"),
        lookup(F.col("event_type"), C.EVENT_TO_ACTION).alias("action"),
        F.when(F.col("_k") % 2 == 0, F.lit(C.TABLE_STOCK))
        .otherwise(F.lit(C.TABLE_PRODUCTION)).alias("table_name"),
        F.col("_k").alias("record_id"),
        F.lit(None).alias("ancienne_valeur"),
        F.col("props").alias("nouvelle_valeur"),
        F.lit(None).alias("details"),
        F.lit(None).alias("ip_address"),
        F.lit(None).alias("user_agent"),
        F.col("ts").alias("timestamp"),
    ), schemas.AUDIT)


def derive_tables(spark: SparkSession, sf_dir: str,
                  names=("stock", "production", "audit", "users")) -> dict[str, DataFrame]:
    r = lambda n: read_raw(spark, sf_dir, n)
    tables = {
        "stock": lambda: stock_from_part(r("part")),
        "production": lambda: production_from_orders(r("orders"), r("customer"), r("lineitem"), r("part")),
        "audit": lambda: audit_from_events(r("events"), r("customer")),
        "users": lambda: users_from_customer(r("customer")),
    }
    return {name: tables[name]() for name in names}


# ---------------------------------------------------------------------------
# Request streams (inputs of the change, validation and guard operators)
# ---------------------------------------------------------------------------

def snapshot_after(before: DataFrame, bump: str = "quantite") -> DataFrame:
    """The "after" side of a snapshot pair: ids % 10 = 0 deleted, = 1 with
    ``bump`` + 1, = 2 copied to -id (no driver table has negative ids)."""
    kept = (before.where(F.col("id") % 10 != 0)
            .withColumn(bump, F.when(F.col("id") % 10 == 1, F.col(bump) + 1)
                        .otherwise(F.col(bump))))
    new = (before.where(F.col("id") % 10 == 2)
           .withColumn("id", -F.col("id")))
    return kept.unionByName(new)


def stock_change_requests(stock: DataFrame) -> DataFrame:
    """Change requests on materials, one per material with id % 10 < 4:
    0 DELETE, 1 UPDATE (quantite + 1), 2 INSERT (a copy), 3 UPDATE of a
    missing id (-id). ``seq`` is the arrival order."""
    m = F.col("id") % 10
    op = (F.when(m == 0, F.lit("DELETE")).when(m == 1, F.lit("UPDATE"))
          .when(m == 2, F.lit("INSERT")).when(m == 3, F.lit("UPDATE")))
    target = F.when(m == 3, -F.col("id")).when(m == 2, F.lit(None).cast("long")) \
        .otherwise(F.col("id"))
    return (stock.where(m < 4).select(
        F.col("id").alias("seq"),
        op.alias("op"),
        target.alias("target_id"),
        F.col("materiel"),
        (F.col("quantite") + F.when(m == 1, 1).otherwise(0)).alias("quantite"),
        F.col("date_ajout"),
    ))


def production_change_requests(production: DataFrame) -> DataFrame:
    """Same scheme for jobs: 0 DELETE, 1 UPDATE (quantite + 1, statut Terminé),
    3 UPDATE of a missing id. Every hundredth (id % 100 = 21) has a blank product."""
    m = F.col("id") % 10
    op = F.when(m == 0, F.lit("DELETE")).when(m.isin(1, 3), F.lit("UPDATE"))
    target = F.when(m == 3, -F.col("id")).otherwise(F.col("id"))
    return (production.where(m.isin(0, 1, 3)).select(
        F.col("id").alias("seq"), op.alias("op"), target.alias("target_id"),
        F.when(F.col("id") % 100 == 21, F.lit(BAD_PRODUIT)).otherwise(F.col("produit")).alias("produit"),
        (F.col("quantite") + 1).alias("quantite"), "responsable", "date_prod",
        "cout", F.lit(C.FINISHED_STATUT).alias("statut"), "stock_id", "qte_consommee"))


def statement_requests(requests: DataFrame, date: str) -> DataFrame:
    """Runs of statements from change requests: an UPDATE becomes three (quantite + 1, 2
    and 3, the second without ``date``), a DELETE the same three, the DELETE and
    one UPDATE too late. ``seq`` is ten times the request's, plus the place."""
    deletes = F.col("op") == "DELETE"
    runs = (requests.where(F.col("op") != "INSERT")
            .withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(deletes, 5).otherwise(3)))))
    return runs.withColumns({
        "seq": F.col("seq") * 10 + F.col("_k"), "quantite": F.col("quantite") + F.col("_k"),
        "op": F.when(deletes & (F.col("_k") == 4), F.lit("DELETE")).otherwise(F.lit("UPDATE")),
        date: F.when(F.col("_k") != 2, F.col(date))}).drop("_k")


# eight request variants by o_orderkey % 8 (FIXTURES.md, "requests with bad text")
BAD_PRODUIT = "   "
BAD_STATUT = "Annulé"


# a number that fits no column
HUGE = "99999999999"


def production_text_requests(production: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Raw text requests to create jobs, as a form would send them, one per job.

    By id % 8: 0 blank product, 1 quantity '12abc', 2 'abc', 3 '0', 4 '',
    5 negative, 6 unknown statut, 7 valid. ``req_user_id`` is the requesting
    account: the owner itself when ``id div 8`` is even, else the next
    customer id (someone else, or no account). Every third request has no
    date, every fifth a non-numeric cost, every sixteenth (id % 16 = 7) no statut.
    By id % 64 a number is out of its column's range: 23 cost, 39 material, 55
    amount, 63 quantity. Without ``orders`` the requester is left out (null) and
    nothing is joined.
    """
    if orders is None:
        p = production.withColumn("o_custkey", F.lit(None).cast("long"))
    else:
        o = orders.select(F.col("o_orderkey").alias("_ok"), "o_custkey")
        p = production.join(o, production.id == o._ok)
    m, m64 = F.col("id") % 8, F.col("id") % 64
    q = F.col("quantite").cast("string")
    quantite = (F.when(m == 1, F.lit("12abc")).when(m == 2, F.lit("abc"))
                .when(m == 3, F.lit("0")).when(m == 4, F.lit(""))
                .when(m == 5, F.concat(F.lit("-"), q)).when(m64 == 63, F.lit(HUGE)).otherwise(q))
    return p.select(
        F.col("id").alias("req_id"),
        (F.col("o_custkey") + F.floor(F.col("id") / 8) % 2).cast("long").alias("req_user_id"),
        F.when(m == 0, F.lit(BAD_PRODUIT)).otherwise(F.col("produit")).alias("produit"),
        quantite.alias("quantite"),
        F.col("responsable"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format("date_prod", "yyyy-MM-dd")).alias("date_prod"),
        F.when(F.col("id") % 5 == 0, F.lit("n/a")).when(m64 == 23, F.lit(HUGE + ".5"))
        .otherwise(F.col("cout").cast("string")).alias("cout"),
        F.when(m == 6, F.lit(BAD_STATUT)).when(F.col("id") % 16 == 7, F.lit(None).cast("string"))
        .otherwise(F.col("statut")).alias("statut"),
        F.when(m64 == 39, F.lit(HUGE)).otherwise(F.col("stock_id").cast("string")).alias("stock_id"),
        F.when(m64 == 55, F.lit(HUGE)).otherwise(F.col("qte_consommee").cast("string")).alias("qte_consommee"),
    )


def stock_text_requests(stock: DataFrame) -> DataFrame:
    """Raw text requests to create materials: by id % 8, 0 blank name,
    1 '12abc', 2 'abc', 3 '0', 4 '', 5 negative, 6 and 7 valid, but out of range
    where id % 32 is 6 (11 digits) or 7 (20 digits)."""
    m = F.col("id") % 8
    q = F.col("quantite").cast("string")
    quantite = (F.when(m == 1, F.lit("12abc")).when(m == 2, F.lit("abc"))
                .when(m == 3, F.lit("0")).when(m == 4, F.lit(""))
                .when(m == 5, F.concat(F.lit("-"), q)).when(F.col("id") % 32 == 6, F.lit(HUGE))
                .when(F.col("id") % 32 == 7, F.lit("12345678901234567890")).otherwise(q))
    return stock.select(
        F.col("id").alias("req_id"),
        F.when(m == 0, F.lit("  ")).otherwise(F.col("materiel")).alias("materiel"),
        quantite.alias("quantite"),
    )


def login_attempts(events: DataFrame) -> DataFrame:
    """Log-in tries: error, view and click fail; purchase and signup succeed."""
    return events.select(
        "event_id", "user_id", "ts",
        (~F.col("event_type").isin(*C.LOGIN_FAILURE_EVENTS)).alias("success"))


def request_log(events: DataFrame) -> DataFrame:
    """HTTP request log: error = server error (5xx), value = duration in ms."""
    return events.select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == C.SERVER_ERROR_EVENT, F.lit(500))
        .otherwise(F.lit(200)).alias("status"),
        F.col("value").alias("duration_ms"))


# resource and action of each request of the access log (derived from events)
EVENT_TO_RESOURCE = {"signup": "users", "purchase": "production", "error": "stock",
                     "click": "stats", "view": "stock"}
EVENT_TO_REQUEST_ACTION = {"signup": "CREATE", "purchase": "CREATE", "error": "DELETE",
                           "click": "READ", "view": "UPDATE"}


def access_log(events: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the caller's role (null for an unknown account)."""
    e = events.select(
        "event_id", "user_id", "ts",
        lookup(F.col("event_type"), EVENT_TO_RESOURCE).alias("resource"),
        lookup(F.col("event_type"), EVENT_TO_REQUEST_ACTION).alias("action"))
    return e.join(users.select(F.col("id").alias("_uid"), "username", "role"),
                  e.user_id == F.col("_uid"), "left").drop("_uid")
