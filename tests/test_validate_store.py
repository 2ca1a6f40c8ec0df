"""Validation rules (V1-V3) on hand-made requests, and snapshot versions."""
import datetime as dt
from decimal import Decimal

import pytest

from matflow.operators import validate
from matflow.sources.store import SnapshotStore
from matflow.streaming import streams


def test_stock_request_rules(spark):
    r = spark.createDataFrame([(1, "Ciment", "12"), (2, "  ", "12abc"), (3, "Sable", "-1"),
                               (4, "Eau", "0"), (5, "Gravier", "007"), (6, None, None)],
                              "req_id long, materiel string, quantite string")
    out = {x.req_id: (x.accepted, x.n_errors) for x in validate.validate_stock_requests(r).collect()}
    assert out == {1: (True, 0), 2: (False, 2), 3: (False, 1), 4: (True, 0), 5: (False, 1), 6: (False, 2)}


def test_production_request_first_rule_wins(spark, seed):
    rows = [  # req_id, user, produit, quantite, responsable, date, cout, statut, stock, qte
        (1, 1, "Dalle", "5", "admin", None, "10", None, "1", "3"),          # ok (admin)
        (2, 4, "Dalle", "5", "lecteur", None, "10", None, None, None),      # role denied
        (3, 2, "Dalle", "5", "admin", None, "10", None, None, None),        # responsable, not own
        (4, 3, " ", "5", "x", None, None, None, None, None),                # product missing
        (5, 3, "P", "0", "x", None, None, None, None, None),                # quantity < 1
        (6, 3, "P", "abc", "x", None, None, None, None, None),              # not a number
        (7, 3, "P", "2", "  ", None, None, None, None, None),               # owner missing
        (8, 3, "P", "2", "x", None, None, "Annulé", None, None),            # statut invalid
        (9, 3, "P", "12abc", "x", "2024-05-02", "7.5", "", "0", "4"),       # ok, lenient
    ]
    r = spark.createDataFrame(rows, "req_id long, req_user_id long, produit string, quantite string, "
                                    "responsable string, date_prod string, cout string, statut string, "
                                    "stock_id string, qte_consommee string")
    v = {x.req_id: (x.code, x.reject_reason) for x in validate.validate_production_requests(r, seed["users"]).collect()}
    assert v[1] == (201, None) and v[9] == (201, None)
    assert v[2][0] == 403 and v[3] == (403, validate.MSG_OWN_ONLY)
    assert v[4][1] == validate.MSG_PRODUIT_REQUIRED and v[5][1] == validate.MSG_QUANTITE_MIN1
    assert v[6][1] == validate.MSG_QUANTITE_MIN1 and v[7][1] == validate.MSG_RESPONSABLE_REQUIRED
    assert v[8][1] == validate.MSG_STATUT_INVALID
    d = {x.req_id: x for x in validate.production_defaults(r, dt.date(2024, 6, 1)).collect()}
    assert d[9].quantite == 12 and d[9].cout == Decimal("7.50") and d[9].statut == "En cours"
    assert d[9].stock_id is None and d[9].qte_consommee == 0 and d[9].date_prod == dt.date(2024, 5, 2)
    assert d[1].stock_id == 1 and d[1].qte_consommee == 3 and d[1].date_prod == dt.date(2024, 6, 1)


def test_store_versions(spark, seed):
    root = streams.stream_root(spark)
    st = SnapshotStore(spark, root)
    assert st.head() is None
    v0 = st.commit({"stock": seed["stock"]})
    v1 = st.commit({"stock": seed["stock"].where("id > 2")})
    assert (v0, v1) == (0, 1)
    assert st.read("stock").count() == 3
    h = st.head()
    assert h[0] == 1 and h[2] == ["stock"]


def test_authorize_with_either_matrix(spark):
    from matflow import constants as C
    from matflow.operators import access
    log = spark.createDataFrame(
        [(1, "chef_equipe", "stock", "CREATE"), (2, "lecteur", "production", "DELETE"),
         (3, "admin", "users", "DELETE"), (4, None, "stock", "READ")],
        "event_id long, role string, resource string, action string")
    table = {r.event_id: r.allowed for r in access.authorize_requests(log).collect()}
    routes = {r.event_id: r.allowed for r in access.authorize_requests(log, C.ROUTE_PERMISSIONS).collect()}
    assert table == {1: False, 2: False, 3: True, 4: False}
    assert routes == {1: True, 2: True, 3: False, 4: False}
    d = {(r.role, r.action): r.refus for r in access.denied_summary(access.authorize_requests(log)).collect()}
    assert d == {("chef_equipe", "CREATE"): 1, ("lecteur", "DELETE"): 1, ("anonyme", "READ"): 1}


def test_lazy_tables_give_the_same_rows(spark):
    """Without the store (materialize=False) the tables are plans over the
    raw input and give the same rows."""
    from conftest import SF_SMALL
    from matflow.sources.catalog import audit_columns, open_tables
    a, b = open_tables(spark, SF_SMALL), open_tables(spark, SF_SMALL, materialize=False)
    for name in ("stock", "production", "users"):
        assert sorted(map(tuple, getattr(a, name).collect())) == sorted(map(tuple, getattr(b, name).collect()))
    assert sorted(map(tuple, audit_columns(a.audit).collect())) == sorted(map(tuple, b.audit.collect()))


def test_job_batch_commit(spark):
    """The write path as one batch: V2 -> V3 -> M7 -> M4 + M8 -> U1/U2,
    committed as the next version of a forked store."""
    import datetime as dt
    from pyspark.sql import functions as F
    from conftest import SF_SMALL
    from matflow.operators import writes
    from matflow.sources import fixtures
    from matflow.sources.catalog import audit_columns, fork_tables, open_tables, tables_at
    base = open_tables(spark, SF_SMALL)
    t = fork_tables(base, streams.stream_root(spark))
    reqs = fixtures.production_text_requests(t.production, t.raw("orders")).withColumn(
        "req_id", F.col("req_id") + 1_000_000)
    today, now = dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12)
    nxt = writes.apply_job_requests(t, reqs, today, now)
    d = nxt["decisions"]
    n_ok = d.where("code = 201 AND (stock_ok OR stock_ok IS NULL)").count()
    assert d.count() == reqs.count()
    assert nxt["production"].count() == t.production.count() + n_ok
    assert nxt["stock"].where("quantite < 0").count() == 0
    batch = nxt["audit"].where(F.col("timestamp") == F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))
    assert batch.where("action = 'CREATE' AND table_name = 'Production'").count() == n_ok
    assert batch.where("table_name = 'Production' AND action <> 'CREATE'").count() == 0
    assert nxt["audit"].count() == audit_columns(t.audit).count() + batch.count()
    assert nxt["audit"].select("id").distinct().count() == nxt["audit"].count()
    v = writes.commit_job_requests(t, reqs, today, now)
    t2 = tables_at(spark, t.store)
    assert v == 1 and t2.production.count() == nxt["production"].count()
    assert audit_columns(t2.audit).count() == nxt["audit"].count()
    # the shared snapshot is unchanged
    assert open_tables(spark, SF_SMALL).production.count() == base.production.count()


def test_stock_batch_commit(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from conftest import SF_SMALL
    from matflow.operators import changes, writes
    from matflow.sources import fixtures
    from matflow.sources.catalog import fork_tables, open_tables, tables_at
    t = fork_tables(open_tables(spark, SF_SMALL), streams.stream_root(spark))
    req = fixtures.stock_change_requests(t.stock)
    today, now = dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12)
    nxt = writes.apply_stock_requests(t, req, today, now)
    dele = changes.requests_existing(req.where("op = 'DELETE'"), t.stock)
    ins = req.where("op = 'INSERT'").count()
    assert nxt["stock"].count() == t.stock.count() - dele.count() + ins
    detached = t.production.join(dele.select(F.col("target_id").alias("stock_id")), "stock_id", "left_semi").count()
    batch = nxt["audit"].where(F.col("timestamp") == F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))
    got = {(r.table_name, r.action): r.n for r in batch.groupBy("table_name", "action").agg(F.count("*").alias("n")).collect()}
    assert got[("Production", "UPDATE")] == detached and got[("Stock", "CREATE")] == ins
    assert got[("Stock", "DELETE")] == dele.count()
    assert nxt["missing"].count() == req.where("op = 'UPDATE' AND target_id < 0").count()
    assert writes.commit_stock_requests(t, req, today, now) == 1
    assert tables_at(spark, t.store).stock.count() == nxt["stock"].count()


def test_a_query_derives_only_the_tables_it_reads(spark):
    """stock_list runs where only ``part`` is there, production_csv without events."""
    from conftest import SF_SMALL
    from matflow.plans.registry import QUERIES
    from matflow.sources.catalog import open_tables, store_for
    root = streams.stream_root(spark) + "/in"
    copy = lambda n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet").write.parquet(f"{root}/{n}.parquet")
    copy("part")
    whole = open_tables(spark, SF_SMALL)
    assert QUERIES["stock_list"](spark, root).count() == whole.stock.count()
    assert store_for(spark, root).head()[2] == ["stock"]
    for n in ("orders", "customer", "lineitem"):
        copy(n)
    assert QUERIES["production_csv"](spark, root).count() == whole.production.count()
    assert store_for(spark, root).head()[2] == ["production", "stock"]


def test_tables_of_changed_input_are_not_mixed(spark):
    from conftest import SF_SMALL
    from matflow.sources.catalog import open_tables
    root = streams.stream_root(spark) + "/in"
    for n in ("part", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{n}.parquet").write.parquet(f"{root}/{n}.parquet")
    t = open_tables(spark, root, on_use=True)
    n = t.stock.count()
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.mode("append").parquet(f"{root}/customer.parquet")
    with pytest.raises(RuntimeError, match="has changed"):
        t.users
    assert t.stock.count() == n and open_tables(spark, root, on_use=True).users.count() > 0


def test_lead_line_reads_the_columns_that_decide(spark):
    from matflow.sources.fixtures import lead_lines
    rows = [(1, 2, 7, 1, 5.0, "b"), (1, 2, 7, 1, 4.0, "a"), (1, 1, 9, 2, 3.0, "a"), (1, 1, 9, 1, 8.0, "z"),
            (1, 1, 9, 1, 6.0, "z"), (2, None, None, 3, 1.0, "a"), (2, 1, 4, 3, 2.0, "a"), (None, 1, 5, 5, None, "a")]
    path = streams.stream_root(spark) + "/lines"
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                                "l_quantity double, l_returnflag string").write.parquet(path)
    lead = lead_lines(spark.read.parquet(path))
    assert {tuple(r) for r in lead.collect()} == {(1, 9, 6.0), (2, None, 1.0), (None, 5, None)}
    assert "l_returnflag" not in lead._jdf.queryExecution().executedPlan().toString()
