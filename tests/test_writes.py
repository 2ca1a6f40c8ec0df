"""Write path: refused rows, identity values, one audit row per deduction, retention,
two writers, and an input folder that changes."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from matflow.operators import audit, dashboard, figures, production, validate, writes
from matflow.sources import catalog, fixtures
from matflow.sources.catalog import audit_columns, fork_tables, open_tables, tables_at
from matflow.sources.store import MAX_BATCHES, ConcurrentCommit, SnapshotStore
from matflow.streaming import streams

TODAY, NOW = dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12)
REQUEST = "seq long, op string, target_id long, materiel string, quantite int, date_ajout date"


@pytest.fixture
def tables(spark):
    return fork_tables(open_tables(spark, SF_SMALL), streams.stream_root(spark))


def test_invalid_material_rows_are_refused(spark, tables):
    rows = [(1, "INSERT", None, "  ", -5, None), (2, "UPDATE", 3, "Fer", -3, None), (3, "INSERT", None, "Verre", 4, None),
            (4, "UPDATE", -9, "Fer", 3, None), (5, "DELETE", -9, None, None, None)]
    nxt = writes.apply_stock_requests(tables, spark.createDataFrame(rows, REQUEST), TODAY, NOW)
    assert {r.seq: r.code for r in nxt["decisions"].collect()} == {1: 400, 2: 400, 3: 201, 4: 404, 5: 404}
    assert nxt["stock"].where("quantite < 0 OR trim(materiel) = ''").count() == 0
    assert nxt["stock"].count() == tables.stock.count() + 1


def test_material_roles(spark, tables):
    users = tables.users.select("id", "role").collect()
    one = {r.role: r.id for r in users}
    rows = [(i, "DELETE", 5, None, None, None, u) for i, u in enumerate([one["admin"], one["chef_equipe"], -1])]
    rows.append((9, "INSERT", None, "Verre", 4, None, one["chef_equipe"]))
    req = spark.createDataFrame(rows, REQUEST + ", req_user_id long")
    assert {r.seq: r.code for r in writes.stock_decisions(tables, req).collect()} == {0: 200, 1: 403, 2: 403, 9: 201}


def test_identity_values_are_not_reused(spark, tables):
    top = tables.stock.agg(F.max("id")).first()[0]
    both = spark.createDataFrame([(1, "DELETE", top, None, None, None), (2, "INSERT", None, "Neuf", 1, None)], REQUEST)
    writes.commit_stock_requests(tables, both, TODAY, NOW)
    t1 = tables_at(spark, tables.store)
    assert t1.stock.agg(F.max("id")).first()[0] == top + 1
    new = audit_columns(t1.audit).where(F.col("timestamp") == F.lit(str(NOW)).cast("timestamp_ntz"))
    acts = {(r.record_id, r.action) for r in new.where("table_name = 'Stock'").collect()}
    assert acts == {(top, "DELETE"), (top + 1, "CREATE")}
    # deleted in one commit, inserted in a later one
    writes.commit_stock_requests(t1, spark.createDataFrame([(1, "DELETE", top + 1, None, None, None)], REQUEST), TODAY, NOW)
    t2 = tables_at(spark, tables.store)
    writes.commit_stock_requests(t2, spark.createDataFrame([(1, "INSERT", None, "Encore", 1, None)], REQUEST), TODAY, NOW)
    assert tables_at(spark, tables.store).stock.agg(F.max("id")).first()[0] == top + 2


def test_one_audit_row_per_deduction(spark, tables):
    admin = next(r.id for r in tables.users.where("role = 'admin'").limit(1).collect())
    s = tables.stock.where("quantite >= 10 AND id > 0").orderBy("id").first()
    rows = [(i, admin, "Dalle", "1", "x", None, "1", None, str(s.id), q)
            for i, q in enumerate(["2", "3", "1", "99999999", "99999999999"])]
    req = spark.createDataFrame(rows, "req_id long, req_user_id long, produit string, quantite string, responsable string, "
                                      "date_prod string, cout string, statut string, stock_id string, qte_consommee string")
    nxt = writes.apply_job_requests(tables, req, TODAY, NOW)
    new = nxt["audit_new"].orderBy("id").collect()
    levels = [(json.loads(r.ancienne_valeur)["quantite"], json.loads(r.nouvelle_valeur)["quantite"])
              for r in new if r.table_name == "Stock"]
    q = s.quantite
    assert levels == [(q, q - 2), (q - 2, q - 5), (q - 5, q - 6)]
    assert sum(r.action == "CREATE" for r in new) == 3
    code = {r.req_id: (r.code, r.stock_ok) for r in nxt["decisions"].collect()}
    assert code[3] == (201, False) and code[4] == (400, None)


def test_unchanged_update_is_logged(spark, tables):
    s = tables.stock.orderBy("id").first()
    req = spark.createDataFrame([(1, "UPDATE", s.id, s.materiel, s.quantite, s.date_ajout)], REQUEST)
    new = writes.apply_stock_requests(tables, req, TODAY, NOW)["audit_new"].collect()
    assert [(r.action, r.record_id) for r in new] == [("UPDATE", s.id)]


def test_job_changes_and_retention(spark, tables):
    req = fixtures.production_change_requests(tables.production)
    n, gone = tables.production.count(), tables.production.where("id % 10 = 0").count()
    writes.commit_job_changes(tables, req, TODAY, NOW)
    t1 = tables_at(spark, tables.store)
    assert t1.production.count() == n - gone
    assert t1.production.where("trim(produit) = ''").count() == 0
    as_of = dt.datetime(2025, 1, 15)
    writes.commit_retention(t1, as_of)
    left = tables_at(spark, tables.store).audit
    assert left.count() < t1.audit.count()
    assert left.where(F.col("timestamp") < F.lit(str(as_of - dt.timedelta(days=366))).cast("timestamp_ntz")).count() == 0


def _batch_bytes(store, table, tag):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{store.root}/{table}/batch={tag}")
               for f in names if f.endswith(".parquet"))


def test_retention_drops_days_and_writes_one(spark, tables):
    """The rows of U4, with the limit's day alone written; later commits and a full list of
    batches keep what was dropped out."""
    days = [r.audit_date for r in tables.audit.select("audit_date").distinct().orderBy("audit_date").collect()]
    noon = dt.datetime.combine(days[len(days) // 2], dt.time(12))
    as_of = noon + dt.timedelta(days=365)
    want = sorted(tuple(r) for r in audit_columns(audit.audit_retention(tables.audit, as_of)).collect())
    # two rows of the day itself: one goes, one stays
    one = audit_columns(tables.audit).limit(1)
    edge = [one.withColumns({"id": F.lit(10**6 + i).cast("long"),
                             "timestamp": F.lit(str(noon + dt.timedelta(hours=i))).cast("timestamp_ntz")}) for i in (-1, 1)]
    tables.store.commit({}, append={"audit": edge[0].unionByName(edge[1])}, keep=["stock", "production", "users"],
                        head=tables.head)
    writes.commit_retention(tables_at(spark, tables.store), as_of)
    t1 = tables_at(spark, tables.store)
    got = sorted(tuple(r) for r in audit_columns(t1.audit).where("id <> 1000001").collect())
    assert got == want and t1.audit.where("id >= 1000000").count() == 1
    tags = t1.head[3]["audit"]
    assert len(tags) == 3 and set(t1.head[5]["audit"]) == set(tags[:2])
    folder = f"{t1.store.root}/audit/batch={tags[-1]}"
    assert {d for d in os.listdir(folder) if d.startswith("audit_date")} <= {f"audit_date={noon.date()}"}
    assert _batch_bytes(t1.store, "audit", tags[-1]) < _batch_bytes(t1.store, "audit", tags[0]) / 2
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    scan = tables_at(spark, t1.store).audit._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "audit_date" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    # a later limit, a commit that appends, and a rewrite of all batches as one
    later = as_of + dt.timedelta(days=30)
    want = sorted(tuple(r) for r in audit_columns(audit.audit_retention(t1.audit, later)).collect())
    writes.commit_retention(t1, later)
    t2 = tables_at(spark, tables.store)
    assert sorted(tuple(r) for r in audit_columns(t2.audit).collect()) == want


def test_retention_survives_the_rewrite_of_batches(spark, tables, monkeypatch):
    from matflow.sources import store as module
    monkeypatch.setattr(module, "MAX_BATCHES", 2)
    top = tables.audit.agg(F.max("timestamp")).first()[0]
    for back in (200, 150, 100, 50):
        t = tables_at(spark, tables.store)
        as_of = top - dt.timedelta(days=back) + dt.timedelta(days=365)
        want = audit.audit_retention(t.audit, as_of).count()
        writes.commit_retention(t, as_of)
        t = tables_at(spark, tables.store)
        assert t.audit.count() == want and len(t.head[3]["audit"]) <= 2
        assert set(t.head[5].get("audit", {})) <= set(t.head[3]["audit"])


def _same_figures(t):
    """The stored sums, and all figures from them, against the whole tables."""
    assert figures.TABLE in t.head[3]
    stored = {tuple(r) for r in t.figures().collect()}
    assert stored == {tuple(r) for r in figures.partial_sums(t.stock, t.production).collect()}
    pairs = [(figures.dashboard_kpis, dashboard.dashboard_kpis(t.stock, t.production)),
             (figures.production_by_status, production.production_by_status(t.production)),
             (figures.production_by_month, production.production_by_month(t.production)),
             (figures.stock_report_kpis, dashboard.stock_report_kpis(t.stock)),
             (figures.production_report_kpis, dashboard.production_report_kpis(t.production)),
             (figures.stats_kpis, dashboard.stats_kpis(t.stock, t.production))]
    for made, whole in pairs:
        got = made(t.figures())
        assert got.schema.simpleString() == whole.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_figures_follow_every_commit(spark, tables):
    _same_figures(tables)
    s = tables.stock.orderBy("id").limit(3).collect()
    material = spark.createDataFrame(
        [(1, "UPDATE", s[0].id, "Fer", 3, None), (2, "UPDATE", s[0].id, "Fer", 40, None), (3, "DELETE", s[1].id, None, None, None),
         (4, "INSERT", None, "Verre", 4, None), (5, "INSERT", None, " ", 4, None), (6, "DELETE", -9, None, None, None)], REQUEST)
    writes.commit_stock_requests(tables, material, TODAY, NOW)
    t1 = tables_at(spark, tables.store)
    _same_figures(t1)
    writes.commit_job_requests(t1, fixtures.production_text_requests(t1.production, tables.raw("orders")), TODAY, NOW)
    t2 = tables_at(spark, tables.store)
    _same_figures(t2)
    writes.commit_job_changes(t2, fixtures.production_change_requests(t2.production), TODAY, NOW)
    t3 = tables_at(spark, tables.store)
    _same_figures(t3)
    writes.commit_retention(t3, dt.datetime(2025, 1, 15))
    _same_figures(tables_at(spark, tables.store))


def test_figures_of_missing_values_and_empty_tables(spark, seed):
    rows = [(None, None, None, None), (None, dt.date(2024, 2, 3), "x", 5), (2, dt.date(9999, 12, 31), "Critique", 7)]
    jobs = spark.createDataFrame(rows, "quantite int, date_prod date, statut string, c int").withColumn(
        "cout", F.col("c").cast("decimal(12,2)"))
    material = spark.createDataFrame([(None,), (3,), (49,), (50,)], "quantite int")
    sums = figures.partial_sums(material, jobs)
    got = {(r.part, r.cle): (r.n, r.unites, int(r.cout)) for r in sums.collect()}
    assert got == {("bande", None): (1, 0, 0), ("bande", "CRITIQUE"): (1, 3, 0), ("bande", "FAIBLE"): (1, 49, 0),
                   ("bande", "OK"): (1, 50, 0), ("statut", None): (1, 0, 0), ("statut", "x"): (1, 0, 5),
                   ("statut", "Critique"): (1, 2, 7), ("mois", None): (1, 0, 0), ("mois", "2024/2"): (1, 0, 5),
                   ("mois", "9999/12"): (1, 2, 7)}
    assert figures.change(sums, (material, material.limit(0)), (jobs, jobs.limit(0))).count() == 0
    empty = figures.partial_sums(material.limit(0), jobs.limit(0))
    assert figures.dashboard_kpis(empty).first()[:3] == (0, 0, 0)
    assert figures.stats_kpis(empty).first().cout_moyen == 0
    assert figures.production_by_month(sums).first().annee == 9999


def test_kept_figures_read_no_table(tables):
    plan = figures.dashboard_kpis(tables.figures())._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "figures" in scans[0]


def test_broken_rules_stop_the_commit(spark, tables):
    bad = tables.stock.withColumn("quantite", F.lit(-1))
    with pytest.raises(ValueError):
        writes._gate(tables, stock=(tables.stock, bad))


def _whole(before, after):
    """What each rule gains over whole tables: the plain check."""
    def count(stock, production, users):
        return {(r.table_name, r.rule): r.violations
                for r in validate.constraint_violations(stock, production, users).collect()}
    old, new = count(*before), count(*after)
    return {k: new[k] - old[k] for k in new if k[0] != "Utilisateurs"}


def test_the_rules_of_a_change_equal_those_of_whole_tables(tables):
    s, p, u = tables.stock.where("id <= 12"), tables.production.where("id <= 60"), tables.users
    # rules already broken before: a job of no material, a negative amount
    s = s.withColumn("quantite", F.when(F.col("id") == 3, F.lit(-4)).otherwise(F.col("quantite"))).checkpoint()
    p = p.withColumn("stock_id", F.when(F.col("id") % 5 == 0, F.lit(900)).when(F.col("id") % 5 < 4, F.col("id") % 12 + 1)
                     .cast("long")).checkpoint()
    negative = s.where("id IN (3, 4, 5)").withColumn("quantite", F.col("id").cast("int") - 5)
    new = s.where("id = 1").withColumn("id", F.lit(900).cast("long"))
    broken = p.where("id < 9").withColumns({"quantite": F.lit(0), "statut": F.lit("x"), "stock_id": F.col("id") + 6})
    cases = [((s.where("id IN (3, 4, 5)"), negative), None),                       # an update
             ((s.where("id IN (2, 7)"), s.limit(0)), None),                         # a delete that leaves its jobs
             ((s.limit(0), new), None),                                             # a row that jobs waited for
             (None, (p.where("id < 9"), broken)),                                   # jobs updated
             (None, (p.where("id > 20"), p.limit(0))),                              # and deleted
             ((s.where("id IN (1, 2, 3, 4, 5)"), negative.unionByName(new)), (p.where("id < 9"), broken))]
    for stock, jobs in cases:
        def after(table, change):
            return table if change is None else table.join(change[0], "id", "left_anti").unionByName(change[1])
        want = _whole((s, p, u), (after(s, stock), after(p, jobs), u))
        got = {(r.table_name, r.rule): r.after - r.before
               for r in validate.changed_violations(s, p, stock, jobs).collect()}
        assert all(want[k] == v for k, v in got.items())
        assert all(k in got for k, v in want.items() if v)
        assert any(want.values())


def test_the_gate_of_jobs_reads_no_whole_table(tables):
    """Changed jobs: of the tables only the materials' ids are read."""
    jobs = tables.production.where("id < 5").checkpoint()
    df = validate.changed_violations(tables.stock, tables.production, None, (jobs, jobs))
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "ReadSchema: struct<id:bigint>" in scans[0]


def test_second_writer_fails(spark, seed):
    store = SnapshotStore(spark, streams.stream_root(spark))
    store.commit({"stock": seed["stock"]})
    head = store.head()
    store.commit({"stock": seed["stock"].where("id > 1")}, head=head)
    with pytest.raises(ConcurrentCommit):
        store.commit({"stock": seed["stock"].where("id > 2")}, head=head)
    assert store.read("stock").count() == 4


def test_batches_of_a_version_are_bounded(spark, seed, monkeypatch):
    from matflow.sources import store as module
    monkeypatch.setattr(module, "MAX_BATCHES", 3)
    assert MAX_BATCHES > 3
    store = SnapshotStore(spark, streams.stream_root(spark))
    store.commit({"users": seed["users"]})
    for i in range(5):
        store.commit({}, append={"users": seed["users"].limit(1).withColumn("id", F.lit(10 + i).cast("long"))})
        assert len(store.head()[3]["users"]) <= 3
    assert store.read("users").count() == 9


def test_changed_input_is_read_again(spark):
    """A new file below the input folder gives a new snapshot."""
    root = streams.stream_root(spark)
    names = [f[:-8] for f in os.listdir(SF_SMALL) if f.endswith(".parquet")]
    for n in ("part", "orders", "customer", "lineitem", "events"):
        assert n in names
        spark.read.parquet(f"{SF_SMALL}/{n}.parquet").write.parquet(f"{root}/{n}.parquet")
    before = open_tables(spark, root)
    n = before.stock.count()
    extra = spark.read.parquet(f"{root}/part.parquet").limit(1).withColumn("p_partkey", F.lit(10**6).cast("long"))
    extra.write.mode("append").parquet(f"{root}/part.parquet")
    assert open_tables(spark, root).stock.count() == n + 1
    assert catalog._fingerprint(spark, root) == catalog._fingerprint(spark, root)
