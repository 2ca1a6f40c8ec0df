"""Golden results on the seed rows, worked out by hand (FIXTURES.md 2)."""
from decimal import Decimal

from pyspark.sql import functions as F

from matflow.operators import access, dashboard, production, stock


def test_dashboard_kpis(seed):
    r = dashboard.dashboard_kpis(seed["stock"], seed["production"]).first()
    assert (r.total_materiaux, r.total_unites, r.total_productions) == (5, 253, 4)
    assert r.cout_total == Decimal("33400.00")
    assert (r.alertes_stock, r.alertes_prod) == (2, 1)


def test_states(seed):
    st = {r.etat: r.n for r in stock.stock_state(seed["stock"]).groupBy("etat")
          .agg(F.count("*").alias("n")).collect()}
    assert st == {"CRITIQUE": 2, "FAIBLE": 1, "OK": 2}


def test_stats_mean_cost(seed):
    r = dashboard.stats_kpis(seed["stock"], seed["production"]).first()
    assert r.cout_moyen == Decimal("8350.00") and r.materiaux == 5 and r.terminees == 1


def test_status_share(seed):
    rows = production.status_share(seed["production"]).collect()
    assert len(rows) == 4 and all(r.pct == 25 and r.nombre == 1 for r in rows)


def test_months(seed):
    rows = [(r.annee, r.mois, r.total) for r in production.production_by_month(seed["production"]).collect()]
    assert rows == [(2024, 3, 1), (2024, 2, 3)]


def test_users_per_role(seed):
    rows = access.users_by_role(seed["users"]).collect()
    assert len(rows) == 4 and all(r.nombre_utilisateurs == 1 and r.actifs == 1 for r in rows)


def test_alert_lists(seed):
    a = [r.materiel for r in stock.stock_alerts(seed["stock"]).collect()]
    assert a == ["Eau", "Sable"]
    p = [r.produit for r in production.production_alerts(seed["production"]).collect()]
    assert p == ["Parpaing 20x20"]


def test_top_and_recent(seed):
    top = stock.top_stock(seed["stock"], 2).collect()
    assert [(r.materiel, r.couleur) for r in top] == [("Ciment", "bleu"), ("Gravier", "bleu")]
    rec = production.recent_production(seed["production"], seed["stock"], 2).collect()
    assert [(r.produit, r.materiel_nom) for r in rec] == [("Hourdis", "Sable"), ("Parpaing 20x20", "Ciment")]


def test_fill_pct(seed):
    rows = {r.materiel: (r.pct, r.level) for r in stock.stock_fill_pct(seed["stock"]).collect()}
    assert rows["Ciment"] == (60, "high") and rows["Sable"] == (4, "low") and rows["Fer à béton"] == (23, "medium")


def test_report_kpis(seed):
    r = dashboard.production_report_kpis(seed["production"]).first()
    assert (r.total, r.termines, r.critiques, r.qte_totale) == (4, 1, 1, 900)
    s = dashboard.stock_report_kpis(seed["stock"]).first()
    assert (s.total, s.critiques, s.faibles, s.total_unites) == (5, 2, 1, 253)


def test_bundle(seed):
    b = dashboard.dashboard_bundle(seed["stock"], seed["production"])
    row = b["summary"].first()
    assert row.kpis.total_unites == 253
    assert [x.materiel for x in row.stockChart][:2] == ["Ciment", "Gravier"]
    assert [x.produit for x in row.recent][0] == "Hourdis"
    assert b["alertesStock"].count() == 2 and b["alertesProd"].count() == 1


def test_search_words(seed):
    from matflow.operators import search
    assert search.global_search(seed["stock"], seed["production"], "  ").count() == 0
    c = {r.source: r.hits for r in search.global_search_counts(seed["stock"], seed["production"], "").collect()}
    assert c == {"stock": 0, "production": 0}
    # "sable" hits the material, the job that uses it (by material name) and
    # the job owned by "responsable" (by owner)
    hits = sorted((r.source, r.id) for r in search.global_search(seed["stock"], seed["production"], "SaBle").collect())
    assert hits == [("production", 2), ("production", 4), ("stock", 2)]
    # LIKE keeps % and _ as wildcards, the literal filter does not
    assert stock.stock_search(seed["stock"], "c_m").count() == 1
    assert stock.stock_contains(seed["stock"], "c_m").count() == 0


def test_labels_defaults(spark, seed):
    from matflow import constants as C
    jobs = seed["production"].unionByName(seed["production"].limit(1).withColumn("statut", F.lit("Inconnu")))
    classes = {r.statut: r.classe for r in production.status_labels(jobs).collect()}
    assert classes["Terminé"] == "s-termine" and classes["Inconnu"] == ""
    users = seed["users"].unionByName(seed["users"].limit(1).withColumn("role", F.lit("invite")))
    labels = {r.role: r.libelle for r in access.role_labels(users).collect()}
    assert labels["chef_equipe"] == "Chef d'équipe" and labels["invite"] == C.ROLE_LABEL_DEFAULT


def test_constraint_violations_found(spark, seed):
    from matflow.operators import validate
    bad_stock = seed["stock"].unionByName(seed["stock"].limit(1).withColumn("id", F.lit(9).cast("long"))
                                          .withColumn("quantite", F.lit(-3)))
    bad_jobs = seed["production"].unionByName(
        seed["production"].limit(1).withColumn("id", F.lit(9).cast("long"))
        .withColumn("stock_id", F.lit(77).cast("long")).withColumn("statut", F.lit("Annulé"))
        .withColumn("quantite", F.lit(0)))
    bad_users = seed["users"].unionByName(seed["users"].limit(1).withColumn("id", F.lit(9).cast("long")))
    v = {(r.table_name, r.rule): r.violations
         for r in validate.constraint_violations(bad_stock, bad_jobs, bad_users).collect()}
    assert v[("Stock", "quantite_negative")] == 1
    assert v[("Production", "stock_id_missing")] == 1 and v[("Production", "statut_invalid")] == 1
    assert v[("Production", "quantite_not_positive")] == 1
    assert v[("Utilisateurs", "username_duplicate")] == 2
    assert sum(v.values()) == 6
    clean = validate.constraint_violations(seed["stock"], seed["production"], seed["users"]).collect()
    assert all(r.violations == 0 for r in clean)
