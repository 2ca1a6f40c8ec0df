"""Dashboard and report figures: A1, A6-A8, A10, K4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import div_half_up
from . import figures
from . import production as P
from . import stock as S


def _both(stock: DataFrame, production: DataFrame) -> DataFrame:
    """Materials and jobs stacked into one narrow relation (tagged by ``_src``),
    so one aggregate covers both tables: one scan of each, no join."""
    s = stock.select(F.lit("s").alias("_src"), F.col("quantite").cast("long").alias("_q"),
                     F.lit(None).cast("decimal(12,2)").alias("_cout"),
                     F.lit(None).cast("string").alias("_statut"))
    p = production.select(F.lit("p").alias("_src"), F.col("quantite").cast("long").alias("_q"),
                          F.col("cout").alias("_cout"), F.col("statut").alias("_statut"))
    return s.unionByName(p)


def dashboard_kpis(stock: DataFrame, production: DataFrame) -> DataFrame:
    """A1: materials, units, jobs, cost, stock alerts, job alerts (one row)."""
    is_s, is_p = F.col("_src") == "s", F.col("_src") == "p"
    return _both(stock, production).agg(
        F.count_if(is_s).alias("total_materiaux"),
        F.coalesce(F.sum(F.when(is_s, F.col("_q"))), F.lit(0)).cast("long").alias("total_unites"),
        F.count_if(is_p).alias("total_productions"),
        F.coalesce(F.sum(F.when(is_p, F.col("_cout"))), F.lit(0)).cast("decimal(22,2)").alias("cout_total"),
        F.count_if(is_s & (F.col("_q") < C.CRITICAL_STOCK)).alias("alertes_stock"),
        F.count_if(is_p & F.col("_statut").isin(*C.ALERT_STATUTS)).alias("alertes_prod"),
    )


def stock_report_kpis(stock: DataFrame) -> DataFrame:
    """Total, critical, low, total units of the stock report."""
    q = F.col("quantite")
    return stock.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(q < C.CRITICAL_STOCK).alias("critiques"),
        F.count_if((q >= C.CRITICAL_STOCK) & (q < C.LOW_STOCK)).alias("faibles"),
        F.coalesce(F.sum(q), F.lit(0)).cast("long").alias("total_unites"))


def production_report_kpis(production: DataFrame) -> DataFrame:
    """Total, finished, alerts, cost sum, quantity sum of the job report."""
    return production.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("statut") == C.FINISHED_STATUT).alias("termines"),
        F.count_if(F.col("statut").isin(*C.ALERT_STATUTS)).alias("critiques"),
        F.coalesce(F.sum("cout"), F.lit(0)).cast("decimal(22,2)").alias("cout_total"),
        F.coalesce(F.sum("quantite"), F.lit(0)).cast("long").alias("qte_totale"))


def stats_kpis(stock: DataFrame, production: DataFrame) -> DataFrame:
    """Materials, finished jobs, mean cost (0 without jobs), total cost."""
    is_s, is_p = F.col("_src") == "s", F.col("_src") == "p"
    a = _both(stock, production).agg(
        F.count_if(is_s).alias("materiaux"),
        F.count_if(is_p & (F.col("_statut") == C.FINISHED_STATUT)).alias("terminees"),
        F.count_if(is_p).alias("_n"),
        F.coalesce(F.sum(F.when(is_p, F.col("_cout"))), F.lit(0)).cast("decimal(22,2)").alias("cout_total"))
    mean = F.when(F.col("_n") > 0, div_half_up(F.col("cout_total"), F.col("_n"), 2).cast("decimal(22,2)")) \
        .otherwise(F.lit(0).cast("decimal(22,2)"))
    return a.select("materiaux", "terminees", mean.alias("cout_moyen"), "cout_total")


def alert_summary(stock: DataFrame, production: DataFrame) -> DataFrame:
    """A10: both alert counts, their total and the has-alert flags."""
    k = dashboard_kpis(stock, production)
    tot = F.col("alertes_stock") + F.col("alertes_prod")
    return k.select("alertes_stock", "alertes_prod", tot.alias("total_alertes"),
                    (tot > 0).alias("cloche"), (F.col("alertes_stock") > 0).alias("badge_stock"),
                    (F.col("alertes_prod") > 0).alias("badge_prod"))


def dashboard_bundle(stock: DataFrame, production: DataFrame,
                     sums: DataFrame | None = None) -> dict[str, DataFrame]:
    """K4: the dashboard payload; with ``sums`` (``operators.figures``) its figures and the
    chart per statut come from them and read no table.

    ``summary`` is one row holding the four bounded parts (kpis, top-10 stock
    chart, per-statut chart, 5 recent jobs) as nested columns. The parts are
    stacked into one relation and folded by a single aggregate (no join); each
    part is a one-row aggregate or a top-k, so the lists are bounded. The two
    alert lists grow with the data and stay distributed DataFrames.
    """
    kpis = dashboard_kpis(stock, production) if sums is None else figures.dashboard_kpis(sums)
    chart = S.top_stock(stock, 10)
    statuts = P.production_by_status(production) if sums is None else figures.production_by_status(sums)
    recent = P.recent_production(production, stock, 5)
    parts = {
        "kpis": kpis.select(F.struct(*kpis.columns).alias("v")),
        "stockChart": chart.select(F.struct(
            F.struct((-F.col("quantite")).alias("a"), F.col("id").alias("b")).alias("k"),
            F.struct("materiel", "quantite", "couleur", "id").alias("v")).alias("v")),
        "prodChart": statuts.select(F.struct(
            F.struct(F.col("statut").alias("a")).alias("k"),
            F.struct("statut", "nombre").alias("v")).alias("v")),
        "recent": recent.select(F.struct(
            F.struct(F.col("date_prod").alias("a"), F.col("id").alias("b")).alias("k"),
            F.struct("produit", "quantite", "responsable", "date_prod", "cout", "statut",
                     "materiel_nom", "id").alias("v")).alias("v")),
    }
    types = {n: df.schema["v"].dataType for n, df in parts.items()}
    stacked = None
    for name, df in parts.items():
        cols = [(F.col("v") if n == name else F.lit(None).cast(types[n])).alias(n) for n in parts]
        d = df.select(*cols)
        stacked = d if stacked is None else stacked.unionByName(d)

    def ordered(name: str, desc: bool):
        return F.transform(F.sort_array(F.collect_list(name), asc=not desc), lambda x: x["v"])

    summary = stacked.agg(
        F.first("kpis", ignorenulls=True).alias("kpis"),
        ordered("stockChart", False).alias("stockChart"),
        ordered("prodChart", False).alias("prodChart"),
        ordered("recent", True).alias("recent"))
    return {
        "summary": summary,
        "alertesStock": stock.where(F.col("quantite") < C.CRITICAL_STOCK)
        .select("id", "materiel", "quantite").orderBy("quantite", "id"),
        "alertesProd": production.where(F.col("statut").isin(*C.ALERT_STATUTS))
        .select("id", "produit", "statut", "responsable").orderBy(F.desc("date_prod"), F.desc("id")),
    }


def dashboard_summary_flat(stock: DataFrame, production: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """K4 checked as rows: all six parts, one row per item. The four bounded parts
    come from one explode of the one-row record (which is computed once); the two
    alert lists stay distributed, their order given by the items (``pos`` null)."""
    b = dashboard_bundle(stock, production, sums)
    lists = [F.transform(F.col(n), lambda x, i: F.struct(i.alias("pos"), F.to_json(x).alias("item")))
             for n in ("stockChart", "prodChart", "recent")]
    tagged = [F.transform(c, _tag(n)) for n, c in zip(("stockChart", "prodChart", "recent"), lists)]
    head = F.array(F.struct(F.lit("kpis").alias("part"), F.lit(0).alias("pos"), F.to_json("kpis").alias("item")))
    out = b["summary"].select(F.inline(F.concat(head, *tagged)))
    for name in ("alertesStock", "alertesProd"):
        rows = b[name]
        out = out.unionByName(rows.select(F.lit(name).alias("part"), F.lit(None).cast("int").alias("pos"),
                                          F.to_json(F.struct(*rows.columns)).alias("item")))
    return out


def _tag(name: str):
    return lambda x: F.struct(F.lit(name).alias("part"), x["pos"].alias("pos"), x["item"].alias("item"))
