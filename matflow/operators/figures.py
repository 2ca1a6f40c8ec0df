"""Dashboard figures kept current: A1, A2, A4-A8 and K4's figures from stored partial sums.

A partial sum is a row per (part, group): stock bands, job statuts and job months.
All figures of the dashboard and the reports are sums over these rows, and sums
can be changed by what a batch changes: ``change`` subtracts the rows before it and
adds those after it. The table has as many rows as there are bands, statuts and
months, whatever the number of materials and jobs, so a commit reads its own rows and
this table, and a dashboard reads this table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import div_half_up

TABLE = "figures"
BAND, STATUT, MONTH = "bande", "statut", "mois"
MONEY = "decimal(32,2)"


def _signed(n: int):
    return (F.sum(F.lit(n).cast("long")).alias("n"),
            (F.coalesce(F.sum("_q"), F.lit(0)) * n).cast("long").alias("unites"),
            (F.coalesce(F.sum("_c"), F.lit(0)) * n).cast(MONEY).alias("cout"))


def partial_sums(stock: DataFrame | None, production: DataFrame | None, sign: int = 1) -> DataFrame:
    """(part, cle, n, unites, cout) of the tables' rows, negated with ``sign`` -1. Rows
    without quantity, statut or date count in groups of their own. One pass of the jobs."""
    out = []
    if stock is not None:
        q = F.col("quantite")
        band = (F.when(q < C.CRITICAL_STOCK, C.STATE_CRITICAL).when(q < C.LOW_STOCK, C.STATE_LOW)
                .when(q.isNotNull(), C.STATE_OK))
        out.append(stock.select(F.lit(BAND).alias("part"), band.alias("cle"), q.cast("long").alias("_q"),
                                F.lit(None).cast("decimal(12,2)").alias("_c")))
    if production is not None:
        both = F.array(F.struct(F.lit(STATUT).alias("part"), F.col("statut").alias("cle")),
                       F.struct(F.lit(MONTH).alias("part"),
                                F.concat(F.year("date_prod"), F.lit("/"), F.month("date_prod")).alias("cle")))
        out.append(production.select(F.explode(both).alias("_k"), F.col("quantite").cast("long").alias("_q"),
                                     F.col("cout").alias("_c")).select("_k.part", "_k.cle", "_q", "_c"))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return rows.groupBy("part", "cle").agg(*_signed(sign))


def merged(*parts: DataFrame) -> DataFrame:
    """Partial sums added up; groups without rows left go."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (rows.groupBy("part", "cle")
            .agg(F.sum("n").cast("long").alias("n"), F.sum("unites").cast("long").alias("unites"),
                 F.sum("cout").cast(MONEY).alias("cout"))
            .where("n <> 0"))


def change(figures: DataFrame, stock: tuple[DataFrame, DataFrame] | None = None,
           production: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``figures`` after a change, given the changed rows before and after it."""
    parts = [figures]
    for side, sign in ((0, -1), (1, 1)):
        s, p = (stock[side] if stock else None), (production[side] if production else None)
        if s is not None or p is not None:
            parts.append(partial_sums(s, p, sign))
    return merged(*parts)


def _sum(name: str, when, kind: str):
    return F.coalesce(F.sum(F.when(when, F.col(name))), F.lit(0)).cast(kind)


def _rows(part: str, *keys: str):
    """The rows of a part, or of some of its groups."""
    there = F.col("part") == part
    return there & F.col("cle").isin(*keys) if keys else there


def dashboard_kpis(figures: DataFrame) -> DataFrame:
    """A1 from the figures."""
    return figures.agg(_sum("n", _rows(BAND), "long").alias("total_materiaux"),
                       _sum("unites", _rows(BAND), "long").alias("total_unites"),
                       _sum("n", _rows(STATUT), "long").alias("total_productions"),
                       _sum("cout", _rows(STATUT), "decimal(22,2)").alias("cout_total"),
                       _sum("n", _rows(BAND, C.STATE_CRITICAL), "long").alias("alertes_stock"),
                       _sum("n", _rows(STATUT, *C.ALERT_STATUTS), "long").alias("alertes_prod"))


def production_by_status(figures: DataFrame) -> DataFrame:
    """A2 from the figures."""
    return figures.where(_rows(STATUT)).select(F.col("cle").alias("statut"), F.col("n").alias("nombre"))


def production_by_month(figures: DataFrame) -> DataFrame:
    """A4 from the figures."""
    return (figures.where(F.col("part") == MONTH)
            .select(F.split("cle", "/")[0].cast("int").alias("annee"), F.split("cle", "/")[1].cast("int").alias("mois"),
                    F.col("n").alias("total"))
            .orderBy(F.desc("annee"), F.desc("mois")))


def stock_report_kpis(figures: DataFrame) -> DataFrame:
    """A6 from the figures."""
    return figures.agg(_sum("n", _rows(BAND), "long").alias("total"),
                       _sum("n", _rows(BAND, C.STATE_CRITICAL), "long").alias("critiques"),
                       _sum("n", _rows(BAND, C.STATE_LOW), "long").alias("faibles"),
                       _sum("unites", _rows(BAND), "long").alias("total_unites"))


def production_report_kpis(figures: DataFrame) -> DataFrame:
    """A7 (and A5, its total) from the figures."""
    return figures.agg(_sum("n", _rows(STATUT), "long").alias("total"),
                       _sum("n", _rows(STATUT, C.FINISHED_STATUT), "long").alias("termines"),
                       _sum("n", _rows(STATUT, *C.ALERT_STATUTS), "long").alias("critiques"),
                       _sum("cout", _rows(STATUT), "decimal(22,2)").alias("cout_total"),
                       _sum("unites", _rows(STATUT), "long").alias("qte_totale"))


def stats_kpis(figures: DataFrame) -> DataFrame:
    """A8 from the figures."""
    a = figures.agg(_sum("n", _rows(BAND), "long").alias("materiaux"),
                    _sum("n", _rows(STATUT, C.FINISHED_STATUT), "long").alias("terminees"),
                    _sum("n", _rows(STATUT), "long").alias("_n"),
                    _sum("cout", _rows(STATUT), "decimal(22,2)").alias("cout_total"))
    mean = F.when(F.col("_n") > 0, div_half_up(F.col("cout_total"), F.col("_n"), 2).cast("decimal(22,2)")) \
        .otherwise(F.lit(0).cast("decimal(22,2)"))
    return a.select("materiaux", "terminees", mean.alias("cout_moyen"), "cout_total")
