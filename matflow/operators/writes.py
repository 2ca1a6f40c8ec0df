"""
material changes, audit retention.

request batch -> rules (V1, V2, the route's roles) -> typed values (V3) -> M7
(ordered stock deduction) -> the change operators -> trigger rows -> next snapshot.
A ``commit_*`` writes that snapshot as a new store version: it becomes current only
after every table is written, so a batch is all or nothing (the source's separate
round trips are not); the table rules (V4) are checked before, on the rows that the
batch changes. Refused requests are
reported in ``decisions`` and change nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import exprs as X
from ..plans.skew import dense_sequence
from ..sources.catalog import Tables, audit_columns
from . import access, audit, changes, figures, ledger, statements, validate


def _trigger_rows(old_audit: DataFrame, rows: list[DataFrame], mark: int = 0) -> DataFrame:
    """Trigger rows with the next identity values of the audit table, by record, or
    by the order column ``req_id`` where the rows have one."""
    trig = None
    for i, r in enumerate(rows):
        own = [c for c in ("req_id", "seq") if c in r.columns]
        key = F.col(own[0]) if own else F.col("record_id")
        r = r.withColumn("_o", key * len(rows) + i).drop(*own)
        trig = r if trig is None else trig.unionByName(r)
    base = changes.next_base(old_audit, mark)
    trig = dense_sequence(trig, "_o", "_pos").withColumn("id", base + F.col("_pos"))
    return schemas.conform(trig, schemas.AUDIT)


def apply_job_requests(t: Tables, requests: DataFrame, today: dt.date,
                       now: dt.datetime) -> dict[str, DataFrame]:
    """Next snapshot after a batch of job-creation requests (text form, as
    ``sources.fixtures.production_text_requests``), in ``req_id`` order.

    Returns ``stock``, ``production``, ``production_new``, ``audit`` (old rows plus
    the trigger rows of this batch, with new ids: one CREATE per new job, one UPDATE
    per deduction), ``audit_new``, ``decisions`` (per request: code, reason, and
    whether the stock deduction accepted it) and ``changed`` (the changed rows of each
    table before and after). The decisions are stored once
    (checkpoint) and everything else is taken from them.
    """
    v2 = validate.validate_production_requests(requests, t.users)
    typed = validate.production_defaults(
        requests.join(v2.where("accepted").select("req_id"), "req_id", "left_semi"), today).checkpoint()
    dec = ledger.consume_stock(
        typed.select("req_id", "stock_id", F.col("qte_consommee").alias("qte"),
                     F.col("req_id").alias("_ord")), t.stock, ("_ord", "req_id"), levels=True).checkpoint()
    accepted = typed.join(dec.where("accepted").select("req_id"), "req_id", "left_semi")
    production_new = changes.new_production_rows(t.production, accepted, now, t.mark("production"))
    production = schemas.conform(t.production, schemas.PRODUCTION).unionByName(production_new)
    levels = (ledger.stock_after_consumption(t.stock, dec).where("consomme > 0")
              .select("id", F.col("quantite").alias("_q")))

    def levelled(how: str) -> DataFrame:
        return schemas.conform(t.stock.join(levels, "id", how).withColumn("quantite", F.coalesce("_q", "quantite")),
                               schemas.STOCK)
    stock = levelled("left")

    old = audit_columns(t.audit)
    audit_new = _trigger_rows(old, [audit.creation_rows(production_new, now),
                                    audit.deduction_rows(dec, t.stock, now)], t.mark("audit"))
    decisions = (v2.select("req_id", "code", "reject_reason")
                 .join(dec.select("req_id", F.col("accepted").alias("stock_ok"), "motif"), "req_id", "left"))
    return {"stock": stock, "production": production, "production_new": production_new,
            "audit": old.unionByName(audit_new), "audit_new": audit_new, "decisions": decisions,
            "changed": {"stock": (t.stock.join(levels, "id", "left_semi"), levelled("inner")),
                        "production": (t.production.limit(0), production_new)}}


def _of_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "id", "left_semi")


def stock_decisions(t: Tables, requests: DataFrame) -> DataFrame:
    """code (200, 201, 400, 403, 404) and reason of each material request (seq, op,
    target_id, materiel, quantite): first the route's roles, if the requests carry
    ``req_user_id``, then V1 on INSERT and UPDATE, then the target's existence."""
    r = requests
    denied = F.lit(False)
    if "req_user_id" in requests.columns:
        role = t.users.select(F.col("id").alias("_uid"), "role")
        perms = [(k, a) for k, d in C.ROUTE_PERMISSIONS.items() for a in d.get("stock", [])]
        allowed = F.array(*[F.lit(f"{k}/{a}") for k, a in perms])
        r = r.join(role, r.req_user_id == role._uid, "left")
        need = F.when(F.col("op") == "INSERT", "CREATE").otherwise(F.col("op"))
        denied = ~F.coalesce(F.array_contains(allowed, F.concat_ws("/", "role", need)), F.lit(False))
    exists = t.stock.select(F.col("id").alias("target_id")).withColumn("_there", F.lit(True))
    r = r.join(exists, "target_id", "left")
    change = F.col("op") != "DELETE"
    reason = (F.when(denied, validate.MSG_ROLE_DENIED)
              .when(change & X.clean_text(F.col("materiel")).isNull(), validate.MSG_MATERIEL_REQUIRED)
              .when(change & (F.col("quantite").isNull() | (F.col("quantite") < 0)), validate.MSG_QUANTITE_POSITIVE)
              .when((F.col("op") != "INSERT") & F.col("_there").isNull(), statements.MSG_MISSING))
    code = (F.when(reason == validate.MSG_ROLE_DENIED, 403).when(reason == statements.MSG_MISSING, 404)
            .when(reason.isNotNull(), 400).when(F.col("op") == "INSERT", 201).otherwise(200))
    return r.select("seq", code.alias("code"), reason.alias("reject_reason"))


def apply_stock_requests(t: Tables, requests: DataFrame, today: dt.date,
                         now: dt.datetime) -> dict[str, DataFrame]:
    """Next snapshot after a batch of material changes (op UPDATE / DELETE /
    INSERT, as ``sources.fixtures.stock_change_requests``): the rules, M2 updates, M3
    deletes (jobs that used a deleted material lose it), M1 inserts, then
    both triggers (U1 on materials, U2 on the jobs set to null).

    Returns ``stock``, ``production``, ``audit``, ``audit_new``, ``decisions``,
    ``missing`` (the requests whose target does not exist: the 404 answers, J5) and
    ``changed`` (the changed rows of each table before and after).
    """
    decisions = stock_decisions(t, requests)
    good = requests.join(decisions.where("code < 300").select("seq"), "seq", "left_semi")
    upd = good.where(F.col("op") == "UPDATE")
    dele = good.where(F.col("op") == "DELETE")
    ins = good.where(F.col("op") == "INSERT")
    mark = t.stock.agg(F.max("id")).first()[0] or 0     # one number: no id of a row deleted here comes back
    stock = changes.update_stock(t.stock, upd, today)
    stock = changes.delete_stock(stock, dele)
    stock = changes.insert_stock(stock, ins, today, now, max(mark, t.mark("stock")))
    production = changes.detach_deleted_stock(t.production, dele)
    old = audit_columns(t.audit)
    # every statement leaves its row; jobs change only where their material was deleted
    detached = t.production.join(dele.select(F.col("target_id").alias("stock_id")).distinct(), "stock_id", "left_semi")
    created = stock.where(F.col("id") > F.lit(max(mark, t.mark("stock"))))
    detached = schemas.conform(detached, schemas.PRODUCTION)
    freed = changes.detach_deleted_stock(detached, dele)
    audit_new = _trigger_rows(old, [
        statements.stock_statements(t.stock, upd.unionByName(dele), today, now),
        statements.created_stock(created, now),
        audit.capture_production_changes(detached, freed, now)], t.mark("audit"))
    targets = good.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("id")).distinct()
    missing = changes.requests_missing(requests.where(F.col("op") != "INSERT"), t.stock)
    return {"stock": stock, "production": production, "audit": old.unionByName(audit_new),
            "audit_new": audit_new, "missing": missing, "decisions": decisions,
            "changed": {"stock": (_of_ids(t.stock, targets), _of_ids(stock, targets).unionByName(created)),
                        "production": (detached, freed)}}


def changed_jobs(t: Tables, requests: DataFrame, today: dt.date) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The jobs after updates (M5) and deletes (M6), and the rows concerned before and after."""
    production = changes.update_production(t.production, requests.where(F.col("op") == "UPDATE"), today)
    production = changes.delete_production(production, requests.where(F.col("op") == "DELETE"))
    targets = requests.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("id")).distinct()
    return production, (_of_ids(t.production, targets), _of_ids(production, targets))


def apply_job_changes(t: Tables, requests: DataFrame, today: dt.date, now: dt.datetime) -> dict[str, DataFrame]:
    """Next snapshot after a batch of job updates (M5) and deletes (M6), as
    ``sources.fixtures.production_change_requests``, with the trigger rows."""
    production, changed = changed_jobs(t, requests, today)
    old = audit_columns(t.audit)
    audit_new = _trigger_rows(
        old, [statements.production_statements(t.production, requests, today, now)], t.mark("audit"))
    return {"production": production, "audit": old.unionByName(audit_new), "audit_new": audit_new,
            "decisions": statements.job_change_decisions(t.production, requests),
            "changed": {"production": changed}}


def _store(t: Tables):
    if t.store is None:
        raise ValueError("tables were opened without a snapshot store")
    return t.store


def _gate(t: Tables, stock: tuple[DataFrame, DataFrame] | None = None,
          production: tuple[DataFrame, DataFrame] | None = None) -> None:
    """V4 on a change of the present version (the changed rows before and after): fails
    if a rule is broken more often after it."""
    rules = validate.changed_violations(t.stock, t.production, stock, production)
    worse = {(r.table_name, r.rule): r.after for r in rules.where("after > before").collect()}
    if worse:
        raise ValueError(f"the batch breaks table rules: {worse}")


def _highest(**tables: DataFrame) -> dict[str, int]:
    return {k: df.agg(F.max("id")).first()[0] or 0 for k, df in tables.items()}


def _figures(t: Tables, changed: dict) -> dict[str, DataFrame]:
    """The dashboard's partial sums after the change, from those before it."""
    return {figures.TABLE: figures.change(t.figures(), **changed)}


def commit_stock_requests(t: Tables, requests: DataFrame, today: dt.date, now: dt.datetime) -> int:
    """Apply the material batch and write the next snapshot version."""
    store = _store(t)
    nxt = apply_stock_requests(t, requests, today, now)
    _gate(t, **nxt["changed"])
    # jobs change in place (material set to null): rewritten; audit: appended
    return store.commit({"stock": nxt["stock"], "production": nxt["production"], **_figures(t, nxt["changed"])},
                        keep=["users"], append={"audit": nxt["audit_new"]}, head=t.head,
                        marks={"stock": max(_highest(stock=t.stock)["stock"], _highest(stock=nxt["stock"])["stock"]),
                               **_highest(production=t.production, audit=nxt["audit"])})


def commit_job_requests(t: Tables, requests: DataFrame, today: dt.date, now: dt.datetime) -> int:
    """Apply the batch and write the next snapshot version. Only the new
    jobs and audit rows are written (appended batches) and the material
    table is rewritten; users are kept. Returns the version number."""
    store = _store(t)
    nxt = apply_job_requests(t, requests, today, now)
    _gate(t, **nxt["changed"])
    return store.commit({"stock": nxt["stock"], **_figures(t, nxt["changed"])}, keep=["users"], head=t.head,
                        append={"production": nxt["production_new"], "audit": nxt["audit_new"]},
                        marks=_highest(stock=t.stock, production=nxt["production"], audit=nxt["audit"]))


def commit_job_changes(t: Tables, requests: DataFrame, today: dt.date, now: dt.datetime) -> int:
    """Apply job updates and deletes and write the next snapshot version."""
    store = _store(t)
    nxt = apply_job_changes(t, requests, today, now)
    _gate(t, **nxt["changed"])
    return store.commit({"production": nxt["production"], **_figures(t, nxt["changed"])}, keep=["stock", "users"],
                        append={"audit": nxt["audit_new"]}, head=t.head,
                        marks=_highest(production=t.production, audit=nxt["audit"]))


def commit_retention(t: Tables, as_of: dt.datetime) -> int:
    """U4 as a change: whole days before the limit leave the next version without being
    read or written; of the limit's own day the rows that stay are written anew."""
    store = _store(t)
    cutoff = audit.retention_cutoff(as_of)
    day = cutoff.date()
    rest = audit_columns(audit.audit_retention(t.audit, as_of).where(F.col("audit_date") == F.lit(day)))
    kept = [name for name in t.head[3] if name != "audit"]
    return store.commit({}, append={"audit": rest}, first_day={"audit": day + dt.timedelta(days=1)},
                        keep=kept, head=t.head, marks=_highest(audit=t.audit))
