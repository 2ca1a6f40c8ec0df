"""Audit rows statement by statement against the trigger replayed row by row, and the
answers to job changes."""
import datetime as dt
import json

import numpy as np
import pytest

from matflow.operators import statements, writes
from matflow.sources.catalog import fork_tables, open_tables, tables_at
from matflow.streaming import streams

from conftest import SF_SMALL

TODAY, NOW = dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12)
REQUEST = "seq long, op string, target_id long, materiel string, quantite int, date_ajout date"
JOB = ("seq long, op string, target_id long, produit string, quantite int, responsable string, date_prod date, "
       "cout decimal(12,2), statut string, stock_id long, qte_consommee int")


def replay(stock, requests):
    """The trigger, one statement after the other."""
    now = {r.id: (r.materiel, r.quantite, r.date_ajout) for r in stock.collect()}
    out = []

    def text(row):
        if row is None:
            return None
        cols = zip(("materiel", "quantite", "date_ajout"), row)
        return {k: str(v) if isinstance(v, dt.date) else v for k, v in cols if v is not None}
    for seq, op, target, name, n, day in sorted(requests):
        if op == "INSERT" or target not in now:
            continue
        before = now.pop(target)
        after = (name.strip(), n, day or TODAY) if op == "UPDATE" else None
        if after:
            now[target] = after
        out.append((seq, op, target, text(before), text(after)))
    return out


@pytest.mark.parametrize("per", [1, 7, 100_000])
def test_every_statement_leaves_its_row(spark, seed, per):
    rng = np.random.default_rng(per)
    rows = []
    for seq in range(400):
        # most statements on one material; a few delete
        target = 1 if seq % 3 else int(rng.integers(1, 8))
        op = "DELETE" if seq in (380, 385) or (target != 1 and rng.random() < .02) else "UPDATE"
        rows.append((seq, op, target, f" m{seq} ", int(rng.integers(0, 99)), dt.date(2024, 1, 2) if seq % 5 else None))
    rows.append((400, "INSERT", None, "x", 1, None))
    got = statements.stock_statements(seed["stock"], spark.createDataFrame(rows, REQUEST), TODAY, NOW, per).collect()
    found = sorted((r.seq, r.action, r.record_id, json.loads(r.ancienne_valeur),
                    r.nouvelle_valeur and json.loads(r.nouvelle_valeur)) for r in got)
    assert found == replay(seed["stock"], rows)
    assert len(found) > 250


def test_three_updates_are_three_rows_of_a_commit(spark):
    t = open_tables(spark, SF_SMALL)
    mine = fork_tables(t, streams.stream_root(spark) + "/statements")
    one, two = [r.id for r in mine.stock.orderBy("id").limit(2).collect()]
    rows = [(k, "UPDATE", one, f"n{k}", k, None) for k in (1, 2, 3)] + [(4, "DELETE", two, None, None, None)]
    writes.commit_stock_requests(mine, spark.createDataFrame(rows, REQUEST), TODAY, NOW)
    new = [r for r in tables_at(spark, mine.store).audit.where(f"timestamp = '{NOW}' and table_name = 'Stock'")
           .orderBy("id").collect()]
    assert [(r.record_id, r.action) for r in new] == [(one, "UPDATE")] * 3 + [(two, "DELETE")]
    values = [json.loads(r.ancienne_valeur)["materiel"] for r in new[1:3]]
    assert values == ["n1", "n2"] and json.loads(new[2].nouvelle_valeur)["quantite"] == 3


def test_answers_to_job_changes(spark, seed):
    rows = [(1, "UPDATE", 1, "x"), (2, "UPDATE", 1, "  "), (3, "UPDATE", 99, " "), (4, "DELETE", 2, None),
            (5, "UPDATE", 2, "late"), (6, "DELETE", 2, None), (7, "DELETE", 98, None), (8, "UPDATE", 3, None)]
    req = spark.createDataFrame([(*r, 1, "a", None, None, None, None, None) for r in rows], JOB)
    got = {r.seq: (r.code, r.reject_reason) for r in statements.job_change_decisions(seed["production"], req).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 200, 2: 400, 3: 404, 4: 200, 5: 404, 6: 404, 7: 404, 8: 400}
    left = statements.production_statements(seed["production"], req, TODAY, NOW).collect()
    assert sorted(r.seq for r in left) == [1, 4]
