"""Every registered query against its DuckDB twin on the smallest fixture
(the driver runs the same check at sf0.01)."""
import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from check_oracles import TABLES, rows_of  # noqa: E402

from matflow.plans import registry  # noqa: E402

SQL = registry.ORACLES
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_entry():
    q = registry.QUERIES
    assert len(q) >= 80
    # every query has a SQL twin (the stream's is the batch fold's)
    assert sorted(set(q) - set(SQL)) == []


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    table = df.toArrow()
    srows = [tuple(r) for r in zip(*[c.to_pylist() for c in table.columns])] if table.num_columns else []
    r = con.execute(SQL[name])
    dcols = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, r.fetchall())
    # same Arrow column types on both sides
    dtypes = {f.name: str(f.type) for f in con.sql(SQL[name]).arrow().schema}
    assert {f.name: str(f.type) for f in table.schema} == dtypes


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 5
    assert "materiel_nom" in df.columns
