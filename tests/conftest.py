import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from matflow.session import build_session
    s = build_session("*", app="matflow-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    """The source application's seed rows (5 materials, 4 jobs, 4 users)."""
    from matflow import schemas
    d = dt.date
    ts = dt.datetime(2024, 3, 1, 9, 0)
    stock = spark.createDataFrame([
        (1, "Ciment", 120, d(2024, 1, 10), ts, None, None),
        (2, "Sable", 8, d(2024, 1, 12), ts, None, None),
        (3, "Gravier", 75, d(2024, 1, 15), ts, None, None),
        (4, "Fer à béton", 45, d(2024, 1, 18), ts, None, None),
        (5, "Eau", 5, d(2024, 2, 1), ts, None, None),
    ], schemas.STOCK)
    production = spark.createDataFrame([
        (1, "Dalle préfabriquée", 200, "admin", d(2024, 2, 10), Decimal("15000.00"), "Terminé", 1, 20,
         dt.datetime(2024, 2, 10, 8), None, None),
        (2, "Poutre T40", 50, "responsable", d(2024, 2, 15), Decimal("8500.00"), "En cours", 3, 10,
         dt.datetime(2024, 2, 15, 8), None, None),
        (3, "Parpaing 20x20", 500, "chef_equipe", d(2024, 2, 20), Decimal("3200.00"), "Critique", 1, 5,
         dt.datetime(2024, 2, 20, 8), None, None),
        (4, "Hourdis", 150, "admin", d(2024, 3, 1), Decimal("6700.00"), "En attente", 2, 3,
         dt.datetime(2024, 3, 1, 8), None, None),
    ], schemas.PRODUCTION)
    users = spark.createDataFrame([
        (1, "admin", "admin", 0, None, ts, None, True),
        (2, "responsable", "responsable", 0, None, ts, None, True),
        (3, "chef_equipe", "chef_equipe", 0, None, ts, None, True),
        (4, "lecteur", "lecteur", 0, None, ts, None, True),
    ], schemas.USERS)
    return {"stock": stock, "production": production, "users": users}


@pytest.fixture
def no_coalesce(spark):
    """Keep every shuffle partition (AQE would merge small ones), so that
    small test data really spans several partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)
