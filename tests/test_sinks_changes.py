"""CSV sinks, audit append, snapshot round trip and identity assignment."""
import datetime as dt
import glob
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_SMALL
from matflow.operators import audit, changes
from matflow.plans.skew import dense_sequence
from matflow.sources import fixtures, sinks
from matflow.sources.catalog import open_tables
from matflow.streaming import streams


def test_stock_csv_bom_and_rows(spark, seed):
    root = streams.stream_root(spark)
    sinks.write_stock_csv(seed["stock"], f"{root}/stock.csv")
    parts = sorted(glob.glob(f"{root.replace('file:', '')}/stock.csv/part-*.csv"))
    assert parts
    head = open(parts[0], encoding="utf-8").readline()
    assert head.startswith("﻿ID;Matériau;Quantité;Date ajout;État")
    back = spark.read.option("sep", ";").option("header", True).csv(f"{root}/stock.csv")
    rows = {r[0]: r for r in back.collect()}
    assert rows["2"][1] == "Sable" and rows["2"][3] == "12/01/2024" and rows["2"][4] == "CRITIQUE"


def test_audit_append_partitions(spark, seed):
    root = streams.stream_root(spark)
    after = fixtures.snapshot_after(seed["stock"])
    e = audit.capture_stock_changes(seed["stock"], after, dt.datetime(2024, 5, 1, 10))
    audit.audit_append(e, f"{root}/audit")
    audit.audit_append(e, f"{root}/audit")
    back = spark.read.parquet(f"{root}/audit")
    assert back.count() == 2 * e.count() and "audit_date" in back.columns


def test_capture_round_trip(spark):
    """before -> changes -> after: every change of the snapshot pair is one
    audit row of the right kind."""
    t = open_tables(spark, SF_SMALL)
    after = fixtures.snapshot_after(t.stock)
    cap = audit.capture_stock_changes(t.stock, after, dt.datetime(2024, 5, 1))
    n = t.stock.count()
    c = {r.action: r.n for r in cap.groupBy("action").agg(F.count("*").alias("n")).collect()}
    ids = [r.id for r in t.stock.select("id").collect()]
    assert c == {"DELETE": sum(i % 10 == 0 for i in ids), "UPDATE": sum(i % 10 == 1 for i in ids),
                 "CREATE": sum(i % 10 == 2 for i in ids)}
    assert after.count() == n - c["DELETE"] + c["CREATE"]


def test_dense_sequence_consecutive(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    out = dense_sequence(df, "k", "pos", start=100, width=1000)
    rows = sorted((r.k, r.pos) for r in out.collect())
    assert [p for _, p in rows] == list(range(100, 100 + len(rows)))


def test_insert_stock_ids(spark, seed):
    reqs = spark.createDataFrame([(30, "Chaux", 7, None), (10, " Plâtre ", 3, dt.date(2024, 5, 2))],
                                 "seq long, materiel string, quantite int, date_ajout date")
    nxt = changes.insert_stock(seed["stock"], reqs, dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12))
    new = {r.id: (r.materiel, r.date_ajout) for r in nxt.where("id > 5").collect()}
    assert new == {6: ("Plâtre", dt.date(2024, 5, 2)), 7: ("Chaux", dt.date(2024, 6, 1))}


def test_delete_detaches_jobs(spark, seed):
    d = spark.createDataFrame([(1,), (99,)], "target_id long")
    assert changes.delete_stock(seed["stock"], d).count() == 4
    jobs = changes.detach_deleted_stock(seed["production"], d)
    assert sorted(r.id for r in jobs.where(F.col("stock_id").isNull()).collect()) == [1, 3]
    cnt = changes.dissociated_counts(seed["stock"], seed["production"], d).collect()
    assert [(r.id, r.cnt) for r in cnt] == [(1, 2)]


def test_changes_then_capture_round_trip(spark):
    """Apply the stock change batch (M2 updates, M3 deletes, M1 inserts), then
    capture the snapshot change (U1): one audit row per effective change."""
    t = open_tables(spark, SF_SMALL)
    req = fixtures.stock_change_requests(t.stock)
    today, now = dt.date(2024, 6, 1), dt.datetime(2024, 6, 1, 12)
    s1 = changes.update_stock(t.stock, req.where("op = 'UPDATE'"), today)
    s2 = changes.delete_stock(s1, req.where("op = 'DELETE'"))
    s3 = changes.insert_stock(s2, req.where("op = 'INSERT'"), today, now)
    cap = audit.capture_stock_changes(t.stock, s3, now)
    got = {r.action: r.n for r in cap.groupBy("action").agg(F.count("*").alias("n")).collect()}
    existing = changes.requests_existing(req, t.stock)
    upd = existing.where("op = 'UPDATE'").count()
    dele = existing.where("op = 'DELETE'").count()
    ins = req.where("op = 'INSERT'").count()
    # an update changes the row (quantity + 1, and the date set to the request's)
    assert got == {"UPDATE": upd, "DELETE": dele, "CREATE": ins}
    assert s3.count() == t.stock.count() - dele + ins
    assert s3.select("id").distinct().count() == s3.count()


def test_dense_rank_hot_key_split(spark, no_coalesce):
    """A record holding most rows is ranked across tasks; the result equals
    the plain window, with ties in time sharing a version."""
    from pyspark.sql import Window
    from matflow.plans.skew import dense_rank_desc
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "Stock", 1 if i % 4 else (i % 13) + 2, t0 + dt.timedelta(minutes=7 * (i // 2))) for i in range(800)]
    # null times and null keys are ranked as by the window
    rows += [(900, "Stock", 1, None), (901, "Stock", 1, None), (902, "Stock", None, t0), (903, "Stock", None, None),
             (904, None, None, t0)]
    df = spark.createDataFrame(rows, "id long, table_name string, record_id long, ts timestamp_ntz")
    keys = ["table_name", "record_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    want = sorted(map(repr, df.withColumn("version", F.dense_rank().over(w)).collect()))
    got = dense_rank_desc(df, keys, "ts").select(*df.columns, "version")
    assert sorted(map(repr, got.collect())) == want
    one = df.where("record_id = 1")
    w1 = Window.orderBy(F.col("ts").desc())
    want1 = sorted(map(repr, one.withColumn("version", F.dense_rank().over(w1)).collect()))
    got1 = dense_rank_desc(one, [], "ts").select(*one.columns, "version")
    assert sorted(map(repr, got1.collect())) == want1


def test_dense_rank_spreads_one_hot_day(spark):
    from pyspark.sql import Window
    from matflow.plans.skew import dense_rank_desc

    # half of the rows in one record and one day, some times repeated, some null
    at = F.lit("2024-03-05 00:00:00").cast("timestamp_ntz")
    rows = spark.range(40_000).select(
        "id", F.when(F.col("id") < 20_000, F.lit(7)).otherwise(F.col("id") % 900).alias("record"),
        F.when(F.col("id") % 997 != 0, at + F.make_dt_interval(
            F.when(F.col("id") < 20_000, F.lit(0)).otherwise(F.col("id") % 50),
            F.lit(0), F.lit(0), ((F.col("id") * 7919) % 86_400).cast("decimal(18,6)"))).alias("ts"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = dense_rank_desc(rows, ["record"], "ts").select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = rows.withColumn("version", F.dense_rank().over(Window.partitionBy("record").orderBy(F.desc("ts"))))
    assert sorted((r.id, r.version) for r in got) == sorted((r.id, r.version) for r in want.collect())
    sizes = sorted(Counter(r.p for r in got).values())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
