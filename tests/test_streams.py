"""Stream = batch: the streaming guards give the rows of their batch twins
when fed shuffled files in several micro-batches plus a closing row."""
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from matflow.sources import fixtures
from matflow.sources.catalog import open_tables
from matflow.streaming import guards, streams
from matflow.operators import ledger

CLOSE = dt.datetime(2200, 1, 1)


def _files(spark, df, n, root):
    """Write df as n files (hash-shuffled rows), then a closing row file."""
    df.repartition(n, F.xxhash64(*df.columns)).write.parquet(f"{root}/in")
    return f"{root}/in"


def _drain(stream, root, files_per_trigger=None):
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True))
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def test_consume_stock_stream_equals_batch(spark):
    t = open_tables(spark, SF_SMALL)
    reqs = t.production.select(F.col("id").alias("req_id"), "stock_id",
                               F.col("qte_consommee").cast("long").alias("qte"),
                               F.col("date_prod").cast("timestamp_ntz").alias("ts"))
    s = streams.deduction_stream_over(spark, reqs, t.stock)
    b = ledger.consume_stock(reqs.withColumn("date_prod", F.col("ts")), t.stock, ("date_prod", "req_id"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_a_hot_material_is_folded_bucket_by_bucket(spark):
    """A third of the requests want one material; a handler holds at most a slice's part."""
    n = 3000
    reqs = spark.range(n).select(
        F.col("id").alias("req_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7 + 2).alias("stock_id"),
        (F.col("id") * 7 % 11 - 1).alias("qte"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 37 % 3000,0)").alias("ts"))
    stock = spark.createDataFrame([(i, 900 if i == 1 else 400) for i in range(1, 9)], "id long, quantite int")
    got = streams.deduction_stream_over(spark, reqs, stock, slice_rows=600, most_rows=450)
    want = ledger.consume_stock(reqs, stock, ("ts", "req_id"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r.accepted for r in got.where("stock_id = 1").collect()} == {True, False}
    with pytest.raises(Exception, match="rows of one group"):
        streams.deduction_stream_over(spark, reqs, stock, slice_rows=600, most_rows=50).count()


def test_the_stock_is_read_in_the_first_micro_batch_only(spark, tmp_path):
    """Later micro-batches find it in the state: its files may be gone by then."""
    schema = "req_id long, stock_id long, qte long, ts timestamp_ntz"
    rows = [[(10 * k + i, i, 5, dt.datetime(2024, 1, 1 + 10 * k)) for i in range(1, 5)] for k in range(3)]
    for k, part in enumerate([*rows, [(-1, None, 0, CLOSE)], [(-1, None, 0, CLOSE)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
    spark.createDataFrame([(1, 100), (2, 9), (3, 0)], "id long, quantite int").write.parquet(f"{tmp_path}/stock")
    os.mkdir(f"{tmp_path}/in")
    out = streams.consume_stock_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"),
                                       spark.read.parquet(f"{tmp_path}/stock"))
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ckpt").start())
    try:
        for k in range(5):
            os.rename(f"{tmp_path}/b{k}", f"{tmp_path}/in/b{k}")
            q.processAllAvailable()
            if k == 0:
                os.rename(f"{tmp_path}/stock", f"{tmp_path}/stock-gone")
    finally:
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").where("req_id >= 0").collect()
    assert sorted((r.req_id, r.accepted, r.motif) for r in got) == sorted(
        (10 * k + i, ok, why) for k in range(3) for i, ok, why in [
            (1, True, None), (2, k == 0, None if k == 0 else "stock_insuffisant"),
            (3, False, "stock_insuffisant"), (4, False, "materiau_inconnu")])


def test_stream_of_odd_rows_equals_batch(spark):
    """Materials that are there twice or unknown, no material, no amount; many slices with
    few changes each."""
    reqs = spark.range(900).select(
        F.col("id").alias("req_id"),
        F.expr("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 900 + id % 3 ELSE id * 31 % 400 END").alias("stock_id"),
        F.expr("CASE WHEN id % 19 <> 0 THEN id * 7 % 11 - 1 END").alias("qte"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,id * 37 % 900,0,0)").alias("ts"))
    stock = spark.range(400).select("id", (F.col("id") % 23).cast("int").alias("quantite"))
    stock = stock.unionByName(stock.where("id % 10 = 0"))
    got = streams.deduction_stream_over(spark, reqs, stock, slice_rows=150)
    want = ledger.consume_stock(reqs, stock, ("ts", "req_id"))
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=repr)
    assert rows == sorted(map(tuple, want.collect()), key=repr)
    assert {r[4] for r in rows} == {None, "stock_insuffisant", "materiau_inconnu"}


def test_lockout_stream_starts_from_the_stored_accounts(spark):
    """Three slices of time, the query started anew for each, accounts with stored counts
    and locks, and tries on accounts that do not exist."""
    att = fixtures.login_attempts(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    lo, hi = att.agg(F.min("ts"), F.max("ts")).first()
    lock = int(((lo - dt.datetime(1970, 1, 1)).total_seconds() + 40 * 86400) * 1000)
    users = (att.select(F.col("user_id").alias("id")).distinct().where("id % 5 <> 0")
             .withColumn("tentatives", (F.col("id") % 7).cast("int"))
             .withColumn("bloque_jusqu", F.when(F.col("id") % 3 == 0, F.lit(lock)).when(F.col("id") % 3 == 1, F.lit(0))))
    root = streams.stream_root(spark)
    schema = att.schema
    cuts = [lo, lo + (hi - lo) / 3, lo + (hi - lo) * 2 / 3, hi + dt.timedelta(days=1)]
    out = None
    for k in range(3):
        part = att.where((F.col("ts") >= F.lit(cuts[k])) & (F.col("ts") < F.lit(cuts[k + 1])))
        part.repartition(2).write.mode("append").parquet(f"{root}/in")
        if k == 2:
            spark.createDataFrame([(-1, -1, CLOSE, True)], schema).write.mode("append").parquet(f"{root}/in")
        st = spark.readStream.schema(schema).parquet(f"{root}/in")
        out = _drain(streams.login_lockout_stream(st, users, delay="1 hour", lock_minutes=60 * 24 * 10), root)
    batch = guards.login_lockout(att, users, lock_minutes=60 * 24 * 10)
    cols = ["event_id", "user_id", "ts", "success", "outcome", "tentatives", "bloque_jusqu"]
    got = sorted(map(repr, map(tuple, out.where("event_id >= 0").select(cols).collect())))
    assert got == sorted(map(repr, map(tuple, batch.select(cols).collect())))
    assert {r.outcome for r in batch.select("outcome").distinct().collect()} >= {"INCONNU", "REFUSE"} or len(
        batch.select("outcome").distinct().collect()) >= 4


def test_lockout_stream_equals_batch(spark):
    att = fixtures.login_attempts(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    root = streams.stream_root(spark)
    src = _files(spark, att, 3, root)
    spark.createDataFrame([(-1, -1, CLOSE, True)], att.schema).write.mode("append").parquet(src)
    st = spark.readStream.schema(att.schema).option("maxFilesPerTrigger", 2).parquet(src)
    # the files are not in time order: the delay covers the whole range
    out = _drain(streams.login_lockout_stream(st, delay="3650 days"), root).where("event_id >= 0")
    batch = guards.login_lockout(att)
    cols = ["event_id", "user_id", "ts", "success", "outcome", "tentatives", "bloque_jusqu"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_rate_windows_stream_equals_batch(spark):
    log = fixtures.request_log(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    root = streams.stream_root(spark)
    src = _files(spark, log, 2, root)
    spark.createDataFrame([(-1, -1, CLOSE, 200, 0.0)], log.schema).write.mode("append").parquet(src)
    st = spark.readStream.schema(log.schema).parquet(src)
    out = _drain(streams.rate_limit_stream(st, delay="3650 days", limit=2), root).where("user_id >= 0")
    batch = guards.rate_limit_windows(log, limit=2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select(out.columns).collect()))
    att = fixtures.login_attempts(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    root3 = streams.stream_root(spark)
    src3 = _files(spark, att, 2, root3)
    spark.createDataFrame([(-1, -1, CLOSE, True)], att.schema).write.mode("append").parquet(src3)
    st3 = spark.readStream.schema(att.schema).parquet(src3)
    out2 = _drain(streams.login_rate_stream(st3, delay="3650 days", limit=1), root3).where("user_id >= 0")
    b2 = guards.login_rate_windows(att, limit=1)
    assert sorted(map(tuple, out2.collect())) == sorted(map(tuple, b2.select(out2.columns).collect()))
    root2 = f"{root}-r4"
    out4 = _drain(streams.server_error_stream(st, delay="3650 days"), root2)
    b4 = guards.server_error_windows(log)
    # the closing row's own window never closes, everything before it does
    assert sorted(map(tuple, out4.collect())) == sorted(map(tuple, b4.select(out4.columns).collect()))


def test_streams_independent_of_session_time_zone(spark):
    """Event times reach the state handlers as session-local times while
    watermarks are epoch based: a non-UTC session must give the same rows."""
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/Los_Angeles")
    try:
        att = fixtures.login_attempts(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
        root = streams.stream_root(spark)
        src = _files(spark, att, 2, root)
        spark.createDataFrame([(-1, -1, CLOSE, True)], att.schema).write.mode("append").parquet(src)
        st = spark.readStream.schema(att.schema).parquet(src)
        out = _drain(streams.login_lockout_stream(st, delay="3650 days"), root).where("event_id >= 0")
        cols = ["event_id", "user_id", "ts", "success", "outcome", "tentatives", "bloque_jusqu"]
        got = sorted(map(tuple, out.select(cols).collect()))
    finally:
        spark.conf.set(key, old)
    assert got == sorted(map(tuple, guards.login_lockout(att).select(cols).collect()))
