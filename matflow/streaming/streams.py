"""Structured Streaming versions of the guards.

* R1, R2, R4: watermarked tumbling-window aggregates in append mode; a
  window is emitted once the watermark passes its end, later rows are dropped.
* R3, R5: ordered folds with ``transformWithStateInPandas`` (RocksDB state
  store, event-time timers). Rows of a key are not ordered inside a
  micro-batch, so they wait for the watermark and are then folded in (time, id)
  order with the same step rule as the batch fold.
  R3 is keyed by user: rows wait in a ``ListState``. Accounts begin with their
  stored count and lock (initial state); tries on unknown accounts bypass the state.
  R5 is keyed by groups of materials, whose opening stock is the initial state: rows
  wait in a ``MapState`` by bucket of event time, and a timer at the end of each bucket
  folds that bucket alone, so a handler holds the rows of one group and bucket,
  whatever waits behind it.

The stream gives the rows of the batch twin as long as no row arrives later
than the watermark delay; to flush the last rows a closing row far in the
future is appended (``SENTINEL_ID``), and it is dropped from the output.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..plans.fold import OUTCOME_UNKNOWN, lockout_step
from ..session import delete_at_exit, ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SENTINEL_ID = -1
# far future, yet inside the nanosecond range of pandas timestamps (year < 2262)
SENTINEL_TS = dt.datetime(2200, 1, 1)


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


def stream_root(spark: SparkSession) -> str:
    return delete_at_exit(
        spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/matflow-streams/{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------------------
# Windowed counts
# ---------------------------------------------------------------------------

def event_time(df: DataFrame, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables hold TIMESTAMP_NTZ. The cast goes
    through the session time zone and is undone on output (``ntz``)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


def _window_counts(watermarked: DataFrame, width: str, limit: int,
                   counted: F.Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    out = (watermarked.groupBy(F.window("ts", width).alias("w"), "user_id")
           .agg(n.alias("requetes")))
    if counted is not None:
        out = out.where(F.col("requetes") > 0)
    return out.select("user_id", ntz("w.start").alias("debut"), ntz("w.end").alias("fin"), "requetes",
                      (F.col("requetes") > limit).alias("depasse"),
                      F.greatest(F.col("requetes") - limit, F.lit(0)).alias("refusees"))


def rate_limit_stream(requests: DataFrame, delay: str = "1 hour", width: str = C.RATE_WINDOW,
                      limit: int = C.RATE_LIMIT) -> DataFrame:
    """R1 on a stream of (user_id, ts)."""
    return _window_counts(event_time(requests, delay), width, limit)


def login_rate_stream(attempts: DataFrame, delay: str = "1 hour", width: str = C.RATE_WINDOW,
                      limit: int = C.LOGIN_RATE_LIMIT) -> DataFrame:
    """R2 on a stream of log-in tries: failures per client and window.

    Every try moves event time forward, so successes must reach the
    watermark; a plain filter would be pushed below it by the optimizer.
    Failures are therefore counted with a conditional aggregate and windows
    without failures dropped after the aggregation."""
    return _window_counts(event_time(attempts, delay), width, limit, ~F.col("success"))


def server_error_stream(log: DataFrame, delay: str = "1 hour", width: str = C.RATE_WINDOW) -> DataFrame:
    """R4 on a stream of requests (status, duration_ms)."""
    from ..functions.exprs import div_half_up
    d = F.col("duration_ms").cast("decimal(18,2)")
    return (event_time(log, delay)
            .groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("requetes"),
                 F.count_if(F.col("status") >= 500).alias("erreurs"),
                 F.sum(d).alias("duree_totale"))
            .select(ntz("w.start").alias("debut"), ntz("w.end").alias("fin"), "requetes", "erreurs",
                    F.col("duree_totale").cast("decimal(20,2)").alias("duree_totale"),
                    div_half_up(F.col("duree_totale"), F.col("requetes"), 3).alias("duree_moyenne")))


# ---------------------------------------------------------------------------
# Ordered folds with state
# ---------------------------------------------------------------------------

def _us(ts: pd.Series) -> np.ndarray:
    """Wall-clock microseconds (Spark hands TIMESTAMP columns to pandas as
    naive session-local times)."""
    ts = pd.to_datetime(ts)
    if getattr(ts.dt, "tz", None) is not None:
        ts = ts.dt.tz_localize(None)
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def _epoch_ms(ts: pd.Series, tz: str) -> np.ndarray:
    """Epoch milliseconds, comparable with the watermark, from the naive
    session-local times pandas receives."""
    ts = pd.to_datetime(ts)
    if getattr(ts.dt, "tz", None) is None:
        ts = ts.dt.tz_localize(tz, ambiguous=True, nonexistent="shift_forward")
    return ts.dt.tz_convert("UTC").dt.tz_localize(None).to_numpy().astype("datetime64[ms]").astype(np.int64)


class _BufferedFold(StatefulProcessor):
    """Buffer rows per key; fold the ones older than the watermark in order.

    ``tz`` is the session time zone: event times reach pandas as naive local
    times, and the watermark is in epoch milliseconds."""

    tz = "UTC"
    bucket_ms = 3_600_000

    def _timer(self, ms: int) -> int:
        return (ms // self.bucket_ms + 1) * self.bucket_ms

    row_schema: T.StructType       # buffered row layout (first field: event time in ms)
    state_schema: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)

    # subclasses: to_tuples(pdf) -> list[tuple]; fold(key, state, rows) -> (state, out_pdf)
    # Every state call is a round trip to the JVM, so each handler makes as
    # few as it can: input = append + one timer; timer = read, write back.

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new.extend(self.to_tuples(pdf))
        if new:
            self.pending.appendList(new)
            # one timer per bucket of event time: rows are folded a bucket at a
            # time, so a row is read and written back a bounded number of times
            # however many rows wait. A timer that finds nothing due is a no-op
            self.handle.registerTimer(self._timer(min(r[0] for r in new)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm = timerValues.getCurrentWatermarkInMs()
        rows = list(self.pending.get())
        due = sorted((r for r in rows if r[0] < wm), key=lambda r: (r[0], r[1]))
        if not due:
            return iter([])
        rest = [r for r in rows if r[0] >= wm]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(self._timer(min(r[0] for r in rest)))
        else:
            self.pending.clear()
        st, out = self.fold(key, self.state.get(), due)
        self.state.update(st)
        return iter([out])

    def close(self) -> None:
        pass


class DeductionProcessor(StatefulProcessor):
    """Greedy deduction for a group of materials.

    State: the group's materials (ids in order, and how many rows of each the stock
    table holds) and what is left of them, from the first micro-batch on; the amounts
    changed since ``left`` was last written whole; the waiting rows by bucket of event time
    (packed arrays, one a micro-batch). Nothing is written a second time, but ``left`` when
    as many changes as materials have gathered, so what a stream writes grows with its
    rows, however many micro-batches there are. ``most_rows`` refuses a handler call with
    more rows than that (for tests and for alarms)."""

    ROW = np.dtype([("us", "<i8"), ("req", "<i8"), ("qte", "<i8"), ("at", "<i4")])   # at: place among the ids

    def __init__(self, tz: str = "UTC", bucket_ms: int = 3_600_000, most_rows: int | None = None):
        self.tz, self.bucket_ms, self.most_rows = tz, bucket_ms, most_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "rows binary")
        self.materials = handle.getValueState("materials", "ids binary, copies binary")
        self.left = handle.getValueState("left", "remaining binary")
        self.changed = handle.getListState("changed", "at binary, remaining binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The group's row of ``opening_stock``."""
        ids, left = (np.asarray(initialState[c].iloc[0], "<i8") for c in ("ids", "opening"))
        order = np.lexsort((left, ids))
        ids, first, copies = np.unique(ids[order], return_index=True, return_counts=True)
        # as a rule no id is there twice: no counts are kept then
        self.materials.update((ids.tobytes(), b"" if (copies == 1).all() else copies.astype("<i4").tobytes()))
        self.left.update((left[order][first].tobytes(),))

    def _materials(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.materials.get() if self.materials.exists() else (b"", b"")
        ids, copies = np.frombuffer(bytes(held[0]), "<i8"), np.frombuffer(bytes(held[1]), "<i4")
        return ids, copies if len(copies) else np.ones(len(ids), "<i4")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, copies = self._materials()
        new, ms, out = [], [], []
        for pdf in rows:
            sid, qte = (pdf[c].to_numpy(dtype=np.int64) for c in ("stock_id", "qte"))
            named, counted = pdf["named"].to_numpy(dtype=bool), pdf["counted"].to_numpy(dtype=bool)
            at, known = np.searchsorted(ids, sid), np.zeros(len(pdf), bool)
            inside = named & (at < len(ids))
            known[inside] = ids[at[inside]] == sid[inside]
            needs = known & counted & (qte > 0)
            # a known material without an amount is neither folded nor free, as in the batch form
            free = np.flatnonzero(~needs & (counted | ~known))
            times = np.ones(len(free), int)
            times[known[free]] = copies[at[free[known[free]]]]
            free = np.repeat(free, times)
            if len(free):
                out.append(pd.DataFrame({
                    "req_id": pdf["req_id"].to_numpy()[free],
                    "stock_id": pd.arrays.IntegerArray(sid[free], ~named[free]),
                    "qte": pd.arrays.IntegerArray(qte[free], ~counted[free]),
                    "accepted": known[free] | ~named[free],
                    "motif": np.where(named[free] & ~known[free], "materiau_inconnu", None)}))
            pdf = pdf[needs]
            part = np.empty(len(pdf), self.ROW)
            part["req"], part["qte"], part["at"] = pdf["req_id"].to_numpy(dtype=np.int64), qte[needs], at[needs]
            # epoch ms decides when a row is due; microseconds order the rows
            part["us"] = _us(pdf["ts"])
            new.append(part)
            ms.append(_epoch_ms(pdf["ts"], self.tz))
        new, bucket = np.concatenate(new), np.concatenate(ms) // self.bucket_ms
        for b in np.unique(bucket).tolist():
            part = 0
            while self.waiting.containsKey((b, part)):
                part += 1
            self.waiting.updateValue((b, part), (new[bucket == b].tobytes(),))
            self.handle.registerTimer((b + 1) * self.bucket_ms)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms - 1
        parts = []
        while self.waiting.containsKey((b, len(parts))):
            parts.append(np.frombuffer(bytes(self.waiting.getValue((b, len(parts)))[0]), self.ROW))
        if not parts:
            return iter([])
        due = np.concatenate(parts)
        if self.most_rows is not None and len(due) > self.most_rows:
            raise RuntimeError(f"{len(due)} rows of one group and bucket, {self.most_rows} expected at most")
        for part in range(len(parts)):
            self.waiting.removeKey((b, part))
        ids, copies = self._materials()
        before = np.frombuffer(bytes(self.left.get()[0]), "<i8").copy()
        changes = 0
        for at, remaining in self.changed.get():
            at = np.frombuffer(bytes(at), "<i4")
            before[at] = np.frombuffer(bytes(remaining), "<i8")
            changes += len(at)
        due = due[np.lexsort((due["req"], due["us"], due["at"]))]
        due = np.repeat(due, copies[due["at"]])
        accepted, now = self.fold(due, before)
        at = np.flatnonzero(now != before)
        if changes + len(at) >= len(ids):
            self.left.update((now.tobytes(),))
            self.changed.clear()
        elif len(at):
            self.changed.appendValue((at.astype("<i4").tobytes(), now[at].tobytes()))
        return iter([pd.DataFrame({
            "req_id": due["req"], "stock_id": ids[due["at"]], "qte": due["qte"], "accepted": accepted,
            "motif": np.where(accepted, None, "stock_insuffisant")})])

    @staticmethod
    def fold(due: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decisions of rows sorted by material and order, and the stock left."""
        accepted, now = np.ones(len(due), bool), before.copy()
        edge = np.flatnonzero(np.diff(due["at"])) + 1
        for a, z in zip(np.r_[0, edge].tolist(), np.r_[edge, len(due)].tolist()):
            at = due["at"][a]
            left, wanted = int(before[at]), due["qte"][a:z]
            if int(wanted.sum()) <= left:
                left -= int(wanted.sum())
            else:
                for i, q in enumerate(wanted.tolist(), a):
                    accepted[i] = left >= q
                    left -= q if left >= q else 0
            now[at] = left
        return accepted, now

    def close(self) -> None:
        pass


DECISION_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType()), T.StructField("stock_id", T.LongType()),
    T.StructField("qte", T.LongType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("motif", T.StringType())])


def _group(groups: int, *ids: str) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(*[F.col(c).cast("long") for c in ids])), F.lit(groups)).alias("grp")


def opening_stock(stock: DataFrame, groups: int) -> DataFrame:
    """One row per group of materials: ids and opening amounts, in two arrays. An amount
    that is not known covers no request."""
    m = F.struct(F.col("id").cast("long").alias("id"),
                 F.coalesce(F.col("quantite").cast("long"), F.lit(-1 << 63)).alias("opening"))
    return (stock.where(F.col("id").isNotNull()).groupBy(_group(groups, "id")).agg(F.collect_list(m).alias("m"))
            .select("grp", F.col("m.id").alias("ids"), F.col("m.opening").alias("opening")))


def consume_stock_stream(requests: DataFrame, stock: DataFrame, delay: str = "1 hour",
                         bucket_ms: int = 3_600_000, groups: int | None = None,
                         most_rows: int | None = None) -> DataFrame:
    """M7 on a stream of (req_id, stock_id, qte, ts); ``stock`` is static.

    The stock table is read once, in the first micro-batch, as the initial state of
    ``groups`` groups of materials (two a state partition; fixed for the life of a
    checkpoint); later ones shuffle their requests alone, once. Rows that need no state
    (no material, unknown material, amount <= 0) are answered as they come; those
    without material are dealt to the groups by their own id.
    """
    spark = requests.sparkSession
    use_rocksdb(spark)
    groups = groups or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # nulls go as flags: pandas has no whole numbers with nulls
    r = event_time(requests, delay).select(
        _group(groups, "stock_id", "req_id"), "req_id",
        F.coalesce(F.col("stock_id").cast("long"), F.lit(0)).alias("stock_id"),
        F.col("stock_id").isNotNull().alias("named"),
        F.coalesce(F.col("qte").cast("long"), F.lit(0)).alias("qte"), F.col("qte").isNotNull().alias("counted"), "ts")
    processor = DeductionProcessor(_session_tz(requests), bucket_ms, most_rows)
    return r.groupBy("grp").transformWithStateInPandas(
        processor, DECISION_SCHEMA, "Append", "EventTime", opening_stock(stock, groups).groupBy("grp"))


class LockoutProcessor(_BufferedFold):
    """Log-in lockout per user (state = failure count, locked-until in wall-clock
    microseconds)."""

    row_schema = T.StructType([T.StructField("ms", T.LongType()), T.StructField("event_id", T.LongType()),
                               T.StructField("success", T.BooleanType())])
    state_schema = T.StructType([T.StructField("count", T.IntegerType()),
                                 T.StructField("until_ms", T.LongType())])

    def __init__(self, max_failures: int = C.MAX_FAILURES, lock_minutes: float = C.LOCK_MINUTES,
                 tz: str = "UTC"):
        self.max_failures = max_failures
        self.lock_ms = int(lock_minutes * 60_000)
        self.tz = tz

    def to_tuples(self, pdf: pd.DataFrame) -> list[tuple]:
        # epoch ms decides when a row is due; wall-clock us orders the rows,
        # times the locks and is written out
        us = _us(pdf["ts"])
        ms = _epoch_ms(pdf["ts"], self.tz)
        return [(int(m), int(e), bool(s), int(u)) for m, u, e, s in
                zip(ms, us, pdf["event_id"], pdf["success"])]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The account as stored: ``c0`` failures, locked until ``u0`` (us; null: never)."""
        row = initialState.iloc[0]
        self.state.update((int(row["c0"]), None if pd.isna(row["u0"]) else int(row["u0"])))

    def fold(self, key, st, due):
        state = (0, None) if st is None else (st[0], st[1])
        lock = self.lock_ms * 1000
        out_id, out_ok, out_outcome, out_cnt, out_until, out_ts = [], [], [], [], [], []
        for row in sorted(due, key=lambda r: (r[3], r[1])):
            _, eid, ok, us = row
            state, outcome = lockout_step(state, us, ok, self.max_failures, lock)
            out_id.append(eid)
            out_ok.append(ok)
            out_outcome.append(outcome)
            out_cnt.append(state[0])
            out_until.append(state[1])
            out_ts.append(us)
        out = pd.DataFrame({
            "event_id": np.array(out_id, dtype=np.int64),
            "user_id": np.full(len(out_id), int(key[0]), dtype=np.int64),
            "ts": pd.to_datetime(np.array(out_ts, dtype="datetime64[us]")),
            "success": np.array(out_ok, dtype=bool),
            "outcome": out_outcome,
            "tentatives": np.array(out_cnt, dtype=np.int32),
            "bloque_jusqu": pd.to_datetime(np.array(
                [np.datetime64(u, "us") if u is not None else np.datetime64("NaT") for u in out_until],
                dtype="datetime64[us]")),
        })
        return (state[0], state[1]), out


LockoutProcessor.row_schema = T.StructType(
    list(LockoutProcessor.row_schema.fields) + [T.StructField("us", T.LongType())])

LOCKOUT_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("success", T.BooleanType()),
    T.StructField("outcome", T.StringType()), T.StructField("tentatives", T.IntegerType()),
    T.StructField("bloque_jusqu", T.TimestampNTZType())])


def login_lockout_stream(attempts: DataFrame, users: DataFrame | None = None, delay: str = "1 hour",
                         max_failures: int = C.MAX_FAILURES,
                         lock_minutes: float = C.LOCK_MINUTES) -> DataFrame:
    """R3 on a stream of (event_id, user_id, ts, success).

    With ``users`` (static) an account's state begins with its stored ``tentatives`` and
    ``bloque_jusqu`` at the stream's first micro-batch; tries on unknown accounts are
    answered ``INCONNU`` and pass by the state, as in the batch form."""
    use_rocksdb(attempts.sparkSession)
    processor = LockoutProcessor(max_failures, lock_minutes, _session_tz(attempts))
    tries = event_time(attempts, delay).select("user_id", "event_id", "ts", "success")
    if users is None:
        return tries.groupBy("user_id").transformWithStateInPandas(processor, LOCKOUT_OUT, "Append", "EventTime")
    j = tries.join(users.select(F.col("id").alias("_uid")), F.col("user_id") == F.col("_uid"), "left")
    unknown = j.where(F.col("_uid").isNull()).select(
        "event_id", "user_id", ntz("ts").alias("ts"), "success", F.lit(OUTCOME_UNKNOWN).alias("outcome"),
        F.lit(0).alias("tentatives"), F.lit(None).cast("timestamp_ntz").alias("bloque_jusqu"))
    stored = (users.where((F.col("tentatives") > 0) | F.col("bloque_jusqu").isNotNull())
              .select(F.col("id").alias("user_id"), F.least(F.col("tentatives"), F.lit(max_failures - 1)).alias("c0"),
                      (F.col("bloque_jusqu") * 1000).alias("u0")).groupBy("user_id"))
    known = (j.where(F.col("_uid").isNotNull()).drop("_uid").groupBy("user_id")
             .transformWithStateInPandas(processor, LOCKOUT_OUT, "Append", "EventTime", stored))
    return known.unionByName(unknown)


# ---------------------------------------------------------------------------
# Running a stream over files to completion (tests and the registered query)
# ---------------------------------------------------------------------------

#: Requests of one step of ``deduction_stream_over``, on average.
SLICE_ROWS = 2_000_000


def deduction_stream_over(spark: SparkSession, requests: DataFrame, stock: DataFrame, delay: str = "1 hour",
                          slice_rows: int = SLICE_ROWS, most_rows: int | None = None) -> DataFrame:
    """Write ``requests`` (req_id, stock_id, qte, ts) as parquet in slices of time, at least
    three, stream them through R5 into parquet and return the result.

    The slices come to the source folder one after the other, each when the running
    query is done with the one before, so a micro-batch holds one slice, the watermark
    moves in between, and a handler folds a bucket of one. The query is not started anew:
    its state stays where it is. The last slice carries a closing row and another one
    follows it, whose micro-batch fires the last timers; both are removed from the result.
    Folders are shared ones, the checkpoint next to the output. The state partition
    count is the session's ``spark.sql.shuffle.partitions``."""
    root = stream_root(spark)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    n, low, high = requests.agg(F.count(F.lit(1)), F.min(us), F.max(us)).first()
    slices = max(3, -(-n // slice_rows))
    marks = [k / slices for k in range(1, slices)]
    cuts = requests.agg(F.percentile_approx(us, marks, 10_000)).first()[0] or []
    nth = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < us)) if cuts else F.lit(0)
    schema = T.StructType([T.StructField("req_id", T.LongType()), T.StructField("stock_id", T.LongType()),
                           T.StructField("qte", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    closing = spark.range(1).select(F.lit(SENTINEL_ID).cast("long").alias("req_id"), F.lit(None).cast("long").alias("stock_id"),
                                    F.lit(0).cast("long").alias("qte"), F.lit(SENTINEL_TS).cast("timestamp_ntz").alias("ts"))
    (requests.select(*schema.names, nth.alias("slice")).unionByName(closing.withColumn("slice", F.lit(slices - 1)))
     .write.partitionBy("slice").parquet(f"{root}/slices"))
    closing.write.parquet(f"{root}/closing")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(f"{root}/in"))
    stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
    width = max(3_600_000, ((high or 0) - (low or 0)) // 1000 // slices)
    out = consume_stock_stream(stream, stock, delay, width, most_rows=most_rows)
    # the next slice's batch, or the closing row's, fires the timers: no batches without data
    extra = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(extra, "true")
    spark.conf.set(extra, "false")
    try:
        query = (out.writeStream.format("parquet").outputMode("append")
                 .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").start())
    finally:
        spark.conf.set(extra, before)
    try:
        for folder, name in [*[(f"slices/slice={k}", f"{k:09d}") for k in range(slices)], ("closing", "closing")]:
            if fs.rename(jvm.Path(f"{root}/{folder}"), jvm.Path(f"{root}/in/{name}")):   # else: no request in this slice
                query.processAllAvailable()
    finally:
        query.stop()
    result = spark.read.schema(out.schema).parquet(f"{root}/out")
    return result.where(F.col("req_id") != SENTINEL_ID)


# register the streaming key of the inventory (rows-only check, compared with
# M7 in the tests)
def _register() -> None:
    from ..plans import sql_twins as S
    from ..plans.registry import register

    # the stream must give exactly the rows of the batch fold, so its twin is
    # the recursive-CTE twin of M7
    @register("consume_stock_stream", S.q(S.M7_CTES + " SELECT * FROM m7", recursive=True))
    def _r5(t):
        reqs = t.production.select(F.col("id").alias("req_id"), "stock_id",
                                   F.col("qte_consommee").cast("long").alias("qte"),
                                   F.col("date_prod").cast("timestamp_ntz").alias("ts"))
        return deduction_stream_over(t.spark, reqs, t.stock)


_register()
