"""Ordered per-key folds (greedy stock deduction, log-in lockout).

Both rules are sequential within a key: the outcome of a row depends on the
state left by the rows before it, so no running sum or window aggregate can
express them. One plan serves keys of every size:

* Rows are range-partitioned on (key, order), sorted and checkpointed
  (``_range_split``), so a key with any share of the rows spans as many
  partitions as it fills.
* Only the first and the last key of a partition can span. Each segment of a
  spanning key computes its transfer table (exit state as a function of entry
  state; for deductions of a narrowing range of entry states, by rounds); the tables
  of a key, one row per partition, are chained in partition order, and the entry
  states (at most two rows per partition) are joined back.
* Then all segments are folded at the same time from their entry states: the sorted
  rows are walked batch by batch, carrying one state record. Deductions that fit what
  remains are a running sum over a whole batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def _range_split(r: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, list]:
    """Range-partition on (key, order), sort, tag each row with its partition
    and checkpoint (fixing partition membership for the passes that follow).
    Returns the checkpointed rows and the keys whose rows span more than one
    partition: found in one pass over the partitions' first and last keys, at
    most one per partition boundary."""
    ensure_checkpoint_dir(r.sparkSession)
    s = (r.repartitionByRange(key, *order)
         .sortWithinPartitions(key, *order)
         .withColumn("_p", F.spark_partition_id()))
    s = s.checkpoint(eager=True)
    ends = s.groupBy("_p").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("_p").collect()
    return s, sorted({x.hi for x, y in zip(ends, ends[1:]) if x.hi == y.lo})


def _rows_of(s: DataFrame, key: str, spanning: list) -> DataFrame:
    """The rows of the spanning keys (at most one key per partition boundary, so
    their broadcast is bounded by the number of partitions)."""
    keys = s.sparkSession.createDataFrame([(k,) for k in spanning], T.StructType([s.schema[key]]))
    return s.join(F.broadcast(keys), key, "left_semi")


# ---------------------------------------------------------------------------
# Greedy stock deduction: accept if remaining >= wanted, then deduct
# ---------------------------------------------------------------------------

DEDUCTION_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType()),
    T.StructField("stock_id", T.LongType()),
    T.StructField("qte", T.LongType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("disponible", T.LongType()),
    T.StructField("restant", T.LongType()),
])


def _deduct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequential greedy fold over rows sorted by (material, partition, order); a segment
    begins with its entry stock ``_start``. Where the demand of a segment's rows in a batch
    fits what remains, a running sum accepts them; only the others are walked row by row."""
    segment, left = None, 0
    for b in batches:
        keys, parts, wanted, start = (b.column(c).to_numpy() for c in ("stock_id", "_p", "qte", "_start"))
        n = len(keys)
        if not n:
            continue
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
        size = np.diff(np.r_[first, n])
        entry = start[first]
        if segment == (keys[0], parts[0]):
            entry[0] = left
        total = np.add.reduceat(wanted, first)
        # a sum beyond 64 bits fits no stock
        fits = (total <= entry) & (np.add.reduceat(wanted.astype(np.float64), first) < 2.0 ** 62)
        used = np.cumsum(wanted)
        after = np.repeat(entry + used[first] - wanted[first], size) - used
        before = after + wanted
        accepted = np.repeat(fits, size)
        rest = entry - total
        for k in np.flatnonzero(~fits).tolist():
            a, z, now = int(first[k]), int(first[k] + size[k]), int(entry[k])
            had, has, took = [], [], []
            for w in wanted[a:z].tolist():
                had.append(now)
                took.append(now >= w)
                now -= w if now >= w else 0
                has.append(now)
            before[a:z], after[a:z], accepted[a:z], rest[k] = had, has, took, now
        segment, left = (keys[-1], parts[-1]), rest[-1]
        yield pa.RecordBatch.from_arrays(
            [b.column("req_id"), b.column("stock_id"), b.column("qte"), pa.array(accepted), pa.array(before),
             pa.array(after)], [f.name for f in DEDUCTION_SCHEMA])


#: Most pieces of an entry map; beyond them only its range is followed.
PIECES = 64

MAP_SCHEMA = "stock_id long, _p int, opening long, full long, full_exit long, low long, high long, " \
             "exit_low long, exit_high long, at array<long>, taken array<long>"
CHAIN_SCHEMA = "stock_id long, _p int, opening long, full long, low long, high long, _start long"


class EntryMap:
    """What a segment makes of every entry stock in [low, high]: pieces that begin at
    ``at`` and lose ``taken``, or, where these become more than ``PIECES``, the range
    [exit_low, exit_high] of the exits alone. ``full_exit`` is the exit of the one
    entry ``full``. Space is bounded and a request takes constant time, whatever its size."""

    def __init__(self, low: int, high: int, full: int):
        self.low, self.high, self.full_exit = low, high, full
        self.at, self.taken = [low], [0]
        self.exit_low, self.exit_high = low, high

    def add(self, w: int) -> None:
        if self.full_exit >= w:
            self.full_exit -= w
        if w > self.exit_high:       # refused, whatever the entry
            return
        if w <= self.exit_low:       # accepted, whatever the entry
            self.exit_low -= w
            self.exit_high -= w
            if self.at is not None:
                self.taken = [t + w for t in self.taken]
            return
        if self.at is None:
            # those that accept end from 0 on, those that refuse below w
            self.exit_low, self.exit_high = 0, max(self.exit_high - w, w - 1)
            return
        at, taken = [], []
        for a, t, end in zip(self.at, self.taken, [*self.at[1:], self.high + 1]):
            # the entries from w + t on accept
            for x, y, lost in ((a, min(end, w + t), t), (max(a, w + t), end, t + w)):
                if x < y and not (taken and taken[-1] == lost):
                    at.append(x)
                    taken.append(lost)
        ends = [*at[1:], self.high + 1]
        self.exit_low = min(x - t for x, t in zip(at, taken))
        self.exit_high = max(y - 1 - t for y, t in zip(ends, taken))
        self.at, self.taken = (at, taken) if len(at) <= PIECES else (None, None)


def _entry_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done, segment, state = [], None, None

    def row():
        return {"stock_id": segment[0], "_p": segment[1], "opening": given[0], "full": given[1],
                "full_exit": state.full_exit, "low": state.low, "high": state.high,
                "exit_low": state.exit_low, "exit_high": state.exit_high, "at": state.at, "taken": state.taken}
    for b in batches:
        for k, p, w, o, full, low, high in zip(*(b[c].tolist() for c in
                                                 ("stock_id", "_p", "qte", "_o", "full", "low", "high"))):
            if (k, p) != segment:
                if segment is not None:
                    done.append(row())
                segment, given, state = (k, p), (o, full), EntryMap(low, high, full)
            state.add(w)
    if segment is not None:
        done.append(row())
    if done:
        yield pd.DataFrame(done)


def _image(at, taken, high: int, low: int, top: int) -> tuple[int, int]:
    """Range of the exits of the entries low to top."""
    found = [(max(a, low) - t, min(end - 1, top) - t) for a, t, end in zip(at, taken, [*at[1:], high + 1])
             if a <= top and end > low]
    return min(x for x, _ in found), max(y for _, y in found)


def _chain_maps(segments: pd.DataFrame) -> pd.DataFrame:
    """Entry stock of each segment of one spanning material, in order, as far as the maps
    give it (else null), and the range that is left for the others."""
    s = segments.sort_values("_p")
    low = high = int(s["opening"].iloc[0])
    lows, highs, starts = [], [], []
    for x in s.itertuples(index=False):
        exact = low == high
        pieces = x.at is not None and x.low <= low and high <= x.high
        lows.append(low)
        highs.append(high)
        starts.append(low if exact else None)
        if exact and low == x.full:
            low = high = int(x.full_exit)
        elif pieces:
            low, high = _image([int(v) for v in x.at], [int(v) for v in x.taken], int(x.high), low, high)
        else:
            low, high = int(x.exit_low), int(x.exit_high)
    return pd.DataFrame({"stock_id": s["stock_id"].to_numpy(), "_p": s.iloc[:, 1].to_numpy(),
                         "opening": s["opening"].to_numpy(), "full": s["full"].to_numpy(), "low": lows,
                         "high": highs, "_start": pd.array(starts, dtype="Int64")})


def _deduction_starts(s: DataFrame, spanning: list) -> DataFrame:
    """(stock_id, _p, _start) of every segment of the spanning materials.

    Once a request of w was refused, less than w is left, and it only falls. So a
    segment is entered either with the opening stock less all earlier requests
    (``full``), or with less than the largest request before it. Each round maps
    these ranges through all segments at the same time and chains the maps: an entry known exactly
    carries on through every map that covers it, and the others' ranges narrow to the
    exits before them. Refusals leave little, so ranges fall fast and a few
    rounds do; a round makes at least the first open entry of a material exact."""
    rows = _rows_of(s, "stock_id", spanning)
    sums = rows.groupBy("stock_id", "_p").agg(
        F.sum("qte").alias("total"), F.max("qte").alias("top"), F.first("opening").alias("_o"))
    before = Window.partitionBy("stock_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    most = F.max("top").over(before)
    todo = sums.select(
        "stock_id", "_p", "_o", (F.col("_o") - F.coalesce(F.sum("total").over(before), F.lit(0))).alias("full"),
        F.when(most.isNull(), F.col("_o")).otherwise(0).alias("low"),
        F.when(most.isNull(), F.col("_o")).otherwise(F.greatest(most - 1, F.lit(0))).alias("high")).checkpoint()
    starts = None
    while True:
        # one row per segment of a spanning material: at most two per partition
        maps = rows.join(F.broadcast(todo), ["stock_id", "_p"]).mapInPandas(_entry_maps, MAP_SCHEMA)
        chained = maps.groupBy("stock_id").applyInPandas(_chain_maps, CHAIN_SCHEMA).checkpoint()
        left = chained.where(F.col("_start").isNull()).select("stock_id").distinct()
        known = chained.join(left, "stock_id", "left_anti").select("stock_id", "_p", "_start")
        starts = known if starts is None else starts.unionByName(known)
        if left.isEmpty():
            return starts
        todo = (chained.join(left, "stock_id", "left_semi")
                .select("stock_id", "_p", F.col("opening").alias("_o"), "full", "low", "high").checkpoint())


def greedy_deduction(requests: DataFrame, order: list[str]) -> DataFrame:
    """``requests``: req_id, stock_id, qte (> 0), opening, plus ``order``
    columns giving the arrival order within a material (ties broken by the
    last of them, which must be unique). Returns req_id, stock_id, qte,
    accepted, the amount available before the request and what remains.

    Every segment gets its entry stock and is folded where its rows lie (see the module's
    text)."""
    cols = ["req_id", "stock_id", "qte", "opening", *[c for c in order if c not in
                                                       ("req_id", "stock_id", "qte", "opening")]]
    s, spanning = _range_split(requests.select(*cols), "stock_id", order)
    if spanning:
        starts = F.broadcast(_deduction_starts(s, spanning))   # at most two rows per partition
        s = (s.join(starts, ["stock_id", "_p"], "left")
             .withColumn("_start", F.coalesce("_start", "opening")))
    else:
        s = s.withColumn("_start", F.col("opening"))
    # the rows are in their partitions and in order: the fold needs no further shuffle
    return (s.select("req_id", "stock_id", "qte", "_start", "_p").where(F.col("_start").isNotNull())
            .mapInArrow(_deduct, DEDUCTION_SCHEMA))


# ---------------------------------------------------------------------------
# Log-in lockout: the n-th failure in a row locks the account for a while
# ---------------------------------------------------------------------------

LOCKOUT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("tentatives", T.IntegerType()),
    T.StructField("bloque_jusqu", T.TimestampNTZType()),
])

# the ``_u`` of a state without a lock
NO_LOCK = -(1 << 62)

OUTCOME_OK = "OK"
OUTCOME_FAILED = "ECHEC"
OUTCOME_LOCKED = "BLOQUE"
OUTCOME_REFUSED = "REFUSE"
OUTCOME_UNKNOWN = "INCONNU"


def lockout_step(state: tuple, ts, success: bool, max_failures: int, lock):
    """One try: (count, locked_until) -> (new state, outcome)."""
    count, until = state
    if until is not None and ts < until:
        return (count, until), OUTCOME_REFUSED
    if success:
        return (0, None), OUTCOME_OK
    count += 1
    if count >= max_failures:
        return (0, ts + lock), OUTCOME_LOCKED
    # a lock that has run out stays recorded until the next success
    return (count, until), OUTCOME_FAILED


def _lockout(max_failures: int, lock_minutes: float):
    """Sequential lockout over rows sorted by (user, partition, order); a segment
    begins with its entry state ``_c`` (count) and ``_u`` (locked until, us)."""
    lock = np.timedelta64(int(lock_minutes * 60_000_000), "us")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, state = None, (0, None)
        for b in batches:
            keys, parts = b["user_id"].to_numpy(), b["_p"].to_numpy()
            ts = b["ts"].to_numpy().astype("datetime64[us]")
            ok = b["success"].to_numpy(dtype=bool)
            c0, u0 = b["_c"].to_numpy(), b["_u"].to_numpy()
            n = len(b)
            outcome = np.empty(n, dtype=object)
            count = np.zeros(n, dtype=np.int32)
            until = np.full(n, np.datetime64("NaT"), dtype="datetime64[us]")
            for i in range(n):
                if (keys[i], parts[i]) != segment:
                    segment = (keys[i], parts[i])
                    state = (int(c0[i]), None if u0[i] == NO_LOCK else np.datetime64(int(u0[i]), "us"))
                state, outcome[i] = lockout_step(state, ts[i], bool(ok[i]), max_failures, lock)
                count[i] = state[0]
                if state[1] is not None:
                    until[i] = state[1]
            yield pd.DataFrame({"event_id": b["event_id"].to_numpy(dtype=np.int64),
                                "user_id": keys.astype(np.int64), "ts": pd.Series(ts),
                                "success": ok, "outcome": outcome, "tentatives": count,
                                "bloque_jusqu": pd.Series(until)})
    return run


# lock end of a transfer-table state: none, carried from the entry state
# (inactive inside the segment), or set by a lock inside the segment
U_NONE, U_CARRY, U_SET = 0, 1, 2

LOCK_TABLE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("_p", T.IntegerType()),
    T.StructField("c0", T.IntegerType()), T.StructField("u0", T.LongType()),
    T.StructField("ts0", T.LongType()), T.StructField("l_at", T.ArrayType(T.LongType())),
    T.StructField("e_c", T.ArrayType(T.IntegerType())), T.StructField("e_kind", T.ArrayType(T.IntegerType())),
    T.StructField("e_u", T.ArrayType(T.LongType())),
    T.StructField("l_c", T.ArrayType(T.IntegerType())), T.StructField("l_kind", T.ArrayType(T.IntegerType())),
    T.StructField("l_u", T.ArrayType(T.LongType())),
])


class _LockSegment:
    """Transfer table of one segment of a user's tries, built in one pass.

    An entry state either has no active lock (class E_c: count c, any
    expired lock end) or has a lock covering the first k tries (class L_k;
    its count is then 0, since a lock resets the count and refused tries do
    not count). All classes are run in lockstep, and classes whose states become
    equal are merged. A locked state waits, in order of its end, until a try comes
    after that, so a try only touches the few states that are not locked. Only the
    tries within one lock period of the segment's start matter for k."""

    def __init__(self, key, part, ts0, stored, max_failures, lock_us):
        self.key, self.part, self.ts0, self.stored = key, part, ts0, stored
        self.m, self.lock = max_failures, lock_us
        self.first_ts: list = []
        self.runs: dict = {(c, U_CARRY, 0): [("E", c)] for c in range(max_failures)}
        self.locked: deque = deque()     # (end, classes), ends rising
        self.n = 0

    def add(self, ts, ok):
        if self.n >= 1 and len(self.first_ts) == self.n:
            # the lock covered the tries so far: class L_n joins, count 0
            self.runs.setdefault((0, U_CARRY, 0), []).append(("L", self.n))
        if ts < self.ts0 + self.lock:
            self.first_ts.append(ts)
        while self.locked and self.locked[0][0] <= ts:
            end, classes = self.locked.popleft()
            self.runs.setdefault((0, U_SET, end), []).extend(classes)
        nxt: dict = {}
        for (c, kind, u), classes in self.runs.items():
            if not ok and c + 1 >= self.m:
                end = ts + self.lock
                if self.locked and self.locked[-1][0] == end:
                    self.locked[-1][1].extend(classes)
                else:
                    self.locked.append((end, list(classes)))
                continue
            state = (0, U_NONE, 0) if ok else (c + 1, kind, u)
            if state in nxt:
                nxt[state].extend(classes)
            else:
                nxt[state] = classes
        self.runs = nxt
        self.n += 1

    def finish(self) -> dict:
        if len(self.first_ts) == self.n:
            self.runs.setdefault((0, U_CARRY, 0), []).append(("L", self.n))
        e = [None] * self.m
        lk = [None] * len(self.first_ts)
        ends = [((0, U_SET, end), classes) for end, classes in self.locked]
        for st, classes in [*self.runs.items(), *ends]:
            for kind, i in classes:
                if kind == "E":
                    e[i] = st
                else:
                    lk[i - 1] = st
        # L_k stands for lock ends after first_ts[k - 1]: kept where the state changes
        keep = [i for i in range(len(lk)) if i == 0 or lk[i] != lk[i - 1]]
        return {"user_id": int(self.key), "_p": int(self.part), "c0": int(self.stored[0]),
                "u0": int(self.stored[1]), "ts0": int(self.ts0),
                "l_at": [self.first_ts[i] for i in keep],
                "e_c": [x[0] for x in e], "e_kind": [x[1] for x in e], "e_u": [x[2] for x in e],
                "l_c": [lk[i][0] for i in keep], "l_kind": [lk[i][1] for i in keep],
                "l_u": [lk[i][2] for i in keep]}


def _lockout_tables(max_failures: int, lock_minutes: float):
    lock_us = int(lock_minutes * 60_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, seg = [], None
        for b in batches:
            us = b["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            for k, p, t, ok, c0, u0 in zip(b["user_id"].to_numpy(), b["_p"].to_numpy(), us,
                                           b["success"].to_numpy(dtype=bool), b["c0"].to_numpy(),
                                           b["u0"].to_numpy()):
                if seg is None or (seg.key, seg.part) != (k, p):
                    if seg is not None:
                        out.append(seg.finish())
                    seg = _LockSegment(k, p, int(t), (c0, u0), max_failures, lock_us)
                seg.add(int(t), bool(ok))
        if seg is not None:
            out.append(seg.finish())
        if out:
            yield pd.DataFrame(out)
    return run


def _chain_locks(segments: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each segment of one spanning user, in partition order."""
    s = segments.sort_values("_p")
    c, u, counts, untils = int(s["c0"].iloc[0]), int(s["u0"].iloc[0]), [], []
    for x in s.to_dict("records"):
        counts.append(c)
        untils.append(u)
        if u <= x["ts0"]:
            c, kind, end = x["e_c"][c], x["e_kind"][c], x["e_u"][c]
        else:
            k = bisect_left(list(x["l_at"]), u) - 1
            c, kind, end = x["l_c"][k], x["l_kind"][k], x["l_u"][k]
        u = NO_LOCK if kind == U_NONE else u if kind == U_CARRY else int(end)
    return pd.DataFrame({"user_id": s["user_id"], "_p": s["_p"], "_c": counts, "_u": untils})


def lockout_fold(attempts: DataFrame, max_failures: int, lock_minutes: float) -> DataFrame:
    """``attempts``: event_id (unique), user_id, ts, success and the user's stored
    state, ``c0`` (count) and ``u0`` (locked until, us; NO_LOCK: never). Every user is
    folded in segments from their exact entry states (see the module's text)."""
    s, spanning = _range_split(attempts.select("event_id", "user_id", "ts", "success", "c0", "u0"),
                               "user_id", ["ts", "event_id"])
    if spanning:
        tables = _rows_of(s, "user_id", spanning).mapInPandas(
            _lockout_tables(max_failures, lock_minutes), LOCK_TABLE_SCHEMA)
        starts = tables.groupBy("user_id").applyInPandas(_chain_locks, "user_id long, _p int, _c int, _u long")
        # at most two rows per partition
        s = (s.join(F.broadcast(starts), ["user_id", "_p"], "left")
             .withColumn("_c", F.coalesce("_c", "c0")).withColumn("_u", F.coalesce("_u", "u0")))
    else:
        s = s.withColumn("_c", F.col("c0")).withColumn("_u", F.col("u0"))
    return s.mapInPandas(_lockout(max_failures, lock_minutes), LOCKOUT_SCHEMA)
