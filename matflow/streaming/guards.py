"""Per-request guards re-aimed as windowed / stateful jobs over an event log
(R1-R4 batch twins). The streaming versions are in ``streams``.

Windows are epoch-aligned tumbling windows (``F.window``), or begin at a client's first
hit (``first_hit_windows``); every aggregate is partial on the map side, so a client
with a large share of the requests is pre-reduced before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..plans.fold import NO_LOCK, OUTCOME_UNKNOWN, lockout_fold


# stands for a null client in joins
NOBODY = -(1 << 62)


def _windowed(df: DataFrame, width: str, by: list[str], limit: int) -> DataFrame:
    w = F.window("ts", width)
    return (df.groupBy(w.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("requetes"))
            .select(*by, F.col("w.start").alias("debut"), F.col("w.end").alias("fin"), "requetes",
                    (F.col("requetes") > limit).alias("depasse"),
                    F.greatest(F.col("requetes") - limit, F.lit(0)).alias("refusees")))


def rate_limit_windows(requests: DataFrame, width: str = C.RATE_WINDOW,
                       limit: int = C.RATE_LIMIT) -> DataFrame:
    """Requests per client and window; over the limit the rest is refused."""
    return _windowed(requests, width, ["user_id"], limit)


def login_rate_windows(attempts: DataFrame, width: str = C.RATE_WINDOW,
                       limit: int = C.LOGIN_RATE_LIMIT) -> DataFrame:
    """R2: failed log-ins per client and window (successes are not counted)."""
    return _windowed(attempts.where(~F.col("success")), width, ["user_id"], limit)


def first_hit_windows(hits: DataFrame, width: str = C.RATE_WINDOW, limit: int = C.RATE_LIMIT) -> DataFrame:
    """R1 as the source's limiter counts: a client's window begins at its first hit after
    the window before it ended, so windows follow the hits, not the clock.

    Every time of a hit points to the client's first hit at least ``width`` later; the starts are
    those reached from the first hit, found by pointer doubling (rounds grow with the
    logarithm of the windows of a client). Times are dealt by (client, stretch of
    ``width``), so a client with any share of the hits is spread. One row per window."""
    span = int(dt.timedelta(**{width.split()[1]: float(width.split()[0])}).total_seconds() * 1_000_000)
    client = F.coalesce(F.col("user_id"), F.lit(NOBODY)).alias("user_id")
    at = hits.select(client, "ts").groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("part", F.floor(F.col("us") / F.lit(span))).checkpoint()
    none = F.lit(None).cast("long")
    both = (at.select("user_id", none.alias("us"), F.col("us").alias("at"), F.col("us").alias("hit"))
            .unionByName(at.select("user_id", "us", (F.col("us") + span).alias("at"), none.alias("hit")))
            .withColumn("part", F.floor(F.col("at") / F.lit(span))))
    later = Window.partitionBy("user_id", "part").orderBy(F.desc("at")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    parts = both.groupBy("user_id", "part").agg(F.min("hit").alias("hit"))
    beyond = parts.select("user_id", "part", F.min("hit").over(
        Window.partitionBy("user_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("_beyond"))
    jump = (both.withColumn("_in", F.min("hit").over(later)).where(F.col("us").isNotNull())
            .join(beyond, ["user_id", "part"])
            .select("user_id", "us", F.coalesce("_in", "_beyond").alias("next")).where(F.col("next").isNotNull())
            .checkpoint())
    starts = at.groupBy("user_id").agg(F.min("us").alias("us"))
    while not jump.isEmpty():
        starts = starts.unionByName(starts.join(jump, ["user_id", "us"]).select("user_id", F.col("next").alias("us"))).checkpoint()
        ahead = jump.select("user_id", F.col("us").alias("next"), F.col("next").alias("far"))
        jump = jump.join(ahead, ["user_id", "next"]).select("user_id", "us", F.col("far").alias("next")).checkpoint()
    # a stretch holds at most one start, and a hit's start lies in its stretch or the one before
    own = F.floor(F.col("start") / F.lit(span))
    reach = (starts.withColumnRenamed("us", "start").withColumn("part", F.explode(F.array(own, own + 1))))
    inside = (F.col("us") >= F.col("start")) & (F.col("us") < F.col("start") + span)
    total = at.join(reach, ["user_id", "part"]).where(inside).groupBy("user_id", "start").agg(F.sum("n").alias("requetes"))

    def time(us):
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return total.select(F.nullif(F.col("user_id"), F.lit(NOBODY)).alias("user_id"), time(F.col("start")).alias("debut"), time(F.col("start") + span).alias("fin"), "requetes",
                        (F.col("requetes") > limit).alias("depasse"),
                        F.greatest(F.col("requetes") - limit, F.lit(0)).alias("refusees"))


def login_lockout(attempts: DataFrame, users: DataFrame | None = None,
                  max_failures: int = C.MAX_FAILURES, lock_minutes: float = C.LOCK_MINUTES) -> DataFrame:
    """Per user in time order, the n-th failure in a row locks the account
    and resets the count; tries while locked are refused and not counted; a
    success resets everything. One row per try.

    With ``users`` each account starts from its stored ``tentatives`` and
    ``bloque_jusqu`` (epoch ms), and tries on unknown accounts are answered
    ``INCONNU`` and not counted. A user with any share of the tries is split over
    tasks, exactly."""
    if users is None:
        return lockout_fold(attempts.withColumns({"c0": F.lit(0), "u0": F.lit(NO_LOCK)}), max_failures, lock_minutes)
    u = users.select(F.col("id").alias("_uid"), F.least(F.col("tentatives"), F.lit(max_failures - 1)).alias("c0"),
                     F.coalesce(F.col("bloque_jusqu") * 1000, F.lit(NO_LOCK)).alias("u0"))
    j = attempts.join(u, attempts.user_id == u._uid, "left")
    known = lockout_fold(j.where(F.col("_uid").isNotNull()), max_failures, lock_minutes)
    unknown = j.where(F.col("_uid").isNull()).select(
        "event_id", "user_id", "ts", "success", F.lit(OUTCOME_UNKNOWN).alias("outcome"),
        F.lit(0).alias("tentatives"), F.lit(None).cast("timestamp_ntz").alias("bloque_jusqu"))
    return known.unionByName(unknown)


def server_error_windows(log: DataFrame, width: str = C.RATE_WINDOW) -> DataFrame:
    """Requests, server errors and mean duration per window."""
    w = F.window("ts", width)
    d = F.col("duration_ms").cast("decimal(18,2)")
    return (log.groupBy(w.alias("w"))
            .agg(F.count(F.lit(1)).alias("requetes"),
                 F.count_if(F.col("status") >= 500).alias("erreurs"),
                 F.sum(d).alias("duree_totale"))
            .select(F.col("w.start").alias("debut"), F.col("w.end").alias("fin"), "requetes", "erreurs",
                    F.col("duree_totale").cast("decimal(20,2)").alias("duree_totale"),
                    mean_half_up(F.col("duree_totale"), F.col("requetes"), 3).alias("duree_moyenne")))


def mean_half_up(total: F.Column, n: F.Column, scale: int) -> F.Column:
    """total / n rounded half up to ``scale`` decimals, in exact integer
    arithmetic (``total`` has 2 decimals, n > 0)."""
    from ..functions.exprs import div_half_up
    return div_half_up(total, n, scale)
