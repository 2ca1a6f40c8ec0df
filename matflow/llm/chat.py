"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant turns in
turn, ending with the assistant. A turn may be taken as it is (cost 0), relabelled
(``RELABEL``; an unknown role ``NAME``), merged into the turn before it
(``MERGE``, plus the relabelling if roles differ); an empty turn may be inserted
before it (``INSERT``). Dynamic programming over the automaton of legal turns
(states: start, system, user, assistant) finds the cheapest repair; of equal costs
the first of take, merge, insert, and then the lower state, is chosen.

A step of the automaton is a small (min, +) matrix, and matrices of consecutive
turns compose. Turns are therefore range-partitioned by (conversation, turn), so a
conversation of any length is spread over tasks: each task composes the matrices
of its first and last conversation, the few segments of conversations that span
tasks are chained, and then all tasks find their turns' choices at the same time,
between known states. Texts take part only at the end, when each source row is
rendered to its own fragment; the fragments of a conversation in (turn) order are
the rendered conversation, of whatever length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RELABEL, NAME, MERGE, INSERT = 3, 1, 1, 2
BIG = 1 << 40

# Fixed values of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def role_code(role: str | None) -> int:
    """1-3 for the three roles (ASCII white space around and case ignored), 0 for others."""
    name = (role or "").strip(" \t\n\x0b\x0c\r").lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _label_cost(role: int, state: int) -> int:
    return NAME if role == 0 else 0 if role == state else RELABEL


def _options(role: int):
    """{(from, to): (cost, action, inserted state or 0)} for a turn of ``role``."""
    best: dict = {}

    def offer(x, y, cost, action, inserted=0):
        if cost < best.get((x, y), (BIG,))[0]:
            best[x, y] = (cost, action, inserted)
    for x, y in sorted(LEGAL):
        offer(x, y, _label_cost(role, y), "take")
    for x in (SYSTEM, USER, ASSISTANT):
        offer(x, x, MERGE + _label_cost(role, x), "merge")
    for x, z in sorted(LEGAL):
        for z2, y in sorted(LEGAL):
            if z == z2:
                offer(x, y, INSERT + _label_cost(role, y), "insert", z)
    return best


STEP = [_options(r) for r in range(4)]
#: Turns to insert at the end, and their cost, by the state after the last turn.
ENDING = {START: (BIG, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)),
          ASSISTANT: (0, ())}


def forward(costs: list[int], role: int) -> list[int]:
    out = [BIG] * 4
    for (x, y), (c, _, _) in STEP[role].items():
        if costs[x] + c < out[y]:
            out[y] = costs[x] + c
    return out


def segment_matrix(roles) -> list[int]:
    """16 least costs from each entry state to each exit state."""
    rows = [[0 if x == y else BIG for y in range(4)] for x in range(4)]
    for r in roles:
        rows = [forward(row, r) for row in rows]
    return [min(v, BIG) for row in rows for v in row]


def choose(roles: list[int], entry: int = START, exit_: int | None = None):
    """[(action, state, inserted state)] of a segment's turns, entered in state
    ``entry`` and left in ``exit_`` (None: the cheapest legal end)."""
    costs = [[0 if x == entry else BIG for x in range(4)]]
    for r in roles:
        costs.append(forward(costs[-1], r))
    if exit_ is None:
        exit_ = min(range(4), key=lambda s: (costs[-1][s] + ENDING[s][0], s))
    out, state = [], exit_
    for i in range(len(roles) - 1, -1, -1):
        step, now = STEP[roles[i]], costs[i + 1][state]
        before = min(x for x in range(4) if (x, state) in step and costs[i][x] + step[x, state][0] == now)
        out.append((step[before, state][1], state, step[before, state][2]))
        state = before
    return out[::-1]


def _segments(batches):
    """Matrices of the first and the last conversation of each partition; rows are
    (pid, rid, conv_id, code) in order."""
    def row(state):
        pid, conv, rows, n = state
        return {"pid": pid, "conv_id": conv, "costs": [min(v, BIG) for r in rows for v in r], "n": n}
    now, first = None, True
    schema = pa.schema([("pid", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64())),
                        ("n", pa.int64())])
    for batch in batches:
        out = []
        for pid, conv, code in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if now is None or now[0] != pid or now[1] != conv:
                if now is not None and (first or now[0] != pid):
                    out.append(row(now))
                first = now is None or now[0] != pid
                now = [pid, conv, [[0 if x == y else BIG for y in range(4)] for x in range(4)], 0]
            now[2] = [forward(r, code) for r in now[2]]
            now[3] += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row(now)], schema=schema)


def _chain(segments):
    """Entry and exit state of each segment of one spanning conversation; one row
    per partition it spans."""
    import pandas as pd
    s = segments.sort_values("pid")
    costs = [[0 if x == START else BIG for x in range(4)]]
    for m in s["costs"]:
        costs.append([min(costs[-1][x] + int(m[4 * x + y]) for x in range(4)) for y in range(4)])
    state = min(range(4), key=lambda y: (costs[-1][y] + ENDING[y][0], y))
    entry, exit_ = [], []
    for i in range(len(s) - 1, -1, -1):
        m = s["costs"].iloc[i]
        exit_.append(state)
        state = min(x for x in range(4) if costs[i][x] + int(m[4 * x + state]) == costs[i + 1][state])
        entry.append(state)
    # the last segment of the conversation ends by itself
    return pd.DataFrame({"pid": s["pid"], "conv_id": s["conv_id"], "entry": entry[::-1], "exit": exit_[::-1],
                         "last": [False] * (len(s) - 1) + [True]})


def _decide(batches):
    """Choices for all turns; rows are (pid, rid, conv_id, code, entry, exit, last)
    in order. Held: the codes of one conversation's rows in one partition."""
    schema = pa.schema([("rid", pa.int64()), ("action", pa.string()), ("new_role", pa.string()),
                        ("inserted", pa.string()), ("first", pa.bool_()), ("ending", pa.list_(pa.string()))])

    name = (None, *ROLES)

    def out(rids, codes, bound):
        entry, exit_, last = bound
        if entry is None:
            picks, first, ends = choose(codes), True, True
        else:
            picks, first, ends = choose(codes, entry, exit_), entry == START, last
        rows = [{"rid": r, "action": a, "new_role": name[s], "inserted": name[z], "first": False, "ending": None}
                for r, (a, s, z) in zip(rids, picks)]
        rows[0]["first"] = first
        if ends:
            rows[-1]["ending"] = [name[z] for z in ENDING[picks[-1][1]][1]]
        return rows
    key, rids, codes, bound, done = None, [], [], None, []
    for batch in batches:
        for pid, rid, conv, code, *limits in zip(*(c.to_pylist() for c in batch.columns)):
            if (pid, conv) != key:
                if rids:
                    done += out(rids, codes, bound)
                key, rids, codes, bound = (pid, conv), [], [], limits
                if len(done) >= 10_000:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done = []
            rids.append(rid)
            codes.append(code)
    if rids:
        done += out(rids, codes, bound)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per input row: conv_id, turn, role, action (take, merge, insert),
    new_role, inserted (role of the empty turn put before it), ending (roles of the
    empty turns put after the last turn) and fragment, its part of the rendered text.

    Order in a conversation: turn (nulls first), then role, then the text's hash.
    Rows with a null conv_id are one conversation. Null texts are empty; the form's
    own marks in texts are broken by a space. Repeated rows are turns of their own.
    Other columns are ignored; no rows give no rows."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
             F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    name = F.lower(F.regexp_replace(F.coalesce(F.col("role"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    code = F.coalesce(*[F.when(name == r, F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    stored = shared_table(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("rid"),
                "conv_id", code.alias("code"), "turn", "role", "text"), "turns")
    narrow = (stored.select("pid", "rid", "conv_id", "code")
              .repartition("pid").sortWithinPartitions("pid", "rid"))
    ends = shared_table(narrow.mapInArrow(_segments, "pid int, conv_id long, costs array<long>, n long"), "segments")
    spanning = ends.groupBy("conv_id").count().where("count > 1").select("conv_id")
    # at most two rows per partition from here: bounded by the number of partitions
    spans = (ends.alias("e").join(F.broadcast(spanning.alias("s")), F.expr("e.conv_id <=> s.conv_id"), "left_semi")
             .groupBy("conv_id").applyInPandas(_chain, "pid int, conv_id long, entry int, exit int, last boolean"))
    bounds = shared_table(spans, "bounds")
    limited = narrow.alias("n").join(
        F.broadcast(bounds.alias("b")), F.expr("n.pid = b.pid AND n.conv_id <=> b.conv_id"), "left").select(
        "n.pid", "n.rid", "n.conv_id", "n.code", "b.entry", "b.exit", "b.last").sortWithinPartitions("pid", "rid")
    choices = limited.mapInArrow(
        _decide, "rid long, action string, new_role string, inserted string, first boolean, "
        "ending array<string>")

    def mark(role):
        return F.concat(F.lit(OPEN), role, F.lit("\n"))
    both = stored.join(choices, "rid")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(?=im_(start|end)\|>)", "< |")
    fragment = F.concat(
        F.when((F.col("action") == "merge"), F.lit("\n"))
        .otherwise(F.concat(F.when(F.col("first"), F.lit("")).otherwise(F.lit(CLOSE)),
                            F.coalesce(F.concat(mark(F.col("inserted")), F.lit(CLOSE)), F.lit("")), mark(F.col("new_role")))),
        body,
        F.when(F.col("ending").isNotNull(),
               F.concat(F.lit(CLOSE), F.array_join(F.transform("ending", lambda r: F.concat(mark(r), F.lit(CLOSE))), "")))
        .otherwise(F.lit("")))
    return both.select("conv_id", "turn", "role", "action", "new_role", "inserted", "ending", fragment.alias("fragment"))
