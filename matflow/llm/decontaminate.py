"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are normalised to words and entered into one suffix
automaton (suffix links, longest lengths, and for each state the items that hold
its string); training texts then stream through it: at
every word the automaton gives the length of the longest suffix read that occurs
in an item. At ``window`` words or more, those words are a hit, as is a shorter
item matched whole. This is one narrow pass without any shuffle.

Items are cut into parts of ``PART_WORDS`` windows (neighbours overlap, so no window is
lost) and dealt to blocks of about ``BLOCK_CHARS`` characters, whatever the length of an
item and however often its id or text is repeated. Each block's automaton is built in a
task and stored; a pass fetches one block's at a time, so what is sent out stays bounded.
The hits that several blocks find in a row's text are brought together by a row id.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import fresh, shared_table

WINDOW = 13
#: Characters of benchmark text in one automaton (bounds what is sent out).
BLOCK_CHARS = 2_000_000
#: Windows in one part of a long item.
PART_WORDS = 4096

# word characters: 0-9, a-z, and everything beyond ASCII; A-Z is lower-cased
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32)
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of all items, over word ids."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, set] = defaultdict(set)   # state of a whole short item -> items
        paths, pairs = [], set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            pairs.update(zip(ids, ids[1:]))
            last, path = 0, []
            for c in ids:
                last = self._extend(last, c)
            paths.append((item, ids))
        self.owners: list[set] = [set() for _ in self.next]
        self.least = min((min(len(ids), window) for _, ids in paths), default=0)
        for item, ids in paths:
            state, length = 0, 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                length = i + 1
                if length >= window:
                    # the state of the last ``window`` words
                    s = state
                    while self.length[self.link[s]] >= window:
                        s = self.link[s]
                    self.owners[s].add(item)
            if length < window:
                self.short[state].add((item, length))
        # nearest short item at or above each state, along the suffix links
        self.above = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.above[s] = s if s in self.short else self.above[self.link[s]]
        size = len(self.vocabulary)
        self.pairs = np.sort(np.array([a * size + b for a, b in pairs], dtype=np.int64))

    def _extend(self, last: int, c: int) -> int:
        """The state of the string of ``last`` followed by c."""
        got = self.next[last].get(c)
        if got is not None:
            if self.length[got] == self.length[last] + 1:
                return got
            return self._clone(last, c, got)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _stream(self, ids: list[int], offset: int, spans: list, found: set) -> None:
        """Words ids of a text from word ``offset``: add hit spans and items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state, matched = 0, 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= window:
                spans.append((offset + i + 1 - matched, offset + i + 1))
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found.update(self.owners[s])
            # short items that end here: whole strings at or above this state
            s = self.above[state]
            while s > 0:
                for item, n in self.short[s]:
                    if n <= matched:
                        spans.append((offset + i + 1 - n, offset + i + 1))
                        found.add(item)
                s = self.above[link[s]] if link[s] > 0 else -1

    def match(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, merged hit spans in words, items) of each text.

        Only runs of words whose every neighbouring pair occurs in an item are
        streamed: no match can cross another pair."""
        get = self.vocabulary.get
        size = len(self.vocabulary)
        out = []
        for text in texts:
            words = words_of(text)
            n, spans, found = len(words), [], set()
            if n and size and self.least and n >= self.least:
                ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
                known = ids >= 0
                if self.least == 1:
                    bounds = [(0, n)]
                else:
                    code = ids[:-1] * size + ids[1:]
                    good = known[:-1] & known[1:]
                    if len(self.pairs):
                        where = np.searchsorted(self.pairs, code)
                        where[where == len(self.pairs)] = 0
                        good &= self.pairs[where] == code
                    else:
                        good[:] = False
                    edge = np.flatnonzero(np.diff(np.r_[0, good.astype(np.int8), 0]))
                    bounds = [(a, z + 1) for a, z in zip(edge[::2], edge[1::2]) if z + 1 - a >= self.least]
                for a, z in bounds:
                    self._stream(ids[a:z].tolist(), int(a), spans, found)
            found.discard(None)     # an item without id hits, but has no name to list
            out.append((n, merge_spans(spans), sorted(found)))
        return out


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


RESULT = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,clean:string>"
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                   ("items", pa.list_(pa.string())), ("clean", pa.string())])


def _struct(n: int, spans, items, text: str | None) -> dict:
    """``text`` is given where the text without the hits is wanted."""
    return {"n_words": n, "n_hit": sum(z - a for a, z in spans),
            "spans": [{"start": a, "end": z} for a, z in spans], "items": items,
            "clean": remove_spans(text, spans) if spans else None}


def _matcher(stored: bytes, cut: bool):
    made = []       # in a task: the automaton, read at its first batch

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(pickle.loads(stored))
        values = texts.to_pylist()
        return pa.array([_struct(*x, t if cut else None) for x, t in zip(made[0].match(values), values)], _KIND)
    return F.arrow_udf(run, RESULT).asNondeterministic()


def _joined(cut: bool):
    """The hits of one text by several automata, as one struct."""
    def run(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), hits.to_pylist()):
            spans = merge_spans((s["start"], s["end"]) for f in found or [] for s in f["spans"])
            out.append(_struct(len(words_of(text)), spans, sorted({i for f in found or [] for i in f["items"]}),
                               text if cut else None))
        return pa.array(out, _KIND)
    return F.arrow_udf(run, RESULT).asNondeterministic()


def _cut_items(window: int, size: int):
    kind = pa.schema([("item_id", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - window, 0) + 1, size):
                    part = words[at:at + size + window - 1]
                    if part:
                        ids.append(item)
                        texts.append(b" ".join(part).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema=kind)
    return run


def _build(window: int):
    def run(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part["item_id"].to_pylist(), part["text"].to_pylist()),
                      key=lambda r: (r[0] is None, r[0] or "", r[1]))
        stored = pickle.dumps(Automaton(rows, window), protocol=pickle.HIGHEST_PROTOCOL)
        return pa.table({"block": part["block"].slice(0, 1), "automaton": pa.array([stored], pa.binary())})
    return run


def _automata(benchmark: DataFrame, window: int, block_chars: int) -> tuple[int, DataFrame]:
    """(number of blocks, table (block, automaton)), one automaton of each block, built in
    tasks. A block without a part has no row."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    parts = shared_table(items.mapInArrow(_cut_items(window, PART_WORDS), "item_id string, text string").distinct(), "parts")
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(-(-total // block_chars)) or 1
    # by id and text, so neither a repeated id nor a repeated text fills a block
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")
    made = (parts.withColumn("block", block).groupBy("block")
            .applyInArrow(_build(window), "block int, automaton binary"))
    return blocks, shared_table(made, "automata")


def _one(automata: DataFrame, block: int, window: int) -> bytes:
    row = automata.where(F.col("block") == block).select("automaton").first()
    return bytes(row[0]) if row else pickle.dumps(Automaton([], window))


def _with_found(docs: DataFrame, benchmark: DataFrame, name: str, window: int, block_chars: int,
                cut: bool = False) -> DataFrame:
    blocks, automata = _automata(benchmark, window, block_chars)
    if blocks == 1:
        return docs.withColumn(name, _matcher(_one(automata, 0, window), cut)(F.col("text")))
    key, f = fresh(docs, "__row"), fresh(docs, "__f")
    # stored, so that each pass sees the same row ids
    rows = shared_table(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    hits = None
    for b in range(blocks):
        own = (rows.select(key, _matcher(_one(automata, b, window), False)(F.col("text")).alias(f))
               .where(F.col(f"{f}.n_hit") > 0))
        own = shared_table(own, "hits")
        hits = own if hits is None else hits.unionByName(own)
    # at most one row per text and block meets here
    merged = hits.groupBy(key).agg(F.collect_list(f).alias(f))
    return rows.join(merged, key, "left").withColumn(name, _joined(cut)(F.col("text"), F.col(f))).drop(key, f)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       coverage: int = 20, block_chars: int = BLOCK_CHARS, cut: bool = False) -> DataFrame:
    """``docs`` with a struct column ``found`` (n_words, n_hit, spans in words,
    items and, with ``cut``, the text without its hits, null without any) and
    ``contaminated``: n_hit > 0 and coverage * n_hit >= n_words.

    Null text has no words and is clean; texts of any length are taken whole; repeated
    rows are judged alike; an empty benchmark finds nothing. Item ids may be of any type
    (listed as text); an item with a null id hits like others but is not listed. Clashing column names get underscores appended."""
    name, flag = fresh(docs, "found"), fresh(docs, "contaminated")
    return (_with_found(docs, benchmark, name, window, block_chars, cut)
            .withColumn(flag, (F.col(f"{name}.n_hit") > 0)
                        & (F.col(f"{name}.n_hit") * coverage >= F.col(f"{name}.n_words"))))


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the hit words (word spans), other characters as they are."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8")
    flat = raw.translate(_TABLE)
    at, places = 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, z in spans:
        out.append(raw[done:places[a][0]])
        done = places[z - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20,
                  length_col: str = "n_chars") -> DataFrame:
    """Documents over the coverage limit go; from the others every hit span (of at
    least ``window`` words or a whole item) is removed. Columns are kept; only the
    text of such documents changes, and with it ``length_col`` if there."""
    name, flag = fresh(docs, "found"), fresh(docs, "contaminated")
    judged = find_contamination(docs, benchmark, window, coverage, cut=True).where(~F.col(flag))
    hit = F.col(f"{name}.n_hit") > 0
    out = judged.withColumn("text", F.when(hit, F.col(f"{name}.clean")).otherwise(F.col("text")))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(hit, F.length("text").cast(kind)).otherwise(F.col(length_col)))
    return out.select(docs.columns)


def digest_items(items) -> F.Column:
    """Lower-case hex SHA-256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda i: i.cast("string")))), 256)
