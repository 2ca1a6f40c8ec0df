"""Removal of passages that repeat across documents, by fixed-block anchors.

A passage counts from ``window`` words on. Any window holds a whole block of
``(window + 1) // 2`` words that starts at a multiple of that length, so it is enough
to index these blocks, which do not overlap, and to probe them with the rolling
window of the same length at every word of every document.

1. Documents are packed: some ``PACK_BYTES`` of whole texts a row, compressed, with
   their ids. All tables below are keyed by pack, never by document, passage or
   word, so one passage in any share of the documents makes no hot key.
2. Anchors and probes: a pack sends its distinct block-length hashes, each with a flag
   for "is an indexed block here" and "in two documents here", as sorted gaps of two
   bytes, to the buckets of the hash. A bucket answers with one bit a hash: is there an
   indexed block with it, and another document? A false answer (few hash bits) only costs time.
3. Hits are extended: around them the pack takes every window of ``window`` words
   and sends its 64-bit hash (in a bucket of another hash's bits) with the least id of
   its documents here; a bucket answers with one bit: is there a smaller id elsewhere?
4. The pack marks all words of the windows that a smaller id has, which joins
   neighbouring windows to the maximal repeats, and returns the words left.

Nothing is collected but one sum; what a task holds is one pack or one bucket
(``BUCKET_WORDS`` windows on average; a window counts once a pack). A text is never
cut: a pack with one very long text has its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

WINDOW = 50
#: Text bytes of a pack.
PACK_BYTES = 4 << 20
#: Rolling windows of a bucket, on average.
BUCKET_WORDS = 1 << 21
#: Hash bits of an anchor below the bucket's.
ANCHOR_BITS = 25
#: Distinct words whose hashes a task remembers.
WORDS = 300_000
#: Null ids are larger than all others.
NO_ID = np.iinfo(np.int64).max

# Bases of the two rolling hashes (odd), factors of the final mixing.
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SLICE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _slices(raw: bytes):
    """The text in parts of about a megabyte, cut at white space."""
    at = 0
    while len(raw) - at > 2 * _SLICE:
        # an end within a word is moved to the next white space
        end = at + _SLICE
        while end < len(raw) and raw[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


class _Rolling:
    """Hashes of all runs of k words, for concatenated documents."""

    def __init__(self):
        self.known = _Hashes()
        self.powers: list[list[np.ndarray]] = []

    def words(self, raw: bytes) -> np.ndarray:
        """The hash of each word of a text."""
        parts = []
        for piece in _slices(raw):
            found = piece.split()
            parts.append(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)))
        return np.concatenate(parts)

    def _upto(self, n: int) -> list[list[np.ndarray]]:
        if not self.powers or len(self.powers[0][0]) < n:
            self.powers = []
            for base in _BASE:
                row = []
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(n, b, dtype=np.uint64)
                    p[0] = 1
                    row.append(np.multiply.accumulate(p))
                self.powers.append(row)
        return self.powers

    def of(self, words: np.ndarray, k: int, nth: int) -> np.ndarray:
        """Hash of words[i:i + k] for every i (documents' ends are not looked at)."""
        n = len(words)
        if n < k:
            return np.zeros(0, np.uint64)
        power, inverse = self._upto(n + 1)[nth]
        values = _mix(words) if nth else words
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * inverse[:n], out=sums[1:])
        return _mix((sums[k:] - sums[:n - k + 1]) * power[k - 1:n])


#: One for each worker process: the words' hashes serve all its packs.
_ROLLING = _Rolling()


def _inside(ends: np.ndarray, starts: np.ndarray, total: int, k: int) -> np.ndarray:
    """For each i up to total - k: does i lie in a document that holds words i to i + k - 1?"""
    change = np.zeros(total + 1, np.int32)
    fits = ends - starts >= k
    np.add.at(change, starts[fits], 1)
    np.add.at(change, ends[fits] - k + 1, -1)
    return np.cumsum(change)[:max(0, total - k + 1)] > 0


def _gaps(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Ascending values as 16-bit gaps with two flag bits; a gap of 16383 is a step
    without a value."""
    step = np.diff(values.astype(np.int64), prepend=0)
    skips = step // 16383
    out = np.full(len(step) + int(skips.sum()), 16383 << 2, dtype="<u2")
    out[np.cumsum(skips + 1) - 1] = (step % 16383) << 2 | flags
    return out.tobytes()


def _ungaps(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, "<u2")
    step, real = (raw >> 2).astype(np.int64), raw < 16383 << 2
    return np.cumsum(step)[real], (raw & 3)[real]


# --- packs

_CODEC = ("zstd", 1)
PACK = "pack long, n_words long, ids binary, no_id binary, sizes binary, raw_bytes long, texts binary"


def _packer(pack_bytes: int):
    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        nth = context.partitionId() << 32 if context else 0
        codec = pa.Codec(_CODEC[0], compression_level=_CODEC[1])
        ids, texts, held = [], [], 0

        def pack():
            raw = b"".join(texts)
            words = sum(len(p.split()) for t in texts for p in _slices(t))
            return pa.RecordBatch.from_pylist([{
                "pack": nth, "n_words": words,
                "ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
                "no_id": np.array([i is None for i in ids], "u1").tobytes(),
                "sizes": np.array([len(t) for t in texts], "<i8").tobytes(), "raw_bytes": len(raw),
                "texts": codec.compress(raw, asbytes=True)}], schema=_PACK_SCHEMA)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8")
                ids.append(doc_id)
                texts.append(data)
                held += len(data) + 16
                if held >= pack_bytes:
                    yield pack()
                    nth, ids, texts, held = nth + 1, [], [], 0
        if ids:
            yield pack()
    return run


_PACK_SCHEMA = pa.schema([("pack", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()),
                          ("no_id", pa.binary()), ("sizes", pa.binary()), ("raw_bytes", pa.int64()),
                          ("texts", pa.binary())])


class _Pack:
    """A pack's texts with the hashes of their words."""

    def __init__(self, row: dict, rolling: _Rolling = _ROLLING):
        raw = pa.Codec(_CODEC[0]).decompress(row["texts"], row["raw_bytes"], asbytes=True) if row["raw_bytes"] else b""
        ends = np.cumsum(np.frombuffer(row["sizes"], "<i8")).tolist()
        self.texts = [raw[a:z] for a, z in zip([0, *ends], ends)]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.absent = np.frombuffer(row["no_id"], "u1").astype(bool)
        parts = [rolling.words(t) for t in self.texts]
        self.count = np.array([len(p) for p in parts], np.int64)
        self.stop = np.cumsum(self.count)
        self.start = self.stop - self.count
        self.words = np.concatenate(parts)
        self.doc = np.repeat(np.arange(len(parts)), self.count)
        self.rolling = rolling

    def anchors(self, window: int, bits: int):
        """Distinct codes of the block-length runs, ascending; their flags; and for the
        runs' places (self.at) the number of their code (self.code)."""
        k = (window + 1) // 2
        long = self.count >= window
        here = _inside(self.stop[long], self.start[long], len(self.words), k)
        self.at = np.flatnonzero(here)
        codes = self.rolling.of(self.words, k, 0)[self.at] >> np.uint64(64 - bits)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.code = np.empty(len(codes), np.int64)
        self.code[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)]))
        if not len(first):
            return codes, np.zeros(0, np.int64)
        places = self.at[order]
        docs = self.doc[places]
        aligned = (places - self.start[docs]) % k == 0
        flags = (np.logical_or.reduceat(aligned, first).astype(np.int64) * 2
                 + (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)))
        return codes[first], flags

    def windows(self, hit: np.ndarray, window: int, bucket_bits: int) -> None:
        """The windows around hit codes: their first words (self.first), the distinct ones in
        (bucket, hash) order (self.bucket, self.hash, self.least: least id here), and
        their numbers among these (self.which)."""
        k, n = (window + 1) // 2, len(self.words)
        places = self.at[hit[self.code]]
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.maximum(places - (window - k), self.start[self.doc[places]]), 1)
        np.add.at(change, places + 1, -1)
        near = np.cumsum(change)[:max(0, n - window + 1)] > 0
        self.first = np.flatnonzero(near & _inside(self.stop, self.start, n, window))
        value = self.rolling.of(self.words, window, 0)[self.first]
        bucket = self.rolling.of(self.words, window, 1)[self.first] >> np.uint64(64 - bucket_bits)
        order = np.lexsort((value, bucket))
        value, bucket = value[order], bucket[order]
        new = (np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])])
               if len(value) else np.zeros(0, np.int64))
        self.which = np.empty(len(value), np.int64)
        self.which[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(value)]))
        self.hash, self.bucket = value[new], bucket[new].astype(np.int64)
        rank = np.where(self.absent, NO_ID, self.ids)[self.doc[self.first]]
        self.least = np.minimum.reduceat(rank[order], new) if len(new) else np.zeros(0, np.int64)
        self.rank = rank

    def covered(self, smaller: np.ndarray, window: int) -> np.ndarray:
        """The words to remove: those of a window with a smaller id elsewhere or here."""
        gone = smaller[self.which] | (self.rank > self.least[self.which])
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, self.first[gone], 1)
        np.add.at(change, self.first[gone] + window, -1)
        return np.cumsum(change)[:-1] > 0


def _parts(buckets: np.ndarray):
    """(bucket, first, end) of the runs of equal buckets."""
    edge = np.flatnonzero(np.diff(buckets)) + 1
    for a, z in zip(np.r_[0, edge].tolist(), np.r_[edge, len(buckets)].tolist()):
        if z > a:
            yield int(buckets[a]), a, z


def _answers(rows: list[tuple[int, bytes]], buckets: np.ndarray) -> np.ndarray:
    """One flag per entry from the bit masks of the buckets (none: no)."""
    out = np.zeros(len(buckets), bool)
    masks = dict(rows)
    for b, a, z in _parts(buckets):
        if b in masks:
            out[a:z] = np.unpackbits(np.frombuffer(masks[b], "u1"), count=z - a).astype(bool)
    return out


# --- the four steps

ENTRY = "bucket long, pack long, entries binary, ids binary, which binary"
_ENTRY_SCHEMA = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("entries", pa.binary()),
                           ("ids", pa.binary()), ("which", pa.binary())])
ANSWER = "pack long, step int, bucket long, mask binary"
_ANSWER_SCHEMA = pa.schema([("pack", pa.int64()), ("step", pa.int32()), ("bucket", pa.int64()),
                            ("mask", pa.binary())])


def _anchor_entries(window: int, bucket_bits: int):
    bits = bucket_bits + ANCHOR_BITS

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, flags = _Pack(row).anchors(window, bits)
                low = codes & np.uint64((1 << ANCHOR_BITS) - 1)
                out = [{"bucket": b, "pack": row["pack"], "entries": _gaps(low[a:z], flags[a:z])}
                       for b, a, z in _parts((codes >> np.uint64(ANCHOR_BITS)).astype(np.int64))]
                yield pa.RecordBatch.from_pylist(out, schema=_ENTRY_SCHEMA)
    return run


def _masks(table: pa.Table, step: int, sizes: list[int], flag: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    out = [{"pack": p, "step": step, "bucket": b, "mask": np.packbits(flag[a:z]).tobytes()}
           for p, b, a, z in zip(table["pack"].to_pylist(), table["bucket"].to_pylist(), [0, *ends], ends)
           if flag[a:z].any()]
    return pa.Table.from_pylist(out, schema=_ANSWER_SCHEMA)


def _groups(values: np.ndarray):
    """(order, first) of the runs of equal values after sorting."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    return order, np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _judge_anchors(table: pa.Table) -> pa.Table:
    rows = [_ungaps(e) for e in table["entries"].to_pylist()]
    values, flags = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    order, first = _groups(values)
    size = np.diff(np.r_[first, len(values)])
    either = np.bitwise_or.reduceat(flags[order], first)
    hit = (either >= 2) & ((size > 1) | (either & 1 == 1))
    flag = np.empty(len(values), bool)
    flag[order] = np.repeat(hit, size)
    return _masks(table, 1, [len(r[0]) for r in rows], flag)


def _judge_windows(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(e, "<u8") for e in table["entries"].to_pylist()]
    least = np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(w, "<u4")] for i, w in
                            zip(table["ids"].to_pylist(), table["which"].to_pylist())])
    values = np.concatenate(rows)
    order, first = _groups(values)
    size = np.diff(np.r_[first, len(values)])
    flag = np.empty(len(values), bool)
    flag[order] = np.repeat(np.minimum.reduceat(least[order], first), size) < least[order]
    return _masks(table, 2, [len(r) for r in rows], flag)


def _of_pack(table: pa.Table, window: int, bucket_bits: int):
    """The pack of a group with its windows around hits, and the second step's answers."""
    text = table.filter(pc.is_valid(table["texts"])).to_pylist()[0]
    given = [(r["step"], r["bucket"], r["mask"]) for r in
             table.filter(pc.is_valid(table["mask"])).select(["step", "bucket", "mask"]).to_pylist()]
    pack = _Pack(text)
    codes, _ = pack.anchors(window, bucket_bits + ANCHOR_BITS)
    hit = _answers([(b, m) for s, b, m in given if s == 1], (codes >> np.uint64(ANCHOR_BITS)).astype(np.int64))
    pack.windows(hit, window, bucket_bits)
    return text["pack"], pack, [(b, m) for s, b, m in given if s == 2]


def _window_entries(window: int, bucket_bits: int):
    def run(table: pa.Table) -> pa.Table:
        number, pack, _ = _of_pack(table, window, bucket_bits)
        out = []
        for b, a, z in _parts(pack.bucket):
            ids, which = np.unique(pack.least[a:z], return_inverse=True)
            out.append({"bucket": b, "pack": number, "entries": pack.hash[a:z].tobytes(),
                        "ids": ids.tobytes(), "which": which.astype("<u4").tobytes()})
        return pa.Table.from_pylist(out, schema=_ENTRY_SCHEMA)
    return run


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
_RESULT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def _left_over(window: int, bucket_bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, pack, answers = _of_pack(table, window, bucket_bits)
        gone = pack.covered(_answers(answers, pack.bucket), window)
        out = []
        for i, text in enumerate(pack.texts):
            own = gone[pack.start[i]:pack.stop[i]]
            edge = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0])).tolist()
            words = [w for p in _slices(text) for w in p.split()]
            if edge:
                words = [w for a, z in zip([0, *edge[1::2]], [*edge[::2], len(words)]) for w in words[a:z]]
            out.append({"doc_id": None if pack.absent[i] else int(pack.ids[i]), "n_words": len(own),
                        "n_removed": int(own.sum()),
                        "removed": [{"start": a, "end": z} for a, z in zip(edge[::2], edge[1::2])],
                        "kept": b" ".join(words).decode("utf-8")})
        return pa.Table.from_pylist(out, schema=_RESULT_SCHEMA)
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, pack_bytes: int = PACK_BYTES,
                   bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, ``removed`` (word spans, end
    exclusive) and ``kept`` (the words left, joined by one space).

    Words are runs other than ASCII white space, unchanged. A word goes if it lies in
    ``window`` consecutive words of its document whose sequence also starts in a document with
    a smaller doc_id. All windows are judged on the input. Null text has no words. Null
    ids count as larger than all others; rows with one id, and repeated rows, do not
    remove from each other (neither id is smaller). Texts of any length are taken
    whole; other columns are ignored; an empty table gives an empty result."""
    packs = shared_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
                         .mapInArrow(_packer(pack_bytes), PACK), "packs")
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    # a power of two, 32 buckets at least
    bits = max(5, int(-(-total // bucket_words) - 1).bit_length())
    answers = shared_table(packs.mapInArrow(_anchor_entries(window, bits), ENTRY)
                           .groupBy("bucket").applyInArrow(_judge_anchors, ANSWER), "anchor-hits")

    def by_pack(found: DataFrame):
        return packs.unionByName(found, allowMissingColumns=True).groupBy("pack")

    windows = by_pack(answers).applyInArrow(_window_entries(window, bits), ENTRY)
    smaller = shared_table(windows.groupBy("bucket").applyInArrow(_judge_windows, ANSWER), "smaller")
    return by_pack(answers.unionByName(smaller)).applyInArrow(_left_over(window, bits), RESULT)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, u.i, md5(array_to_string(w[u.i:u.i + 49], ' ')) AS h
  FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
dup AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE m < doc_id),
word AS (SELECT doc_id, u.i, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
seen AS (
  SELECT doc_id, i, word, coalesce(max(dup.i) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM word LEFT JOIN dup USING (doc_id, i)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM seen GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
