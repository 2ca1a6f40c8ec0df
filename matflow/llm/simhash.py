"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Fingerprints: one pass over whole texts in Arrow batches.
2. Equal fingerprints collapse to one entry (map-side combined), so a group of
   copies of any size is one entry from here on.
3. Links between different fingerprints: 64 bits are cut into ``BLOCKS`` = 6
   blocks; two fingerprints at 4 or fewer differing bits agree on at least two
   blocks, so each entry goes to its 15 (block pair, value) nodes. These are the
   upper nodes of the index: every member shares their masked bits.
4. Below each node the members are sorted by Gray rank (neighbours in that order
   differ in few bits); runs of ``FAN`` members form a lower node, runs of ``FAN``
   nodes the next, each factoring out the bits its members share (mask, pattern).
   A pair of nodes is dropped when the accumulated differences on their shared
   masks exceed the distance, and when both already lie in one component; other
   pairs are opened. Only a spanning star of each node's components leaves the
   task, never all pairs.
5. Connected components of those stars by joins (``components``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import fresh, shared_table
from matflow.llm.components import components

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
BLOCKS = 6
FAN = 16
#: Hashes turned into bits at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles (ASCII white space, A-Z lower-cased,
    repeats counted); fewer words than a shingle are one shingle, no word is 0."""
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate([len(t) + 1 for t in tokens]))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[:ends[words - 1] - 1], SEED)]
    hashes += [digest(joined[a:z - 1], SEED) for a, z in zip(ends, ends[words:])]
    values = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at:at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def _fingerprints(words: int):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64).view(np.int64))
    return F.arrow_udf(run, "bigint")


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:])]


def _node_masks(blocks: int, distance: int) -> list[int]:
    """Bits shared below each kind of upper node: any blocks - distance blocks."""
    one = [((1 << w) - 1) << a for a, w in block_bounds(blocks)]
    return [sum(c) for c in itertools.combinations(one, blocks - distance)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member index) after joining the components of a[i] and b[i]."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class _Level:
    """Runs of ``size`` members: shared bits (mask, pattern), and the component if
    all members are in one (else -1)."""

    def __init__(self, codes: np.ndarray, size: int):
        self.size, self.n = size, -(-len(codes) // size)
        at = np.arange(0, len(codes), size)
        ones, any_ = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        self.mask, self.pattern, self.at = ones | ~any_, ones, at

    def one(self, label: np.ndarray) -> np.ndarray:
        low, high = np.minimum.reduceat(label, self.at), np.maximum.reduceat(label, self.at)
        return np.where(low == high, low, -1)


def _link_large(codes: np.ndarray, distance: int, label: np.ndarray, batch: int = 4096) -> np.ndarray:
    """Components below one upper node, by descending pairs of index nodes.
    ``codes`` are in Gray order; pairs are opened in batches, depth first, so memory
    is bounded by the depth times a batch's children."""
    levels, size = [], FAN
    while True:
        levels.append(_Level(codes, size))
        if levels[-1].n == 1:
            break
        size *= FAN
    n = len(codes)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, a, b = stack.pop()
        if len(a) > batch:
            stack.append((k, a[batch:], b[batch:]))
            a, b = a[:batch], b[:batch]
        node = levels[k]
        apart = np.bitwise_count((node.pattern[a] ^ node.pattern[b]) & node.mask[a] & node.mask[b])
        whole = node.one(label)
        keep = (apart <= distance) & ~((whole[a] >= 0) & (whole[a] == whole[b]))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        step = np.arange(FAN)
        x = np.repeat(a[:, None, None] * FAN + step[None, :, None], FAN, axis=2).ravel()
        y = np.repeat(b[:, None, None] * FAN + step[None, None, :], FAN, axis=1).ravel()
        limit = levels[k - 1].n if k else n
        ok = (x < limit) & (y < limit) & ((x <= y) if k else (x < y))
        x, y = x[ok], y[ok]
        if k:
            # near pairs are opened first and settle the labels for the others
            order = np.argsort(y - x, kind="stable")
            stack.append((k - 1, x[order], y[order]))
        else:
            near = np.bitwise_count(codes[x] ^ codes[y]) <= distance
            label = _merge(label, x[near], y[near])
    return label


def link(codes: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, least member) of the components of ``codes`` within
    each group; rows must be sorted by (group, Gray rank)."""
    n = len(codes)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    # groups of one lower node: members compared at each offset, all groups at once
    small = np.repeat(sizes <= FAN, sizes)
    for off in range(1, min(FAN, n)):
        i = np.flatnonzero(small[:-off] & (group[off:] == group[:-off]))
        if not len(i):
            break
        i = i[np.bitwise_count(codes[i] ^ codes[i + off]) <= distance]
        if len(i):
            label = _merge(label, i, i + off)
    for at, size in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        own = _link_large(codes[at:at + size], distance, np.arange(size))
        label[at:at + size] = own + at
    moved = np.flatnonzero(label != np.arange(n))
    return codes[moved], codes[label[moved]]


def _link_tasks(distance: int):
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(codes, kinds, keys):
        """Stars of complete nodes."""
        order = np.lexsort((gray_rank(codes), keys, kinds))
        codes, kinds, keys = codes[order], kinds[order], keys[order]
        group = np.cumsum(np.r_[True, (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])])
        a, b = link(codes, group, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=kind)

    def run(batches):
        # rows arrive sorted by node: the last, perhaps unfinished node is carried over
        held = None
        for batch in batches:
            part = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64),
                    batch.column(1).to_numpy(zero_copy_only=False),
                    batch.column(2).to_numpy(zero_copy_only=False)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            codes, kinds, keys = held
            last = np.flatnonzero((kinds != kinds[-1]) | (keys != keys[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield out(codes[:cut], kinds[:cut], keys[:cut])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield out(*held)
    return run


def _least(entries: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``entries`` (fp, first), a row per distinct fingerprint -> (fp, first, least):
    the least ``first`` of its component."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in _node_masks(blocks, distance)])
    nodes = (entries.select("fp", F.posexplode(masks).alias("kind", "mask"))
             .select("fp", "kind", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))
    stars = (nodes.repartition("kind", "key").sortWithinPartitions("kind", "key")
             .mapInArrow(_link_tasks(distance), "a long, b long"))
    root = components(stars)
    # (fp, least first of its component): an aggregate over linked entries only
    member = (root.select(F.col("a").alias("fp"), F.col("b").alias("root"))
              .unionByName(root.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
              .join(entries, "fp"))
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(least, "root").select("fp", "least")
    return entries.join(linked, "fp", "left").select("fp", "first", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE,
                    blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits),
    component_id, the smallest doc_id reachable by links of ``distance`` or fewer
    differing bits.

    Null and empty texts have fingerprint 0, linked like any other. A null doc_id
    is no component_id unless its component has no other. Repeated rows give a row
    each. Columns other than doc_id and text are ignored; no rows give none.
    ``blocks`` must exceed ``distance``.
    """
    if blocks <= distance:
        raise ValueError("blocks must exceed distance")
    rows = shared_table(docs.select("doc_id", _fingerprints(words)(F.col("text")).alias("fp")), "simhash")
    entries = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    label = _least(entries, distance, blocks).select("fp", F.col("least").alias("component_id"))
    return (rows.join(label, "fp")
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """The documents with one row of each near-duplicate component: that of the least
    doc_id, of repeated ones any one, a null doc_id if there is no other. Rows are told
    apart by an id of their own, so what shares a doc_id but no component is kept.
    All columns are kept."""
    row, code = fresh(docs, "__row"), fresh(docs, "__fp")
    # stored with the columns: the row ids are drawn once
    stored = shared_table(docs.select("*", _fingerprints(words)(F.col("text")).alias(code))
                          .withColumn(row, F.monotonically_increasing_id()), "simhash")
    entry = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    entries = shared_table(stored.groupBy(F.col(code).alias("fp")).agg(F.min(entry).alias("first")), "fingerprints")
    keep = (_least(entries, distance, BLOCKS).where(F.col("first.row") == F.col("least.row"))
            .select(F.col("first.row").alias(row)))
    return stored.join(keep, row, "left_semi").select(*[stored[f"`{c}`"] for c in docs.columns])
