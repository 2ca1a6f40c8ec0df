"""Token ids as Simple-8b words in binary files.

Coding. A 64-bit word has a 4-bit selector in its top bits and 60 payload bits
that hold a fixed number of ids of equal width (``COUNTS``, ``WIDTHS``); selector
15 is the escape: the whole next word is one raw value (for values of 2^60 and
more). Ids are coded in blocks of ``BLOCK`` ids, each starting at a word
boundary, and the word offset of every block is stored, so that all words of a
frame can be decoded at once and any block by itself. The first selector that
fits is taken greedily, for all blocks of a batch in step.

Files. A file is a sequence of frames (at most about ``FRAME_IDS`` ids, whole
documents) with this little-endian layout, padded to 8 bytes, ended by one line
feed (the record end of Spark's text writer, which writes the bytes and commits
the files):

    magic 'S8BFRAME' | u64 documents, ids, blocks, words
    i64 doc_id per document | u8 doc_id present per document, padded
    u64 ids per document | u64 first word per block | words

A document's ids start a new block. Documents are in ascending doc_id order within
and across files: texts are range-partitioned by doc_id before they are encoded.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matflow.llm.common import new_folder, release_memory, shared_table, small_batches

END_ID = 2
BLOCK = 256
FRAME_IDS = 1 << 18
#: Aimed text bytes of one output file.
FILE_TEXT_BYTES = 32 << 20

#: Files of a group in the two-level sums of file offsets.
GROUP_FILES = 1024

# Fixed values of the coding: ids per word and bits per id of selectors 0-13.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
MAGIC = b"S8BFRAME"

_COUNT = np.zeros(16, dtype=np.int64)
_COUNT[:14] = COUNTS
_COUNT[ESCAPE] = 1

_SMALL_BITS = np.array([max(1, v.bit_length()) for v in range(1 << 16)], dtype=np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value (at least 1)."""
    top = int(values.max()).bit_length() if len(values) else 0
    if top <= 16:
        return _SMALL_BITS[values.astype(np.uint16)]
    out = np.ones(len(values), dtype=np.uint8)
    for b in range(1, top):
        out += values >= np.uint64(1 << b)
    return out


def encode(values: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block, with the number of words as last entry).
    ``values`` are the concatenated runs of ``lengths``; every run starts a block."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    lengths = np.asarray(lengths, dtype=np.int64)
    per_run = -(-lengths // block)
    n_blocks = int(per_run.sum())
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    run_start = np.cumsum(lengths) - lengths
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(per_run) - per_run, per_run)
    start = np.repeat(run_start, per_run) + nth * block
    stop = np.minimum(start + block, np.repeat(run_start + lengths, per_run))

    # widest value in the next n ids, for every position, each from two windows of
    # the next smaller count
    bits = np.concatenate([_bits(values), np.ones(64, np.uint8)])
    n = len(values)
    most, smaller = {1: bits}, 1
    for count in sorted(COUNTS)[1:]:
        wide, shift = most[smaller].copy(), count - smaller
        np.maximum(wide[:-shift], most[smaller][shift:], out=wide[:-shift])
        most[count], smaller = wide, count
    choice = np.full(n, ESCAPE, dtype=np.uint8)
    for s in range(13, -1, -1):
        np.copyto(choice, s, where=most[COUNTS[s]][:n] <= WIDTHS[s])

    # walk all blocks in step, from word to word
    where, which, chosen = [], [], []
    at, live = start.copy(), np.arange(n_blocks)
    while len(live):
        pos = at[live]
        sel = choice[pos].astype(np.int64)
        # near a block's end the ids left decide, the rest of the word is padding
        left = stop[live] - pos
        over = _COUNT[sel] > left
        if over.any():
            sel[over] = _tail(bits, pos[over], left[over])
        where.append(pos)
        which.append(live)
        chosen.append(sel)
        at[live] = pos + np.minimum(_COUNT[sel], left)
        live = live[at[live] < stop[live]]
    where, which, chosen = (np.concatenate(x) for x in (where, which, chosen))
    place = np.argsort(where, kind="stable")   # blocks are laid out in value order
    where, which, chosen = where[place], which[place], chosen[place]
    size = np.where(chosen == ESCAPE, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    for s in range(14):
        rows = np.flatnonzero(chosen == s)
        if not len(rows):
            continue
        word = np.full(len(rows), s << 60, dtype=np.uint64)
        at = where[rows]
        left = stop[which[rows]] - at
        ends = np.flatnonzero(left < COUNTS[s])     # the last words of blocks
        for k in range(COUNTS[s]):
            v = padded[at + k]
            if len(ends):
                v[ends[left[ends] <= k]] = 0
            word |= v << np.uint64(k * WIDTHS[s])
        words[word_at[rows]] = word
    rows = np.flatnonzero(chosen == ESCAPE)
    words[word_at[rows]] = np.uint64(ESCAPE << 60)
    words[word_at[rows] + 1] = values[where[rows]]
    per_block = np.bincount(which, size, n_blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def _tail(bits: np.ndarray, pos: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Selector for the last ids of a block: the one that takes the most of them."""
    out = np.full(len(pos), ESCAPE, dtype=np.int64)
    step = np.arange(60)
    inside = step[None, :] < left[:, None]
    wide = np.maximum.accumulate(np.where(inside, bits[np.minimum(pos[:, None] + step, len(bits) - 1)], 1), axis=1)
    for s in range(13, -1, -1):
        out[wide[:, COUNTS[s] - 1] <= WIDTHS[s]] = s
    return out


def decode(words: np.ndarray, first: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The values of all runs; the inverse of ``encode``, all words at once."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    # an escape's second word is no selector word: flags carry from left to right
    escapes = np.flatnonzero(selector == ESCAPE)
    raw = np.zeros(len(words), dtype=bool)
    for e in escapes:
        if not raw[e]:
            raw[e + 1] = True
    count = _COUNT[selector].astype(np.int32)
    count[raw] = 0
    per_run = -(-lengths // block)
    n_blocks = int(per_run.sum())
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(per_run) - per_run, per_run)
    ids = np.minimum(block, np.repeat(lengths, per_run) - nth * block)
    block_start = np.cumsum(ids) - ids
    first = np.asarray(first, dtype=np.int64)
    done = np.cumsum(count, dtype=np.int64) - count
    in_block = np.diff(first)
    at = done + np.repeat(block_start - done[first[:-1]], in_block)
    end = np.repeat(block_start + ids, in_block)
    out = np.zeros(total + 64, dtype=np.uint64)
    for s in range(14):
        rows = np.flatnonzero((selector == s) & ~raw)
        if not len(rows):
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        word, place, left = words[rows], at[rows], (end - at)[rows]
        whole = left >= COUNTS[s]
        parts = [(word, place, None)] if whole.all() else [
            (word[whole], place[whole], None), (word[~whole], place[~whole], left[~whole])]
        for word, place, left in parts:
            for k in range(COUNTS[s]):
                if left is not None:     # the last word of a block
                    inside = left > k
                    word, place, left = word[inside], place[inside], left[inside]
                out[place + k] = (word >> np.uint64(k * WIDTHS[s])) & mask
    rows = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[at[rows]] = words[rows + 1]
    return out[:total]


def pack_frame(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    words, first = encode(values, lengths)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    pad = bytes(-len(doc_ids) % 8)
    return b"".join([
        MAGIC, struct.pack("<4Q", len(doc_ids), len(values), len(first) - 1, len(words)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), present.tobytes(), pad,
        np.asarray(lengths, dtype="<u8").tobytes(), first[:-1].astype("<u8").tobytes(),
        words.astype("<u8").tobytes()])


def unpack_frames(content: bytes):
    """(doc_ids, lengths, values) of each frame of a file."""
    at = 0
    while at < len(content):
        if content[at:at + 8] != MAGIC:
            raise ValueError(f"no frame at offset {at}")
        docs, n, blocks, n_words = struct.unpack_from("<4Q", content, at + 8)
        at += 40

        def take(kind: str, count: int):
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out
        ids, present = take("<i8", docs), take("u1", docs)
        at += -docs % 8
        lengths = take("<u8", docs).astype(np.int64)
        first = np.concatenate([take("<u8", blocks).astype(np.int64), [n_words]])
        words = take("<u8", n_words)
        values = decode(words, first, lengths)
        if len(values) != n or content[at:at + 1] != b"\n":
            raise ValueError("damaged frame")
        at += 1
        yield [int(i) if p else None for i, p in zip(ids, present)], lengths, values


# --- tokenizing

# Texts of these characters only are cut by the plain pattern below, which agrees
# with the tokenizer's own there; others go to the tokenizer whole.
_PLAIN = re.compile("[\x00-\x7f¡-ÿĀ-ſ–—‘-„…€]*")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
# (words first: they never begin like a contraction)
_PIECE = re.compile(f" ?[{_LETTER}]+| ?[{_DIGIT}]+|'(?:[stmd]|re|ve|ll)"
                    f"| ?[^\\t-\\r {_LETTER}{_DIGIT}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")
#: Bytes of the pieces, with their ids, that a worker remembers.
CACHE_BYTES = 72 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level model's letter for each byte: printable ones stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


def _held(piece: str, ids: bytes) -> int:
    """Bytes that a remembered piece takes, with its place in the table."""
    return sys.getsizeof(piece) + sys.getsizeof(ids) + 100


class _Memory(dict):
    """Ids of pieces, from their second meeting on (the first leaves a mark at the
    piece's hash), until the memory is full: frequent pieces come first."""

    def __init__(self, model):
        super().__init__()
        self.met = bytearray(1 << 24)
        self.room = CACHE_BYTES
        self.merge, self.letters = model.tokenize, _byte_letters()
        self.space = self.letters[0x20]

    def __missing__(self, piece: str) -> bytes:
        spelt = (piece.replace(" ", self.space) if piece.isascii() and piece.isprintable()
                 else piece.encode().decode("latin-1").translate(self.letters))
        ids = array("I", [t.id for t in self.merge(spelt)]).tobytes()
        mark = hash(piece) & 0xFFFFFF
        if not self.met[mark]:
            self.met[mark] = 1
        elif self.room > 0:
            self[piece] = ids
            self.room -= _held(piece, ids)
        return ids

    def trim(self) -> None:
        """Of a full memory the later half goes, for other texts' pieces."""
        if self.room > 0:
            return
        kept = dict(itertools.islice(self.items(), len(self) // 2))
        self.clear()
        self.update(kept)
        self.room = CACHE_BYTES - sum(_held(p, i) for p, i in kept.items())


class Encoder:
    """Texts to ids by the ``tokenizers`` library. Pieces between which its byte-level
    model never merges go to the model once and are remembered, which changes nothing
    in the ids; texts with unusual characters or special tokens, and tokenizers of
    another kind, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        self.by_piece = (self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
                         and isinstance(cut, ByteLevel)
                         and json.loads(cut.__getstate__()) == {
                             "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
        self.known = _Memory(self.tokenizer.model)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        plain = self.by_piece and (text.isascii() or _PLAIN.fullmatch(text))
        if not plain or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this worker process. ``name``: a path, or a file of the
    installed ``public_tokenizers`` package, found by each worker itself."""
    if name not in _ENCODERS:
        path = name
        if "/" not in name:
            import public_tokenizers
            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(str(path))
    return _ENCODERS[name]


def _frames(tokenizer: str, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        release_memory()
        enc = encoder(tokenizer)
        ids, parts, held = [], [], 0

        def frame():
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([pack_frame(ids, lengths, np.frombuffer(b"".join(parts), "<u4"))], pa.binary())], ["frame"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = enc.ids(text.as_py() or "") + end
                ids.append(doc_id)
                parts.append(part)
                held += len(part) // 4
                if held >= FRAME_IDS:
                    yield frame()
                    ids, parts, held = [], [], 0
        if ids:
            yield frame()
        enc.known.trim()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json",
                 end_id: int = END_ID, file_bytes: int = FILE_TEXT_BYTES) -> None:
    """Encode every whole text (null: empty) with ``end_id`` appended and write the
    ids in ascending doc_id order; null ids come first, repeated ids side by side
    in the order of their texts' hashes, dealt to as many files as they fill."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(max(1, -(-size // file_bytes)))
    # rows that agree in id and text are alike, so any tie-break gives the same files
    order = [F.col("doc_id").asc_nulls_first(), "hash", "tie"]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
                           F.monotonically_increasing_id().alias("tie"))
               .repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    with small_batches(docs.sparkSession):
        (ordered.mapInArrow(_frames(tokenizer, end_id), "frame binary")
         .select(F.col("frame").cast("string").alias("value"))
         .write.option("lineSep", "\n").text(folder))


def _read_rows(batches):
    for batch in batches:
        for path, buffer in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = 0
            for ids, lengths, values in unpack_frames(buffer.as_buffer().to_pybytes()):
                ends = np.cumsum(lengths)
                raw = values.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(ends - lengths, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()),
                     pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(crc, pa.int64())],
                    ["file", "doc_id", "at", "n_tokens", "ids_crc32"])
                start += int(ends[-1])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: file, doc_id, at (ids before it in its file), n_tokens,
    ids_crc32 per document. A damaged file raises; an empty folder has no rows."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
             .where("length > 0").select("path", "content"))
    return files.mapInArrow(_read_rows, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, folder: str | None = None, tokenizer: str = "byte_bpe_50k.json",
             end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files and read them back: one row per document with
    doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    Null text is empty (its only id is the end id); texts of any length are one document of
    a frame; null ids come first and ties go by the text's hash, so a repeated id may span
    files; columns other than doc_id and text are ignored; no documents give no rows."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens") + "/t"
    write_tokens(docs, folder, tokenizer, end_id)
    rows = shared_table(read_tokens(spark, folder), "token-rows")
    # the number in a file's name is its range partition; sums before a file come from its
    # group of files and, for whole groups, from the groups before
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn(
        "nth", F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long"))
    files = shared_table(files.withColumn("part", F.expr(f"nth div {GROUP_FILES}")), "token-files")
    before = (Window.unboundedPreceding, -1)
    in_part = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("nth").rowsBetween(*before)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("part_n")).select(
        "part", F.coalesce(F.sum("part_n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*before)),
                           F.lit(0)).alias("part_before"))
    offsets = files.withColumn("in_part", in_part).join(parts, "part").select(
        "file", (F.col("part_before") + F.col("in_part")).alias("before"))
    return (rows.join(offsets, "file")
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
