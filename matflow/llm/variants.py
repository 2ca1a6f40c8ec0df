"""Spelling variants: words one edit apart, by dense tiles of prefix and suffix lengths.

Two words differ by one inserted, deleted or replaced code point exactly if their
common prefix and common suffix together reach the longer length minus one. That test is
made for whole blocks of words against each other: the words are padded to matrices of
code points, once from the left and once from the right, and compared column by column.

1. Words are counted in the tasks before the shuffle.
2. The longer word is thought of in ``PIECES`` pieces: the edit lies in one of them, and
   the two words share the prefix before and the suffix behind that piece. Only words that
   share these need to meet. A word enters for the longer length equal to its own and
   one more, once a piece. Groups of one are left out.
3. Small groups are packed into tiles of about ``TILE`` words. A larger group, whatever
   its share of all words, is cut into blocks of that size, and every pair of its blocks
   is a tile. In a tile, ``BLOCK`` words at most are compared with as many; memory follows
   the block, not the group. Only near pairs leave a tile, each exactly once.
4. Counts and best forms are aggregated per word; roots by pointer doubling (each form is
   ``RATIO`` times as frequent, so chains are short).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: One run in this many (by hash) loses a code point.
DELETE_ONE_IN = 31
#: Pieces of a word; the larger, the smaller the groups and the more of them.
PIECES = 3
#: Words of a tile of small groups or of a block of a larger group, and of one comparison.
TILE = 2048
BLOCK = 256
#: Most cells of a padded matrix.
CELLS = 1 << 20
SALTS = 8
#: Words counted in a task before they are passed on.
HELD = 500_000

# In Latin-1: A-Z lower-cased, a-z and U+00C0 to U+00FF kept
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32) for c in range(256))

COUNT = "word string, n long"


def runs_of(text: str) -> list[bytes]:
    """Maximal letter runs, in Latin-1 (other characters separate)."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def word_of(prefix: bytes, run: bytes, one_in: int = DELETE_ONE_IN) -> bytes:
    """The run, without one code point where the hash of ``prefix`` (id and colon) and run
    is divisible by ``one_in``."""
    spelt = run if run.isascii() else run.decode("latin-1").encode("utf-8")
    h = zlib.crc32(spelt, zlib.crc32(prefix))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counter(least: int, one_in: int):
    def run(batches):
        total: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in total], pa.string()),
                 pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = b":" if doc_id is None else b"%d:" % doc_id
                for r, n in Counter(runs_of(text.as_py() or "")).items():
                    if len(r) >= least:
                        w = word_of(prefix, r, one_in)
                        if len(w) >= least:
                            total[w] += n
                if len(total) >= HELD:
                    yield flush()
                    total.clear()
        if total:
            yield flush()
    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n) of the words with at least ``least_length`` code points and
    ``least_count`` occurrences."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_counter(least_length, one_in), COUNT)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


# --- tiles

def _matrix(words: list[str], width: int) -> np.ndarray:
    """Code points, padded with 0 on the right."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of a with every row of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    run = np.ones(out.shape, bool)
    for c in range(a.shape[1]):
        run &= a[:, c, None] == b[None, :, c]
        if not run.any():
            break
        out += run
    return out


def _cuts(longer: int) -> list[int]:
    """Where the pieces of a word of ``longer`` code points end (0 first)."""
    return [longer * i // PIECES for i in range(PIECES + 1)]


def near_in(a: list[str], b: list[str], longer: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the near pairs of a and b (distinct words of lengths ``longer`` and one
    less) whose longer one has ``longer`` code points, and whose edit lies in ``piece`` and
    could not lie in an earlier one."""
    before = _common(_matrix(a, longer), _matrix(b, longer))
    after = _common(_matrix([w[::-1] for w in a], longer), _matrix([w[::-1] for w in b], longer))
    la, lb = (np.array([len(w) for w in x]) for x in (a, b))
    most = np.maximum(la[:, None], lb[None, :])
    near = (most == longer) & (before + after >= longer - 1) & (before < most)   # not the same word
    cuts = _cuts(longer)
    for i in range(piece + 1):
        inside = (before >= cuts[i]) & (after >= longer - cuts[i + 1])
        near &= inside if i == piece else ~inside
    return np.nonzero(near)


def _blocks(n: int, longer: int) -> list[slice]:
    size = max(1, min(BLOCK, CELLS // longer))
    return [slice(i, i + size) for i in range(0, n, size)]


PAIR = "word string, other string, other_n long"
_PAIR_SCHEMA = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _compare(table: pa.Table) -> pa.Table:
    """Near pairs of a tile, in both directions."""
    longer, piece, part = (np.array(table[c].to_pylist()) for c in ("longer", "piece", "part"))
    words, n = table["word"].to_pylist(), table["n"].to_pylist()
    across = table["low"][0].as_py() != table["high"][0].as_py()
    out = {"word": [], "other": [], "other_n": []}
    order = np.lexsort((part, piece, longer))
    kind = longer[order] * PIECES + piece[order]
    for run in np.split(order, np.flatnonzero(np.diff(kind)) + 1):
        size, which = int(longer[run[0]]), int(piece[run[0]])
        a = run[part[run] == 0] if across else run
        b = run[part[run] == 1] if across else run
        for i, rows in enumerate(_blocks(len(a), size)):
            for columns in _blocks(len(b), size)[0 if across else i:]:
                x, y = a[rows], b[columns]
                p, q = near_in([words[k] for k in x], [words[k] for k in y], size, which)
                if not across and rows == columns:
                    p, q = p[p < q], q[p < q]
                for k, m in zip(x[p].tolist(), y[q].tolist()):
                    out["word"] += [words[k], words[m]]
                    out["other"] += [words[m], words[k]]
                    out["other_n"] += [n[m], n[k]]
    return pa.table(out, schema=_PAIR_SCHEMA)


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, other, other_n): every word with each word one edit away, for distinct
    words with their counts (word, n)."""
    length = F.length("word")
    options = F.array(*[F.struct((length + up).alias("longer"), F.lit(i).alias("piece"))
                        for up in (0, 1) for i in range(PIECES)])
    start = F.expr(f"longer * piece div {PIECES}").cast("int")
    behind = (F.col("longer") - F.expr(f"longer * (piece + 1) div {PIECES}")).cast("int")
    keyed = shared_table(
        words.select("word", "n", F.explode(options).alias("o")).select("word", "n", "o.longer", "o.piece")
        .withColumn("key", F.xxhash64("longer", "piece", F.substring(F.col("word"), F.lit(1), start),
                                      F.substring(F.col("word"), length - behind + 1, behind))), "pieces")
    # groups with a partner, one of them of the longer length
    groups = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                       F.max((F.length("word") == F.col("longer")).cast("int")).alias("whole"))
              .where("size > 1 and whole = 1").select("key", "size"))
    salt = F.pmod(F.xxhash64("word", F.lit("salt")), F.lit(SALTS)).cast("int")
    met = shared_table(
        keyed.withColumn("salt", salt)
        .join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
        .drop("salt"), "groups")
    small = met.where(F.col("size") <= tile)
    tiles = int(-(-small.count() // tile)) or 1
    small = small.select(F.pmod("key", F.lit(tiles)).alias("tile"), F.lit(-1).alias("low"), F.lit(-1).alias("high"),
                         F.lit(0).alias("part"), "longer", "piece", "word", "n")
    large = (met.where(F.col("size") > tile)
             .withColumn("of", F.ceil(F.col("size") / F.lit(tile)).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("word", F.lit("block")), F.col("of")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
             .select(F.col("key").alias("tile"), F.least("own", "other").alias("low"),
                     F.greatest("own", "other").alias("high"),
                     (F.col("own") > F.col("other")).cast("int").alias("part"), "longer", "piece", "word", "n"))
    return small.unionByName(large).groupBy("tile", "low", "high").applyInArrow(_compare, PAIR)


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                   ratio: int = RATIO, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where the
    crc32 of ``<doc_id>:<run>`` is divisible by ``one_in`` the run loses the code point
    at crc32 modulo its length. The form is the near word of largest n (ties: the first in
    code-point order), if that n is ``ratio`` times the word's; the root is the last
    of the chain of forms, or the word.

    Null text has no words, a null doc_id hashes as an empty one; repeated rows count each;
    texts and words of any length are taken whole; other columns are ignored; an empty
    table gives an empty result."""
    words = shared_table(count_words(docs, least_length, least_count, one_in), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has_form = F.col("best").isNotNull() & (-F.col("best.n") >= F.lit(ratio) * F.col("n"))
    judged = shared_table(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has_form, F.col("best.other")).alias("form"),
                F.when(has_form, -F.col("best.n")).alias("form_n")), "forms")
    most = judged.agg(F.max("n")).first()[0] or 1
    links = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # a chain has at most log(most) links; its reach doubles by each join
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, max(2, ratio)) + 1)))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = shared_table(links.join(ahead, "root", "left")
                             .select("word", F.coalesce("next", "root").alias("root")), "roots")
    return (judged.join(links, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce(
           [v] || range(8), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\x{00C0}-\x{00FF}]+')) AS r
  FROM documents),
counted AS (SELECT head, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY head, r),
hashed AS (
  SELECT r, n, xor(list_reduce(
           [4294967295::BIGINT] || list_transform(range(strlen(head || r)),
             lambda i: ('0x' || substr(hex(encode(head || r)), 2 * i + 1, 2))::BIGINT),
           lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc),
word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2)
                ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, u.i, substr(word, 1, u.i - 1) || substr(word, u.i + 1) AS less
  FROM word, unnest(range(1, length(word) + 1)) AS u(i)),
pair AS (
  SELECT DISTINCT a.word, b.word AS other FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT DISTINCT cut.word, b.word FROM cut JOIN word b ON b.word = cut.less
  UNION
  SELECT DISTINCT b.word, cut.word FROM cut JOIN word b ON b.word = cut.less),
best AS (
  SELECT pair.word, count(*) AS n_near,
         first(other ORDER BY o.n DESC, other) AS form, max(o.n) AS form_n
  FROM pair JOIN word o ON o.word = pair.other GROUP BY pair.word),
judged AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM word LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS form, 0 AS depth FROM judged
    UNION ALL
    SELECT c.word, j.form, depth + 1 FROM c JOIN judged j ON j.word = c.form WHERE j.form IS NOT NULL)
  SELECT word, arg_max(form, depth) AS root FROM c GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM judged JOIN chain USING (word)
"""
