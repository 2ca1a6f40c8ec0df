"""Divergence of the sources of a language, by one-hot level products.

A group is one (lang, source). For every kept term a group has a level: its count
there (0 included), and with it a smoothed share p. The price of a term between two
groups depends on their two levels only, so the sum over all terms is the joint table of
the levels, priced cell by cell.

1. Terms are counted per (lang, source, term) in the tasks before the shuffle. A
   language keeps the terms of at least ``min_docs`` documents.
2. Its kept terms are dealt to blocks of about ``TERMS``, by the magnitude of their
   count in the language (terms alike in count have few levels), its sources to
   blocks of about ``SOURCES``. For a block of terms and one of sources the
   indicator matrix has a column for each (group, level) met there, level 0 too.
3. For every pair of source blocks, the product of one matrix with the transpose of the
   other gives the joint tables of all their groups at once. Entries are counts up to the
   number of terms of a block, exact in 32-bit floats; columns are multiplied at most
   ``COLUMNS`` at a time. Cells that are not zero are priced in 64-bit integers, and
   the prices summed by Spark over the blocks of terms.

What meets in one task is bounded by the block sizes. A source of any size is one
pre-aggregated row a term; languages with any share of the rows are spread by term.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Terms and sources of a block, on average.
TERMS = 512
SOURCES = 16
#: Most columns of one product.
COLUMNS = 2048
#: Parts over which a join spreads the rows of one key.
SALTS = 16
#: Terms counted in a task before they are passed on.
HELD = 400_000

# A-Z is lower-cased, a-z and all bytes of characters beyond ASCII are kept
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))

COUNT = "lang string, source string, term string, n long, docs long"


def terms_of(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8")).translate(_TABLE).split()


def _count(batches):
    total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        for (lang, source), (n, docs) in total.items():
            terms = pa.array(list(n), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(terms)),
                 pa.repeat(pa.scalar(source, pa.string()), len(terms)), terms.cast(pa.string()),
                 pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())],
                ["lang", "source", "term", "n", "docs"])
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            n, docs = total.setdefault((lang, source), (Counter(), Counter()))
            own = terms_of(text.as_py())
            before = len(n)
            # of lists and sets, so counted without a Python loop
            n.update(own)
            docs.update(set(own))
            held += len(n) - before
            if held >= HELD:
                yield from flush()
                total, held = {}, 0
    yield from flush()


def _share(count, n, v) -> F.Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), exact (null where nothing is kept)."""
    wide = "decimal(38,0)"
    top = (count + F.lit(2)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.nullif((n + F.lit(2) * v).cast(wide), F.lit(0).cast(wide))
    return F.when(v > 0, F.lit(1) + F.call_function("div", top.cast(wide), whole))


def price(p, q) -> F.Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- the products

TILE = "lang string, a string, b string, value long"
_TILE_SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


class _Levels:
    """The indicator matrix of a block of sources over a block of terms."""

    def __init__(self, row: dict, terms: int):
        self.sources = [s["source"] for s in row["sources"]]
        base = np.array([s["p0"] or 0 for s in row["sources"]], np.int64)
        cells = np.tile(base[:, None], (1, terms))
        met = row["cells"]     # an Arrow array of structs
        if met is not None:
            at = pc.index_in(met.field("source"), value_set=pa.array(self.sources, pa.string()))
            cells[at.to_numpy(zero_copy_only=False), met.field("nth").to_numpy(zero_copy_only=False)] = (
                met.field("p").to_numpy(zero_copy_only=False))
        # columns are (source, level) in order; each cell's column
        levels, level = np.unique(cells, return_inverse=True)
        key = np.arange(len(base))[:, None] * len(levels) + level.reshape(cells.shape)
        columns, column = np.unique(key, return_inverse=True)
        self.owner, self.level = columns // max(1, len(levels)), levels[columns % max(1, len(levels))]
        self.column = column.reshape(cells.shape)
        self.terms = terms

    def matrix(self, first: int, last: int) -> np.ndarray:
        """Columns first to last - 1 of the indicators, a row for each term."""
        out = np.zeros((self.terms, last - first), np.float32)
        rows, terms = np.nonzero((self.column >= first) & (self.column < last))
        out[terms, self.column[rows, terms] - first] = 1
        return out


def _joint_prices(a: _Levels, b: _Levels, columns: int) -> np.ndarray:
    """Sum of the prices over the terms for every pair of a source of a and one of b."""
    out = np.zeros((len(a.sources), len(b.sources)), np.int64)
    for i in range(0, len(a.level), columns):
        left = a.matrix(i, min(i + columns, len(a.level))).T
        for j in range(0, len(b.level), columns):
            joint = left @ b.matrix(j, min(j + columns, len(b.level)))
            x, y = np.nonzero(joint)
            p, q = a.level[i + x], b.level[j + y]
            value = (p - q) * (p - q) // (p + q) * joint[x, y].astype(np.int64)
            np.add.at(out, (a.owner[i + x], b.owner[j + y]), value)
    return out


def _products(columns: int):
    def run(table: pa.Table) -> pa.Table:
        rows = [{**r, "cells": c.values} for r, c in zip(table.drop_columns(["cells"]).to_pylist(),
                                                         table.column("cells"))]
        rows.sort(key=lambda r: r["block"])
        terms = rows[0]["terms"]
        sides = [_Levels(r, terms) for r in rows]
        a, b = sides[0], sides[-1]
        value = (_joint_prices(a, b, columns) if terms
                 else np.zeros((len(a.sources), len(b.sources)), np.int64)).tolist()
        out = []
        for i, s in enumerate(a.sources):
            for j, t in enumerate(b.sources):
                if s != t:
                    out.append({"lang": rows[0]["lang"], "a": s, "b": t, "value": value[i][j]})
                    if a is not b:
                        out.append({"lang": rows[0]["lang"], "a": t, "b": s, "value": value[i][j]})
        return pa.Table.from_pylist(out, schema=_TILE_SCHEMA)
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms: int = TERMS,
          sources: int = SOURCES, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the
    language by its divergence from the group, part ``term`` the ``top`` terms that the
    group uses more than its language does.

    Null text, lang and source count as ''. A group without terms has level 0 for every kept
    term; where a language keeps no term all pairs have value 0. Ties go by item in
    UTF-8 order. Texts of any length are taken whole, repeated rows count each;
    doc_id is not used, other columns are ignored; an empty table gives an empty result."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = shared_table(rows.mapInArrow(_count, COUNT).groupBy("lang", "source", "term")
                          .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = shared_table(rows.select("lang", "source").distinct(), "groups")
    kept = shared_table(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).select("lang", "term", "all_n"), "kept")
    # V and N of the languages, N of the groups
    langs = (groups.select("lang").distinct()
             .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total")), "lang",
                   "left").na.fill(0, ["v", "all_total"]))
    found = shared_table(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    sized = (groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
             .na.fill(0, ["total"]).join(langs, "lang"))
    # blocks of sources
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(sources)).cast("int").alias("of"))
    sized = (sized.join(per_lang, "lang")
             .withColumn("block", F.pmod(F.xxhash64("source"), F.col("of")).cast("int"))
             .withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))))
    sized = shared_table(sized.drop("of"), "group-sizes")
    shares = shared_table(
        _spread_join(found, sized, ["lang", "source"], "term")
        .select("lang", "source", "term", "block", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                _share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q")), "shares")
    return (_pairs(shares, kept, sized, terms, columns)
            .unionByName(_top_terms(shares, top)))


def _spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join of many rows a key with one; a key's rows are spread by ``by``."""
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return (many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
            .join(few.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt"))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    priced = (shares.where("p > q")
              .select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value")))
    # the window's limit is applied before its shuffle too
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _pairs(shares: DataFrame, kept: DataFrame, sized: DataFrame, terms: int, columns: int) -> DataFrame:
    # blocks of terms: (magnitude of the count, slot), numbered within
    band = F.floor(F.log2(F.col("all_n").cast("double"))).cast("int")
    banded = kept.select("lang", "term", band.alias("band"))
    slots = banded.groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(terms)).cast("int").alias("slots"))
    dealt = (_spread_join(banded, slots, ["lang", "band"], "term")
             .withColumn("slot", F.pmod(F.xxhash64("term"), F.col("slots")).cast("int")).drop("slots"))
    nth = F.row_number().over(Window.partitionBy("lang", "band", "slot").orderBy("term")) - 1
    dealt = shared_table(dealt.withColumn("nth", nth), "term-blocks")
    # a language without kept terms has one empty block
    blocks = (dealt.groupBy("lang", "band", "slot").agg(F.count(F.lit(1)).cast("int").alias("terms"))
              .unionByName(sized.where("v = 0").select("lang").distinct()
                           .selectExpr("lang", "-1 as band", "0 as slot", "0 as terms")))
    rosters = sized.groupBy("lang", "block").agg(
        F.array_sort(F.collect_list(F.struct("source", "p0"))).alias("sources"))
    cells = (shares.drop("q").join(dealt, ["lang", "term"])
             .groupBy("lang", "band", "slot", "block")
             .agg(F.collect_list(F.struct("source", "nth", "p")).alias("cells")))
    at = ["lang", "band", "slot", "block"]
    sides = blocks.join(rosters, "lang").join(cells, at, "left")
    # every pair of source blocks meets at each block of terms
    others = sized.select("lang", F.col("block").alias("other")).distinct()
    dealt_out = (sides.join(others, "lang")
                 .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    tiles = (dealt_out.drop("other").groupBy("lang", "band", "slot", "low", "high")
             .applyInArrow(_products(columns), TILE))
    summed = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    return (summed.withColumn("rank", F.row_number().over(order))
            .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
                    "value", "rank"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, rid, unnest(w) AS term FROM d),
lt AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM lt GROUP BY lang),
cell AS (
  SELECT g.lang, g.source, lt.term, coalesce(gt.c, 0) AS c, lt.c AS lc
  FROM g JOIN lt USING (lang) LEFT JOIN gt USING (lang, source, term)),
gn AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cell GROUP BY lang, source),
p AS (
  SELECT cell.*, 1 + (1000000000::HUGEINT * (c + 2)) // (gn.n + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (lc + 2)) // (v.n + 2 * v.v) AS q
  FROM cell JOIN gn USING (lang, source) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
