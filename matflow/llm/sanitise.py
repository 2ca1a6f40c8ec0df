r"""Information-theoretic sanitisation of personal data, in SQL functions only.

Base spans: e-mail addresses, IP addresses, card and phone numbers, found in whole
texts by possessive patterns (linear time), leftmost and without overlap in each
kind, with code-point positions from the pieces between the matches.

Disclosure: each distinct value found is a protected entity c. The words that lie
within ``REACH`` code points of a mention and in no base span are its context. With
n_t occurrences of term t in the corpus and n_tc of them beside c, all counted over
distinct texts (copies tell nothing new), who meets t still lacks

    log2(1 / p) bits about c, p = (n_tc + 1) / (n_t + 1)

0 if t occurs beside c only. p smooths n_tc / n_t by one more occurrence beside c, so
that a term met once or twice counts by what it may disclose; there is no least number
of texts. Terms are removed at ``REMOVE`` bits and fewer (c guessed right every other
time), generalised at ``GENERALISE`` and fewer, wherever they stand in a text that
mentions c. Neither bound moves with the size of the corpus. With N words in it and n_c
in c's context, the term must also tell PMI(c; t) = log2(p N / n_c) >= ``GAIN`` bits:
ordinary words stand beside an entity that a large part of the corpus mentions, and
tell nothing about it.

Work is linear in a text and in its mentions: positions are two-level running sums,
words and mentions meet by cells of the text, spans and words by a running maximum. No
pairs of all words and entities of a document are made. Counts are combined on the map
side; copies of a text collapse there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matflow.llm.common import shared_table

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("remove", "generalise")
REACH = 80
#: Bits still lacking about an entity, at most.
REMOVE, GENERALISE = 1.0, 4.0
#: Bits a term must tell about an entity, at least.
GAIN = 2.0
#: Code points of a text that meet in one group of the join of words and mentions.
CELL = 128
#: Elements a running sum or maximum passes before it starts a new piece.
STRIDE = 256
#: Parts of the rows of one word in the join with the disclosing terms.
SALTS = 8
#: What stands in the sanitised text for each kind.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": "", "generalise": "[TERM]"}

# The kinds' patterns. Possessive where what follows cannot match inside; a match
# can only start at the end of the one before or where its run of characters starts.
# Card: only whole runs of 14 to 19 digits, the others being dropped anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.call_function("luhn_check", F.regexp_replace(v, "[ -]", "")),
    "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15),
}
TERM = r"\p{L}[\p{L}\p{M}\p{N}]*"
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _let(value, body) -> F.Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values, plus) -> F.Column:
    """For each element of an int array, the sum by ``plus`` (from 0) of those before it.
    An array grows by copying, so pieces of ``STRIDE`` are summed each by itself and then
    shifted by the pieces before them."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        return F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    pieces = _let(values, lambda v: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(v) / STRIDE).cast("int")),
        lambda i: F.aggregate(F.slice(v, i * STRIDE + 1, F.lit(STRIDE)), none, step)))
    return _let(pieces, lambda p: F.flatten(F.zip_with(
        p, F.aggregate(F.transform(p, lambda y: y["at"]), none, step)["out"],
        lambda y, off: F.transform(y["out"], lambda x: plus(x, off)))))


def _positions(found, between) -> F.Column:
    """Array of (s, e, v) of the matches ``found`` with the pieces ``between``."""
    gap = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
    ends = F.zip_with(gap, found, lambda g, v: g + F.length(v))
    starts = F.zip_with(_before(ends, lambda a, x: a + x), gap, lambda at, g: at + g)
    return F.zip_with(starts, found, lambda s, v: F.struct(
        s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v")))


def _matches(df: DataFrame, text: str, patterns: dict[str, str], hints: dict[str, str] | None = None) -> DataFrame:
    """``df`` with an array column at_<name> for each pattern."""
    none = F.array().cast("array<string>")
    for name, p in patterns.items():
        seen = F.col(text).rlike(hints[name]) if hints else F.lit(True)
        df = df.withColumn(f"m_{name}", F.when(seen, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))
                           .otherwise(none))
    for name, p in patterns.items():
        df = df.withColumn(f"p_{name}", F.when(F.size(f"m_{name}") > 0, F.split(F.col(text), p, -1)).otherwise(none))
    for name in patterns:
        df = df.withColumn(f"at_{name}", _positions(F.col(f"m_{name}"), F.col(f"p_{name}")))
    return df


def _valid_spans(found, kind: str, nth: int) -> F.Column:
    return F.transform(F.filter(found, lambda x: VALID[kind](x["v"])),
                       lambda x: F.struct(x["s"].alias("s"), F.lit(nth).alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def _of_kind(spans, nth: int) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["k"] == nth)).cast("long")


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text not null) with ``base``: spans (s, k, e, v) by start, then kind."""
    df = _matches(docs, "text", PATTERNS, HINTS)
    parts = [_valid_spans(F.col(f"at_{k}"), k, i) for i, k in enumerate(KINDS)]
    return df.select(*docs.columns, F.array_sort(F.concat(*parts)).cast(_SPAN).alias("base"))


def _named(kind, names=KINDS + EXTRA):
    return F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1)


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _named(x["k"]), x["s"], x["e"])), ",")


def _entity(b) -> F.Column:
    """The protected entity of a span: digits of numbers, lower case of others."""
    value = F.when(b["k"] >= 2, F.regexp_replace(b["v"], "[^0-9]", "")).otherwise(F.lower(b["v"]))
    return F.md5(F.concat_ws(":", b["k"], value))


def free_words(found: DataFrame, key: str, reach: int | None = None) -> DataFrame:
    """(key, t, s, e): the words of each text outside its base spans; with ``reach``, only
    those within that many code points of one. ``found``: rows of (key, text, base)."""
    words = (_matches(found.select(key, "text"), "text", {"term": TERM})
             .select(key, F.explode("at_term").alias("x"))
             .select(key, F.lower("x.v").alias("t"), "x.s", "x.e", F.lit(False).alias("span")))
    spans = (found.select(key, F.explode("base").alias("b"))
             .select(key, F.lit("").alias("t"), "b.s", "b.e", F.lit(True).alias("span")))
    span, end = F.col("span"), F.when(F.col("span"), F.col("e"))

    def last_end(order):
        return F.max(end).over(Window.partitionBy(key).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow))
    # the spans that start before a word ends, and those that start by ``reach`` behind its start
    both = words.unionByName(spans).withColumn("over", last_end([F.when(span, F.col("s")).otherwise(F.col("e")), span]))
    keep = ~span & (F.coalesce("over", F.lit(0)) <= F.col("s"))
    if reach is not None:
        both = both.withColumn("near", last_end([F.when(span, F.col("s") - reach).otherwise(F.col("s")), ~span]))
        keep &= F.col("near") + reach >= F.col("e")
    return both.where(keep).select(key, "t", "s", "e")


def context_words(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(tid, c, t, s): the words around each entity's mentions in distinct texts, each
    position once for an entity. ``found``: rows of (text, base)."""
    one = found.select("text", "base").distinct().select(F.unhex(F.md5("text")).alias("tid"), "text", "base")
    cells = F.sequence(F.floor((F.greatest(F.col("b.s") - reach, F.lit(0))) / CELL),
                       F.floor((F.col("b.e") + reach) / CELL))
    mention = (one.select("tid", F.explode("base").alias("b"))
               .select("tid", _entity(F.col("b")).alias("c"), (F.col("b.s") - reach).alias("low"),
                       (F.col("b.e") + reach).alias("high"), F.explode(cells).alias("cell")))
    word = free_words(one, "tid", reach).withColumn("cell", F.floor(F.col("s") / CELL))
    return (word.join(mention, ["tid", "cell"]).where("s >= low AND e <= high")
            .select("tid", "c", "t", "s").distinct())


def term_counts(docs: DataFrame) -> DataFrame:
    """(t, n_t) over every word of every distinct text."""
    return (docs.select("text").distinct().select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("t"))
            .groupBy("t").agg(F.count(F.lit(1)).alias("n_t")))


def disclosing_terms(words: DataFrame, counts: DataFrame, remove: float = REMOVE,
                     generalise: float = GENERALISE, gain: float = GAIN) -> DataFrame:
    """(c, t, k): the terms to remove or generalise beside each entity."""
    pair = words.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_tc"))
    entity = pair.groupBy("c").agg(F.sum("n_tc").alias("n_c"))
    n = counts.agg(F.sum("n_t").cast("double")).scalar()
    lacking = F.log2((F.col("n_t") + 1) / (F.col("n_tc") + 1))
    return (pair.join(counts, "t").where(lacking <= generalise)
            .join(entity, "c").where(F.log2(n / F.col("n_c")) - lacking >= gain)
            .select("c", "t", F.when(lacking <= remove, F.lit(4)).otherwise(F.lit(5)).alias("k")))


def disclosing_words(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, s, e, k): every word that discloses an entity its text mentions, outside the
    base spans. ``found``: rows of (rid, text, base). A word is joined to the entities it
    discloses, few as each has a large share of its occurrences, then kept for those its
    text mentions; a frequent word's rows are dealt to ``SALTS`` tasks."""
    mention = found.select("rid", F.explode("base").alias("b")).select("rid", _entity(F.col("b")).alias("c")).distinct()
    word = free_words(found, "rid").withColumn("salt", F.pmod(F.xxhash64("rid", "s"), F.lit(SALTS)).cast("int"))
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (word.join(salted, ["t", "salt"]).join(mention, ["rid", "c"])
            .groupBy("rid", "s", "e").agg(F.min("k").alias("k")))


def clean_text(text, spans) -> F.Column:
    """The text with every span replaced by its kind's mark (each cut walks the text)."""
    marks = F.array(*[F.lit(MARKS[k]) for k in KINDS + EXTRA])
    before = _before(F.transform(spans, lambda x: x["e"]), F.greatest)
    # a span inside earlier ones is covered by their marks
    cuts = F.filter(F.zip_with(before, spans, lambda at, x: F.struct(at.alias("at"), x.alias("x"))),
                    lambda z: z["x"]["e"] > z["at"])
    return _let(cuts, lambda c: F.concat(
        F.array_join(F.transform(c, lambda z: F.concat(
            F.substring(text, z["at"] + 1, F.greatest(z["x"]["s"] - z["at"], F.lit(0))),
            F.element_at(marks, z["x"]["k"] + 1))), ""),
        F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0)) + 1, F.length(text))))


def sanitise(docs: DataFrame, texts: bool = True, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans (all, as kind:start:end), n_remove, n_generalise and, with ``texts``, the
    sanitised text.

    Null text counts as empty; null and repeated doc_ids keep a row each; columns
    other than doc_id and text are ignored; no rows give none. A text without base
    spans is never changed."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = base_spans(rows.withColumn("rid", F.monotonically_increasing_id()))
    hit = F.size("base") > 0
    stored = shared_table(found.select(
        "rid", "doc_id", "base", (F.col("text") if texts else F.when(hit, F.col("text"))).alias("text")), "spans")
    words = shared_table(context_words(stored.where(hit), reach), "contexts")
    counts = shared_table(term_counts(rows), "terms")
    terms = disclosing_terms(words, counts)
    extra = (disclosing_words(stored.where(hit), terms)
             .groupBy("rid").agg(F.collect_list(F.struct("s", "k", "e", F.lit(None).cast("string").alias("v"))).alias("extra")))
    out = (stored.join(extra, "rid", "left")
           .withColumn("spans", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN))))))
    count = [_of_kind("spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS + EXTRA)]
    done = out.select("doc_id", *count[:4], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("span_text"), *count[4:],
                      *([clean_text(F.col("text"), F.col("spans")).alias("text")] if texts else []))
    return done.withColumnRenamed("span_text", "spans")
