"""Mixing documents to target domain weights, with soft membership.

1. A softmax classifier learned from a labelled table gives every document its
   posterior p over the domains (word and stem presence, a few shape measures);
   numpy, on a bounded sample (``TRAIN_ROWS`` whole texts and ``TRAIN_CHARS`` code points
   of each domain).
2. Nonnegative rates r are fitted so that the expected domain totals
   sum_i r_i n_i p_i (n: tokens, here words, or a token every ``TOKEN_LETTERS`` letters where
   that is more, as in scripts without spaces) meet the targets: projected gradient on the least
   squares in the norm of the inverse domain Gram matrix, in which one step solves
   the problem wherever no rate is cut off at 0, with Nesterov's acceleration. A step is one distributed
   aggregate of a few sums; a document's rate after k steps follows from its own
   posterior and the k gradient vectors, so no per-document state is kept and no
   lineage grows.
   Steps end where the totals meet the targets, or where they no longer change (targets
   that no nonnegative rates meet); the residual left is returned.
3. The rate becomes floor(rate + u) copies, u in [0, 1) a hash of the id, the text and the
   stored row, so that rows with equal or no ids are copied each by itself.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import shared_table, whole_texts_within

DOMAINS = ("good", "poor", "toxic")
#: Shares of the tokens wanted of each domain.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
TRAIN_ROWS = 2000
TRAIN_CHARS = 16_000_000
MIN_DOCS = 10
#: Most gradient steps; beyond it the residual tells how far the totals are.
STEPS = 100
TOLERANCE = 1e-7
TOKEN_LETTERS = 6

_WORD = re.compile(r"\w+")
SHAPES = 6


def domain_of(quality, toxic) -> F.Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


def shape(text: str, words: list[str], distinct: set[str]) -> list[float]:
    """Shares of odd characters, numbers, repeated words and repeated lines, and the
    lengths of words and text."""
    n = max(1, len(text))
    solid = len("".join(words))
    lines = text.split("\n")
    marks = n - solid - text.count(" ") - len(lines) + 1
    numbers = sum(w.isdecimal() for w in distinct)
    return [min(1.0, 5 * marks / n), min(1.0, 5 * numbers / max(1, len(distinct))),
            1 - len(distinct) / max(1, len(words)),
            1 - len(set(lines)) / len(lines), min(2.0, solid / max(1, len(words)) / 8),
            np.log1p(len(words)) / 8]


class Classifier:
    def __init__(self, domains: list[str], features: dict[str, int], weights: np.ndarray):
        """``weights``: features, then shapes, then 1, by domains."""
        self.domains, self.features, self.weights = domains, features, weights
        self.words: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "words": {}}

    def _rows(self, word: str) -> tuple:
        got = tuple(self.features[f] for f in (word, word[:4] + "*") if f in self.features)
        if len(self.words) > 100_000:
            self.words.clear()
        self.words[word] = got
        return got

    def posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of tokens and posterior of a text."""
        words = _WORD.findall((text or "").lower())
        distinct, rows, known = set(words), set(), self.words
        for w in distinct:
            got = known.get(w)
            if got is None:
                got = self._rows(w)
            if got:
                rows.update(got)
        z = self.weights[-1] + np.array(shape(text or "", words, distinct)) @ self.weights[-1 - SHAPES:-1]
        if rows:
            z = z + self.weights[list(rows)].sum(axis=0)
        z = np.exp(z - z.max())
        return max(len(words), -(-sum(map(len, words)) // TOKEN_LETTERS)), z / z.sum()


def fit(rows: list[tuple[str, str]], domains=DOMAINS, epochs: int = 150, rate: float = 0.3,
        l1: float = 5e-3, shares: dict[str, float] | None = None) -> Classifier:
    """Softmax regression by Adagrad with soft threshold, domains weighted alike and
    then shifted to their ``shares`` among the labelled rows. A domain without rows
    gets no mass; without any rows all domains are alike."""
    domains = list(domains)
    texts = [(_WORD.findall(t.lower()), t) for t, _ in rows]
    seen: dict[str, int] = {}
    for words, _ in texts:
        for f in {f for w in set(words) for f in (w, w[:4] + "*")}:
            seen[f] = seen.get(f, 0) + 1
    features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_DOCS))}
    n = len(features)
    weights = np.zeros((n + SHAPES + 1, len(domains)))
    if not rows:
        return Classifier(domains, features, weights)
    at, feat = [], []
    for i, (words, _) in enumerate(texts):
        own = {features[f] for w in set(words) for f in (w, w[:4] + "*") if f in features}
        at += [i] * len(own)
        feat += own
    at, feat = np.array(at, np.int64), np.array(feat, np.int64)
    dense = np.array([[*shape(t, words, set(words)), 1.0] for words, t in texts])
    y = np.array([domains.index(d) for _, d in rows])
    count = np.bincount(y, minlength=len(domains))
    weight = 1.0 / (count[y] * (count > 0).sum())
    total = np.full(weights.shape, 1e-8)
    present = np.where(count > 0, 0.0, -1e9)
    for _ in range(epochs):
        z = dense @ weights[n:] + present
        for d in range(len(domains)):
            z[:, d] += np.bincount(at, weights[feat, d], len(rows))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        grad = np.empty_like(weights)
        grad[n:] = dense.T @ p
        for d in range(len(domains)):
            grad[:n, d] = np.bincount(feat, p[at, d], n)
        total += grad ** 2
        step = rate / np.sqrt(total)
        weights -= step * grad
        small = step[:n] * l1
        weights[:n] = np.sign(weights[:n]) * np.maximum(np.abs(weights[:n]) - small, 0)
    used = np.flatnonzero(np.abs(weights[:n]).max(axis=1)) if n else np.zeros(0, np.int64)
    names = list(features)
    weights = np.concatenate([weights[used], weights[n:]])
    weights[-1] += present
    if shares:
        weights[-1] += [np.log(max(shares.get(d, 0.0), 1e-6)) if c else 0.0 for d, c in zip(domains, count)]
    return Classifier(domains, {names[j]: i for i, j in enumerate(used)}, weights)


def training_rows(docs: DataFrame, labels: DataFrame,
                  rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """At most ``rows`` labelled whole texts of each domain, least hash of the id first, as
    many as fit in ``chars`` code points, and the domains' shares of all labelled rows."""
    known = (labels.where(F.col("doc_id").isNotNull())
             .select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
             .where(F.col("domain").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain")))
    picked = None
    for d in DOMAINS:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = whole_texts_within(docs, picked, "domain", chars)
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    shares = {d: n / sum(counts.values()) for d, n in counts.items()}
    return texts, shares


def _posterior(model: Classifier):
    """n_tokens and p of each text."""
    kind = pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            n, p = model.posterior(t.as_py())
            out.append({"n_tokens": n, "p": p})
        return pa.array(out, kind)
    return F.arrow_udf(run, "struct<n_tokens:bigint,p:array<double>>").asNondeterministic()


def _fold(dense: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points) after the given gradient steps from 1: a point runs ahead of
    the rates by their last change (Nesterov's weights), and the next gradient is
    taken there."""
    rate = np.ones(len(dense))
    point = rate
    for k, move in enumerate((dense @ moves.T).T):
        after = np.maximum(point - move, 0.0)
        point = after + k / (k + 3) * (after - rate)
        rate = after
    return rate, point


def rate_of(p, steps: list[list[float]], ahead: bool = False) -> F.Column:
    """A document's rate after the given gradient steps, or the point ahead of it."""
    moves = np.array(steps, dtype=np.float64)

    def run(posteriors: pa.Array) -> pa.Array:
        out = np.ones(len(posteriors))
        if len(moves):
            dense = posteriors.flatten().to_numpy(zero_copy_only=False).reshape(len(out), -1)
            for a in range(0, len(out), 4096):
                out[a:a + 4096] = _fold(dense[a:a + 4096], moves)[ahead]
        return pa.array(out)
    return F.arrow_udf(run, "double")(p)


def solve(rows: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[list[list[float]], float]:
    """Gradient vectors of the projected steps for rows of (n_tokens, p), and the largest
    difference left between a domain's total and its target. ``targets`` are shares
    of the natural token total. Each step reads the rows once and brings
    as many sums to the driver as there are domains."""
    k = len(targets)
    p = [F.element_at("p", d + 1) for d in range(k)]
    n = F.col("n_tokens").cast("double")
    sums = rows.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}")
                                           for i in range(k) for j in range(i, k)]).first()
    total = sums["n"] or 0.0
    if total == 0:
        return [], 0.0
    gram = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    done: list[list[float]] = []
    before, still = None, 0
    while True:
        r = rate_of(F.col("p"), done, ahead=True)
        got = rows.select((r * n).alias("w"), "p").agg(
            *[F.sum(F.col("w") * p[d]) for d in range(k)]).first()
        residual = np.array(got, dtype=float) / total - np.array(targets)
        left = float(np.abs(residual).max())
        # not a single step alike: the accelerated steps may turn once
        still = still + 1 if before is not None and np.abs(residual - before).max() < TOLERANCE else 0
        if left < TOLERANCE or still == 3 or len(done) == steps:
            return done, left
        before = residual
        done.append([float(v) for v in inverse @ residual])


def copies_of(rate, *key) -> F.Column:
    u = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 48)) / F.lit(float(1 << 48))
    return F.floor(rate + u).cast("long")


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str], targets: dict[str, float] | None):
    """The documents' ``columns`` stored with n_tokens, p and a row key (one classification
    of every text), the classifier, the steps and the residual."""
    wanted = targets or TARGETS
    goal = [wanted[d] / sum(wanted.values()) for d in DOMAINS]
    texts, shares = training_rows(docs, labels)
    model = fit(texts, shares=shares)
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())
    rows = shared_table(docs.select(*own, key.alias("row_key"), _posterior(model)(F.col("text")).alias("s"))
                        .select(*[f"c{i}" for i in range(len(columns))], "row_key", "s.n_tokens", "s.p"), "posteriors")
    steps, left = solve(rows.select("n_tokens", "p"), goal)
    if left > 1e-3:
        warnings.warn(f"mixing targets are missed by {left:.4f} of the tokens")
    return rows, model, steps, left


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None):
    """One row per document: doc_id, n_tokens, p (posterior by DOMAINS), rate and
    copies; and the classifier, the gradient steps that gave them and the residual.

    Null and empty texts have no tokens but a rate all the same; repeated rows, and rows
    with equal or null ids, get rates by their texts and copies each by itself;
    ties of the posterior do not matter (no domain is chosen); texts of any length are
    taken whole; other columns are ignored. An empty table gives an empty result, empty
    labels an even posterior."""
    rows, model, steps, left = _judged(docs, labels, ["doc_id"], targets)
    rate = rate_of(F.col("p"), steps)
    out = (rows.withColumnRenamed("c0", "doc_id").withColumn("rate", rate)
           .withColumn("copies", copies_of(F.col("rate"), F.col("row_key"))))
    return out, model, steps, left


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as many times as its rate gives; columns are kept. The rows
    are stored once with their posteriors, so every text is classified once."""
    rows, _, steps, _ = _judged(docs, labels, docs.columns, targets)
    times = copies_of(rate_of(F.col("p"), steps), F.col("row_key")).cast("int")
    return (rows.withColumn("times", times).withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]))
