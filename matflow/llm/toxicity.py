"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the logistic score
s = sigmoid(BIAS + sum of the weights of its features); a document's score is the
noisy-or 1 - prod(1 - s). The bias is fixed, and a sentence without any weighted
feature counts as clean, so that the score does not rise with mere length. The weights are learned from document labels alone, by
the gradient of the document's log loss through the noisy-or, so the sentences
that make a document toxic are found without a sentence label.

Features of a sentence: its words and their leading stems (4, 5 and 6 letters).
Training uses a bounded sample (at most ``TRAIN_ROWS`` whole texts and ``TRAIN_CHARS``
code points of each label, chosen by a hash of the id); words seen in fewer than ``MIN_DOCS`` documents of it get no
weight. Scoring is one pass over whole texts, in Arrow batches, without shuffle.
"""

from __future__ import annotations

import re
import zlib
from array import array
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matflow.llm.common import whole_texts_within

#: Bound of the training sample, per label.
TRAIN_ROWS = 3000
#: Bound of the sample's code points, per label; its texts are whole.
TRAIN_CHARS = 16_000_000
MIN_DOCS = 6
STEMS = (4, 5, 6)
THRESHOLD = 0.7
#: Smaller weights are left out of the model.
LEAST_WEIGHT = 0.5
#: Log odds of a sentence without evidence.
BIAS = -6.0

_SENTENCE = re.compile(r"[.!?\n|]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the sentences: runs between . ! ? | and line ends."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Model:
    """``weights``: feature -> weight; ``bias``: log odds of a sentence without evidence."""

    def __init__(self, weights: dict[str, float], bias: float = BIAS):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple] = {}

    def _word(self, word: str) -> tuple:
        """The weighted features of a word, kept for its next use."""
        got = tuple(f for f in _features(word) if f in self.weights)
        if len(self.words) > 100_000:
            self.words.clear()
        self.words[word] = got
        return got

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "words": {}}

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(document score, number of sentences, sentences that carry weight with
        their scores)."""
        spans = sentences(text or "")
        words, log_clean, marked = self.words, 0.0, []
        for a, z in spans:
            found: set = set()
            for word in _WORD.findall(text[a:z].lower()):
                features = words.get(word)
                if features is None:
                    features = self._word(word)
                if features:
                    found.update(features)
            if not found:
                continue
            total = sum(self.weights[f] for f in found)
            s = 1.0 / (1.0 + exp(-max(-500.0, self.bias + total)))
            log_clean += log1p(-min(s, 1 - 1e-12))
            marked.append((a, z, float(s)))
        return -expm1(log_clean) + 0.0, len(spans), marked


def fit(rows: list[tuple[str, int]], epochs: int = 200, rate: float = 0.5, l1: float = 1e-4,
        min_docs: int = MIN_DOCS) -> Model:
    """Noisy-or gradient descent (Adagrad steps, soft threshold) over the bags.
    Without a row of each label there is nothing to tell them by: the model has no
    weights and scores everything 0."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model({})
    # words as numbers; strings are kept once
    words: dict[str, int] = {}
    sent_doc, word_sent, word_at = [], array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        for a, z in sentences(text) or [(0, 0)]:
            for w in set(_WORD.findall(text[a:z].lower())):
                word_sent.append(len(sent_doc))
                word_at.append(words.setdefault(w, len(words)))
            sent_doc.append(d)
    sent_doc = np.array(sent_doc, dtype=np.int64)
    word_sent, word_at = np.frombuffer(word_sent, np.int32), np.frombuffer(word_at, np.int32)
    names: dict[str, int] = {}
    of_word = np.full((len(words) + 1, 1 + len(STEMS)), -1, dtype=np.int64)
    for w, i in words.items():
        for k, f in enumerate(_features(w)):
            of_word[i, k] = names.setdefault(f, len(names))
    # documents of each feature, one kind of feature at a time; rare ones go
    docs_of = np.zeros(len(names) + 1, dtype=np.int64)
    for k in range(of_word.shape[1]):
        f = of_word[word_at, k]
        pair = np.unique(sent_doc[word_sent][f >= 0] * len(names) + f[f >= 0])
        docs_of += np.bincount(pair % len(names), minlength=len(names) + 1) if len(pair) else 0
    left = np.full(len(names) + 1, -1, dtype=np.int64)
    often = np.flatnonzero(docs_of[:-1] >= min_docs)
    left[often] = np.arange(len(often))
    spelt = list(names)
    index = [spelt[i] for i in often]
    pairs = [np.zeros(0, np.int64)]
    for k in range(of_word.shape[1]):
        f = left[of_word[word_at, k]]
        pairs.append(np.unique(word_sent[f >= 0].astype(np.int64) * max(1, len(index)) + f[f >= 0]))
    pairs = np.concatenate(pairs)
    sent_at, feat = pairs // max(1, len(index)), pairs % max(1, len(index))
    del words, names, spelt, of_word, pairs
    n_sent, n_feat, n_docs = len(sent_doc), len(index), len(rows)
    w, gw2 = np.zeros(n_feat), np.full(n_feat, 1e-8)
    for _ in range(epochs):
        z = BIAS + np.bincount(sent_at, w[feat], n_sent)
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(sent_doc, np.log1p(-np.minimum(s, 1 - 1e-9)), n_docs)
        p = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # d loss / d log_clean: toxic  (1-p)/p, clean -1;  d log_clean / dz = -s
        outer = np.where(labels == 1, np.exp(log_clean) / p, -1.0) / n_docs
        gz = -s * outer[sent_doc]
        gw = np.bincount(feat, gz[sent_at], n_feat)
        gw2 += gw * gw
        step = rate / np.sqrt(gw2)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
    return Model({index[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > LEAST_WEIGHT)})


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out=None,
                  chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled whole texts of each label, least hash of the id first,
    as many as fit in ``chars`` code points."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * rows ids: a bounded broadcast
    return whole_texts_within(docs, picked, "toxic", chars)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences and the offending sentences (spans with
    scores of at least ``threshold``, else the best one of a predicted document).

    Null and empty texts have no sentence and score 0; texts of any length are scored
    whole. Rows are scored one by one, so repeated rows get equal scores and there is
    no tie to break; other columns are ignored."""
    result = ("struct<score:double,n_sentences:int,"
              "offending:array<struct<start:int,end:int,score:double>>>")
    kind = pa.struct([("score", pa.float64()), ("n_sentences", pa.int32()), ("offending", pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s, n, marked = model.score(t.as_py())
            if s >= threshold:
                top = max((x[2] for x in marked), default=1.0)
                marked = [x for x in marked if x[2] >= min(threshold, top)]
            else:
                marked = []
            out.append({"score": s, "n_sentences": n,
                        "offending": [{"start": a, "end": z, "score": x} for a, z, x in marked]})
        return pa.array(out, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    scored = F.arrow_udf(run, result).asNondeterministic()
    return (docs.select("doc_id", scored(F.col("text")).alias("__s"))
            .select("doc_id", "__s.*")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def crc_mod(doc_id, n: int) -> int:
    """The split rule on one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % n
