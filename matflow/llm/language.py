"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one padded
with zeros). In a window: byte embedding, convolution filters of several widths,
maximum over all positions, softmax over the languages. The text's posterior is the
mean over its windows, weighted by their bytes, so every byte of the text counts.

The network is trained in numpy on all windows of a bounded sample of labelled rows
(``TRAIN_ROWS`` a language, ``TRAIN_BYTES`` in all); only the filters'
winning positions carry a gradient. Prediction is one narrow pass over Arrow
batches; all windows of a batch are computed in blocks of ``ROWS`` as one matrix
product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matflow.llm.common import fresh

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBED = 6
#: Windows computed at a time.
ROWS = 64
#: Bounds of the training sample: texts of a language, and code points of all texts.
#: Every language is learned from one text at least.
TRAIN_ROWS = 160
TRAIN_CHARS = 16_000_000
UNKNOWN = "und"


class Network:
    """``embed`` (256, E); ``filters`` (widest * E, all filters), narrower filters
    being zero in their last rows; ``bias``; ``out`` (filters, languages);
    ``out_bias``."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.keep = np.zeros((wide, EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.keep[:w, :, i * FILTERS:(i + 1) * FILTERS] = 1
        self.keep = self.keep.reshape(wide * EMBED, n)
        self.filters = (rng.normal(0, 0.4, self.keep.shape) * self.keep).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray, where: bool = False):
        """(rows, filters) maxima over the positions, and the positions if asked."""
        wide = max(WIDTHS)
        x = self.embed[windows].reshape(len(windows), -1)
        steps = windows.shape[1] - wide + 1
        view = np.lib.stride_tricks.as_strided(
            x, (len(windows), steps, wide * EMBED), (x.strides[0], EMBED * x.strides[1], x.strides[1]))
        z = np.matmul(view.reshape(-1, wide * EMBED), self.filters).reshape(len(windows), steps, -1)
        if where:
            at = z.argmax(axis=1)
            return np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, at
        return z.max(axis=1) + self.bias

    def posterior(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), ROWS):
            h = np.maximum(self.pooled(windows[a:a + ROWS]), 0)
            s = h @ self.out + self.out_bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            out[a:a + ROWS] = s / s.sum(axis=1, keepdims=True)
        return out


def cut(data: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW bytes, at least one, padded with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def fit(pieces: list[tuple[str, str]], epochs: int = 12, batch: int = 64, rate: float = 0.004,
        seed: int = 7) -> Network | None:
    """Adam on the softmax loss over all windows of (text, language) pairs, every
    language weighted alike. No text: None; one language: a network that knows
    only it."""
    if not pieces:
        return None
    languages = sorted({y for _, y in pieces})
    net = Network(languages, seed)
    cuts = [cut(t.encode("utf-8")) for t, _ in pieces]
    x = np.concatenate(cuts)
    nth = {v: i for i, v in enumerate(languages)}
    y = np.repeat([nth[v] for _, v in pieces], [len(c) for c in cuts])
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    rng, wide = np.random.default_rng(seed), max(WIDTHS)
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a:a + batch]
            w = x[rows]
            top, at = net.pooled(w, where=True)
            h = np.maximum(top, 0)
            s = h @ net.out + net.out_bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = s / s.sum(axis=1, keepdims=True)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[rows][:, None] / len(rows)
            dh = (d @ net.out.T) * (top > 0)
            # the window's bytes below each filter's winning position
            seen = w[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(wide)]
            part = net.embed[seen].reshape(len(rows), at.shape[1], -1)
            de = np.einsum("bf,kf->bfk", dh, net.filters).reshape(-1, EMBED)
            grad = {"out": h.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0),
                    "filters": np.einsum("bf,bfk->kf", dh, part) * net.keep,
                    "embed": np.zeros_like(net.embed)}
            np.add.at(grad["embed"], seen.ravel(), de)
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                step = rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_pieces(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """Whole texts, at most ``rows`` of each language, least hash of the id
    first, from rows that may be learned from (doc_id and lang not null, not held
    out, with a letter). A language count picks the share of each language, so only
    about twice the rows wanted are ranked. Each language has an even part of ``chars``
    code points and takes the texts that fit in it, one at least."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                       & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    limit = F.create_map(*[x for r in counts for x in
                           (F.lit(r["lang"]), F.lit(int((1 << 32) * min(1.0, (2 * rows + 50) / r["count"])) + 1))])
    ranked = Window.partitionBy("lang").orderBy("part", "doc_id", F.xxhash64("text"))
    own = F.sum(F.length("text").cast("long")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    picked = (known.where(part < F.element_at(limit, F.col("lang")))
              .select("lang", "doc_id", part.alias("part"), "text")
              .withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= rows)
              .withColumn("total", own)
              .where((F.col("nth") == 1) | (F.col("total") <= chars // len(counts))))
    return [(r.text, r.lang) for r in picked.orderBy("lang", "nth").select("text", "lang").collect()]


def _predictor(net: Network | None):
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        out = [{"lang": UNKNOWN, "score": 0.0}] * len(texts)
        rows, sizes, held, at = [], [], 0, []

        def flush():
            p = net.posterior(np.concatenate(rows))
            ends = np.cumsum([len(r) for r in rows])
            for i, n, a, z in zip(at, sizes, ends - [len(r) for r in rows], ends):
                weight = np.full(z - a, WINDOW, np.float64)
                weight[-1] = n - (z - a - 1) * WINDOW
                mean = weight @ p[a:z].astype(np.float64) / weight.sum()
                best = int(mean.argmax())
                out[i] = {"lang": net.languages[best], "score": float(min(1.0, mean[best]))}
        for i, (text, letter) in enumerate(zip(texts, letters.to_pylist())):
            if net is None or not letter:
                continue
            data = text.as_py().encode("utf-8")
            rows.append(cut(data))
            sizes.append(len(data))
            at.append(i)
            held += len(rows[-1])
            if held >= 1 << 14:
                flush()
                rows, sizes, held, at = [], [], 0, []
        if rows:
            flush()
        return pa.array(out, kind)
    return F.arrow_udf(run, "struct<lang:string,score:double>").asNondeterministic()


def with_language(docs: DataFrame, net: Network | None, column: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang, score). Null texts and texts without a
    letter are ``und`` with score 0, as is everything if nothing could be learned;
    ties go to the first language by name. Texts of any length are judged by all their
    windows. Repeated rows are predicted alike."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(fresh(docs, column), _predictor(net)(F.col("text"), letter))


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is recognised (not ``und``, score at least
    ``least``), with their columns; the network learns from ``docs`` itself. Documents
    without any label to learn from raise ValueError: nothing is dropped unjudged."""
    net = fit(training_pieces(docs))
    if net is None:
        if docs.isEmpty():
            return docs
        raise ValueError("no labelled text to learn languages from")
    name = fresh(docs, "language")
    judged = with_language(docs, net)
    return judged.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
