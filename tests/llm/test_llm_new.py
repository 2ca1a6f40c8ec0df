"""op11, op12, op13 against brute-force versions, and their edge cases."""
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matflow.llm import divergence, substrings, variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def some(rows):
    return [tuple(r) for r in rows]


# --- op11: spelling variants

WORDS = "doc_id long, text string, word string, n int, root string"


def word_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], WORDS)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def reference_variants(rows, ratio=10):
    counts = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 7:
                counts[r] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form, near = {}, {}
    for w in counts:
        others = [o for o in counts if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, near[w], form.get(w), counts.get(form.get(w)), root))
    return sorted(out)


@pytest.fixture(scope="module")
def spelt():
    rng = np.random.default_rng(5)
    letters = list("abcdeé")
    base = ["".join(rng.choice(letters, rng.integers(7, 12))) for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = base[int(rng.zipf(1.6)) % len(base)]
            if rng.random() < 0.3:
                k = int(rng.integers(0, len(w)))
                w = [w[:k] + w[k + 1:], w[:k] + str(rng.choice(letters)) + w[k:],
                     w[:k] + str(rng.choice(letters)) + w[k + 1:]][rng.integers(0, 3)]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (None, "abcdefgh abcdefgh"), (None, "abcdefgi"), (202, "ABCDEFGH, abcdefgx" * 30),
             (203, "×÷abcdefg " * 3), (204, "q" * 3000 + " " + "q" * 3000 + " " + "q" * 2999 + "z"),
             (204, "q" * 3000 + " Ābcdefghi abcdefghi")]
    return rows + rows[:3]


def test_variants_match_brute_force(spark, spelt):
    got = variants.group_variants(word_frame(spark, spelt)).select("word", "n", "n_near", "form", "form_n", "root")
    want = reference_variants(spelt)
    assert sorted(some(got.collect())) == want
    assert any(r[3] for r in want) and any(r[2] > 5 for r in want)


def test_large_groups_are_compared_block_by_block(spark, spelt):
    words = variants.count_words(word_frame(spark, spelt))
    whole = sorted(some(variants.near_pairs(words).select("word", "other", "other_n").collect()))
    parts = sorted(some(variants.near_pairs(words, tile=3).select("word", "other", "other_n").collect()))
    assert whole and parts == whole and len(set(whole)) == len(whole)


def test_every_single_edit_is_found_once():
    rng = np.random.default_rng(1)
    words = sorted({"".join(p) for p in product("ab", repeat=7)} | {"".join(p) for p in product("ab", repeat=8)})
    words = [words[i] for i in rng.permutation(len(words))]
    found = Counter()
    for longer in (7, 8, 9):
        own = [w for w in words if longer - 1 <= len(w) <= longer]
        for piece in range(variants.PIECES):
            if own:
                a, b = variants.near_in(own, own, longer, piece)
                found.update((own[i], own[j]) for i, j in zip(a, b))
    assert found == Counter((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_variants_of_nothing(spark):
    assert variants.group_variants(word_frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert variants.group_variants(word_frame(spark, [(1, None), (2, "short words only")])).count() == 0


# --- op12: source divergence

SOURCES = "doc_id long, text string, lang string, source string, term string, block int, p long, value string"


def source_frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 1, 2, "y") for i, (t, g, s) in enumerate(rows)], SOURCES)


def reference_audit(rows, min_docs, top=10):
    docs, counts = Counter(), Counter()
    groups = set()
    for t, g, s in rows:
        t, g, s = t or "", g or "", s or ""
        groups.add((g, s))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
        counts.update((g, s, w) for w in terms)
        docs.update((g, w) for w in set(terms))
    kept = {g: sorted(w for (h, w), n in docs.items() if h == g and n >= min_docs) for g, _ in groups}

    def shares(g, count):
        n, v = sum(count(w) for w in kept[g]), len(kept[g])
        return {w: 1 + 10 ** 9 * (count(w) + 2) // (n + 2 * v) for w in kept[g]}
    p = {(g, s): shares(g, lambda w: counts[g, s, w]) for g, s in groups}
    q = {g: shares(g, lambda w: sum(counts[g, s, w] for h, s in groups if h == g)) for g, _ in groups}
    out = []
    for g, s in groups:
        pair = [(-sum((p[g, s][w] - p[g, o][w]) ** 2 // (p[g, s][w] + p[g, o][w]) for w in kept[g]), o.encode())
                for h, o in groups if h == g and o != s]
        term = [(-((p[g, s][w] - q[g][w]) ** 2 // (p[g, s][w] + q[g][w])), w.encode()) for w in kept[g]
                if counts[g, s, w] and p[g, s][w] > q[g][w]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out += [(g, s, part, i.decode(), -v, n + 1) for n, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        words = [vocabulary[int(rng.zipf(1.3)) % 90] for _ in range(int(rng.integers(0, 80)))]
        rows.append((" ".join(w.upper() if rng.random() < .2 else w for w in words) + "; 12 x_y", "en", source))
    rows += [("wa wb " * 4000, "en", "long"), (None, "en", "silent"), ("", "en", None), ("only here", "de", "a"),
             ("other", "de", "b"), (None, None, None), ("z", None, "s1"), ("wa", "fr", "alone")]
    return rows + rows[:5]


@pytest.mark.parametrize("blocks", [dict(), dict(terms=7, sources=2, columns=5)])
def test_audit_matches_brute_force(spark, sourced, blocks):
    got = divergence.audit(source_frame(spark, sourced), min_docs=5, **blocks)
    assert sorted(some(got.select("lang", "source", "part", "item", "value", "rank").collect())) == \
        reference_audit(sourced, 5)


def test_audit_of_nothing(spark):
    assert divergence.audit(source_frame(spark, [("x", "en", "a")]).limit(0)).count() == 0
    assert divergence.audit(source_frame(spark, [("x", "en", "a")])).count() == 0
    two = divergence.audit(source_frame(spark, [("x", "en", "a"), (None, "en", "b")])).collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in two) == [("a", "b", 0, 1), ("b", "a", 0, 1)]


# --- op13: substring dedup

TEXTS = "doc_id long, text string, pack string, kept string, words int"


def text_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], TEXTS)


def reference_repeats(rows, window):
    least, words = {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append(w)
        for k in range(len(w) - window + 1):
            at = tuple(w[k:k + window])
            rank = (i is None, i)
            least[at] = min(least.get(at, rank), rank)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (i is None, i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(40)] + ["Été", "ÉTÉ"]
    shared = [" ".join(rng.choice(words, int(rng.integers(3, 60)))) for _ in range(8)]
    rows = []
    for i in rng.permutation(150).tolist():
        parts = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(3)]
        parts.insert(1, shared[int(rng.integers(0, 8))] if i % 3 else shared[0])   # a third holds one passage
        rows.append((i - 20, "  \n".join(parts)))
    rows += [(500, None), (501, ""), (502, " \t\x0b"), (503, "a " * 4000), (504, "a " * 4000), (None, shared[0]),
             (None, shared[0]), (505, shared[1]), (505, shared[1]), (506, "a\x1fb " * 30), (507, "a b " * 30)]
    return rows


@pytest.mark.parametrize("window,pack,bucket", [(5, 1 << 12, 100), (6, 1, 1 << 21), (9, 1 << 20, 1 << 21)])
def test_repeats_match_brute_force(spark, passages, window, pack, bucket):
    got = substrings.remove_repeats(text_frame(spark, passages), window, pack, bucket)
    assert sorted(some(got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr) == \
        reference_repeats(passages, window)
    spans = got.select(F.size("removed").alias("s"), F.expr(
        "aggregate(removed, 0, (a, r) -> a + r.end - r.start)").cast("long").alias("n"), "n_removed").collect()
    assert all(r.n == r.n_removed for r in spans) and any(r.s > 0 for r in spans)


def test_long_texts_are_cut_between_words():
    raw = b" ".join([b"abc%d" % i for i in range(500_000)]) + b" " + b"x" * 3_000_000 + b" y"
    assert [w for p in substrings._slices(raw) for w in p.split()] == raw.split()
    assert max(map(len, substrings._slices(raw))) < 6_000_000


def test_gaps_round_trip():
    rng = np.random.default_rng(4)
    for top in (10, 1 << 14, 1 << 25):
        values = np.sort(rng.integers(0, top, 200))
        flags = rng.integers(0, 4, 200)
        got = substrings._ungaps(substrings._gaps(values, flags))
        assert (got[0] == values).all() and (got[1] == flags).all()


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(text_frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_divergence_counts_and_cells_stay_in_arrow():
    rows = [("en", "a", "Ab ab c"), ("en", "b", "c " * 3), ("en", "a", "c é"), ("en", "a", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["lang", "source", "text"])
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for out in divergence._count([batch]) for r in out.to_pylist()}
    assert got == {("a", "ab"): (2, 1), ("a", "c"): (2, 2), ("a", "é"): (1, 1), ("b", "c"): (3, 1)}
    cells = pa.array([{"source": "z", "nth": 9, "p": 9}, {"source": "b", "nth": 1, "p": 5},
                      {"source": "a", "nth": 0, "p": 7}])[1:]
    side = divergence._Levels({"sources": [{"source": "a", "p0": 2}, {"source": "b", "p0": 3}], "cells": cells}, 3)
    assert side.level[side.column].tolist() == [[7, 2, 2], [3, 5, 3]]
