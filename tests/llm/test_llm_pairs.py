"""op8, op9, op10 against brute-force versions, and their edge cases."""
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matflow.llm import components, decontaminate, exactdedup, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, fp string, found string, __key int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "ÉA"]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(rng.choice(words, rng.integers(0, 60)))))
    base = " ".join(rng.choice(words, 400))
    for i in range(150, 200):
        parts = base.split()
        parts[int(rng.integers(0, 400))] = "changed"
        rows.append((i, "  ".join(parts)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, base), (203, base), (None, base), (None, None),
             (204, "One TWO three"), (205, "one two three"), (206, "a " * 30000)]
    return rows


def reference_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(codes, ids, distance):
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(codes))]


def key(row):
    return tuple((v is None, v) for v in row)


def test_near_duplicates_match_brute_force(spark, corpus):
    codes = [reference_fingerprint(t) for _, t in corpus]
    comp = reference_components(codes, [i for i, _ in corpus], 4)
    want = sorted([(i, f"{c:016x}", g) for (i, _), c, g in zip(corpus, codes, comp)], key=key)
    got = simhash.near_duplicates(frame(spark, corpus)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=key) == want
    # a component of near copies was found
    assert max(np.bincount([g for g in comp if g is not None])) >= 40


def test_keep_one_keeps_one_row_per_component(spark, corpus):
    docs = frame(spark, corpus)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    codes = [reference_fingerprint(t) for _, t in corpus]
    comp = reference_components(codes, [i for i, _ in corpus], 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert simhash.keep_one(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert [r.doc_id for r in simhash.keep_one(frame(spark, [(None, "x"), (None, "x")])).collect()] == [None]


def test_keep_one_tells_rows_with_one_id_apart(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(500)], 300)) for _ in range(12)]
    ids = [None] * 6 + [7] * 4 + [8, 9]
    # clean texts under a null and a repeated id, and copies of them under these ids
    rows = list(zip(ids, texts)) + [(None, texts[10]), (7, texts[11]), (None, texts[6]), (None, texts[0])]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    by_text = {r.text: r.doc_id for r in kept}
    assert [by_text[t] for t in texts] == ids[:11] + [7]


@pytest.mark.parametrize("spread", [3, 10, 64])
def test_index_links_like_brute_force(spread):
    """Random and clustered codes below one upper node, large enough for the tree."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = set()
    for _ in range(1500):
        c = int(centres[rng.integers(0, 6)])
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            c ^= 1 << int(b)
        codes.add(c)
    codes = np.array(sorted(codes), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    want = reference_components([int(c) for c in codes], list(range(len(codes))), 4)
    a, b = simhash.link(codes, np.zeros(len(codes), np.int64), 4)
    place = {int(c): i for i, c in enumerate(codes)}
    got = list(range(len(codes)))
    for x, y in zip(a, b):
        got[place[int(x)]] = place[int(y)]
    assert got == want


def test_gray_rank_is_the_inverse_of_gray_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).selectExpr("id a", "id - 1 b")
    got = components.components(edges).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, 0) for i in range(1, 300)]
    assert components.components(edges.limit(0)).count() == 0


# --- exact duplicates

def test_exact_dedup_matches_brute_force(spark, corpus):
    rows = corpus + [(300, "x"), (301, " x"), (302, "x\n"), (303, "x")]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (i, t), n in zip(rows, norm):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted([(i, min(groups[n])[3], len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                   for (i, _), n in zip(rows, norm)], key=key)
    for candidates in (1, 1000):
        got = exactdedup.deduplicate(frame(spark, rows), candidates=candidates).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == want
        # exactly one row of each group stays
        kept = [r.text_sha256 for r in got if r.kept]
        assert len(kept) == len(set(kept)) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_frequent_digests_over_two_levels(spark):
    # hot in a third of the rows, one in each hundred, the others met once
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN 'warm' ELSE sha2(string(id), 256) END AS digest").repartition(17)
    for merges in (1, 4, 512):
        got = {r.digest for r in exactdedup.frequent_digests(rows, 20, 1024, merges).collect()}
        assert {"hot", "warm"} <= got and len(got) <= 20
    assert exactdedup.frequent_digests(rows.limit(0)).collect() == []


def test_exact_dedup_of_nothing(spark):
    assert exactdedup.deduplicate(frame(spark, [(1, "x")]).limit(0)).count() == 0


# --- decontamination

def reference_hits(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got is not None:
                    hit[k:k + n] = [True] * n
                    found |= got
        out.append((i, len(w), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=key)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_contamination_matches_brute_force(spark, least):
    rng = np.random.default_rng(least)
    words = np.array(["a", "b", "c", "É", "x1"])
    items = [(i, "-".join(rng.choice(words, rng.integers(least, 25)))) for i in range(20)]
    items += [(20, None), (None, "a b c"), (21, ""), (22, "..."), (3, "a b a b c")]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 80)))) for i in range(60)]
    docs += [(100 + i, f"q {t} q. " + "z " * 300) for i, t in items[:20]]
    docs += [(200, None), (201, ""), (202, "z " * 20000 + items[0][1]), (0, docs[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = reference_hits(docs, items)
    for chars in (2_000_000, 60):
        got = decontaminate.find_contamination(frame(spark, docs), bench, block_chars=chars).collect()
        assert sorted([(r.doc_id, r["found_"].n_words, r["found_"].n_hit, tuple(r["found_"]["items"]), r.contaminated)
                       for r in got], key=key) == want


def test_long_and_repeated_items_are_cut_into_parts(spark, monkeypatch):
    """One item far beyond a block, one id and one text in a third of the items each."""
    monkeypatch.setattr(decontaminate, "PART_WORDS", 7)
    rng = np.random.default_rng(5)
    words = np.array(["a", "b", "c", "d"])
    long = " ".join(rng.choice(words, 600))
    items = [("l", long)] + [("same", " ".join(rng.choice(words, 15))) for _ in range(20)]
    items += [(f"t{i}", long[:41]) for i in range(20)] + [("e", "z z z"), ("e", "z z z"), (None, "y y")]
    docs = [(i, " ".join(rng.choice(words, 60))) for i in range(30)]
    docs += [(100, long), (101, f"z z z z {long[200:260]} y y"), (102, long[300:330])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    blocks, automata = decontaminate._automata(bench, 13, 300)
    rows = automata.select("block", F.length("automaton").alias("size")).collect()
    assert blocks > 8 and len({r.block for r in rows}) == len(rows) > blocks / 2
    assert max(r["size"] for r in rows) < 60_000
    want = reference_hits(docs, items)
    for chars in (300, 2_000_000):
        got = decontaminate.find_contamination(frame(spark, docs), bench, block_chars=chars).collect()
        assert sorted([(r.doc_id, r["found_"].n_words, r["found_"].n_hit, tuple(r["found_"]["items"]), r.contaminated)
                       for r in got], key=key) == want


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"b{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = "Begin, " + "clean " * 400 + "(" + item.upper() + ")! end"
    docs = spark.createDataFrame([(1, item, 0), (2, long, len(long)), (3, "clean text", 10), (4, None, None)],
                                 "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].text == "Begin, " + "clean " * 400 + "(" + " " * 0 + ")! end"
    assert got[2].n_chars == len(got[2].text) and got[3].n_chars == 10
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_items_without_id_hit_but_are_not_listed(spark):
    words = " ".join(f"t{i}" for i in range(20))
    docs = frame(spark, [(1, words), (2, "other words " * 20), (3, f"{words} and {words[::-1]}")])
    bench = spark.createDataFrame([(None, words), ("b", "t0 t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12"), (None, None)],
                                  "item_id string, text string")
    got = decontaminate.find_contamination(docs, bench).orderBy("doc_id")
    got = got.select("found_.n_hit", "found_.items", "contaminated").collect()
    assert [(r.n_hit, r["items"], r.contaminated) for r in got] == [(20, ["b"], True), (0, [], False), (20, ["b"], True)]
    for_blocks = decontaminate.find_contamination(docs, bench, block_chars=40).orderBy("doc_id")
    assert [r.found_.n_hit for r in for_blocks.collect()] == [20, 0, 20]
