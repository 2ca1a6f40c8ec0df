"""op2, op3, op4, op7: texts judged one by one, and their learning."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matflow.llm import language, mixing, sanitise, toxicity

DOCS = "doc_id long, text string, lang string, s string, score double, base int, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "c", 0.5, 1, "c") for i, t, lang in rows], DOCS)


# --- op2

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


RAW = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def reference_spans(text):
    out = []
    for k, (kind, p) in enumerate(zip(sanitise.KINDS, RAW)):
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in v.split("."))
                    or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1.5.6 000255.1.2.3",
          "4111 1111 1111 1111 5500-0000-0000-0004 4111111111111111", "+1 (555) 123-4567 +44.20.7946.0958..",
          "é😀 bob@x.org 😀 10.0.0.1", "+" * 50 + "1" * 30, "a@" * 500 + "b.c",
          "5 4111111111111111 5 -4111 1111 1111 1111-", "1" * 20000, None, "", "@a.b x@-.-.", "a.b@c.d.e%f@g.h",
          "x" * 100000 + "@", "y" * 5000 + "@q.r " * 300]


def test_base_spans_match_the_plain_patterns(spark):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("019.-+ @ab4("), 60)) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(TRICKY + made)] + [(0, TRICKY[0], None), (None, "q@w.e", "en")]
    got = sanitise.sanitise(frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        spans = reference_spans(t)
        joined = ",".join(f"{sanitise.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        want.append((i, hashlib.sha256(joined.encode()).hexdigest(), *(sum(k == n for _, k, _ in spans) for n in range(4))))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted([(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got], key=key) \
        == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        if not reference_spans(t):
            assert by_id[i].text == (t or "") and by_id[i].spans == ""


def test_disclosing_terms_are_removed(spark):
    filler = "the quick brown fox and the lazy dog of the house " * 6
    rows = [(i, f"{filler} patient zebulon wrote from zeb@clinic.org to the house {filler}", "en") for i in range(4)]
    rows += [(10 + i, filler * 4, "en") for i in range(40)] + [(99, f"{filler} zebulon", "en")]
    got = {r.doc_id: r for r in sanitise.sanitise(frame(spark, rows)).collect()}
    text = got[0].text
    assert "zebulon" not in text and "[EMAIL]" in text and "the house" in text
    assert got[0].n_remove + got[0].n_generalise >= 1
    # the same word away from the entity stays, as do documents without base spans
    assert got[99].text.endswith("zebulon") and got[10].text == filler * 4
    assert {s.split(":")[0] for s in got[0].spans.split(",")} <= set(sanitise.KINDS + sanitise.EXTRA)
    assert sanitise.sanitise(frame(spark, rows).limit(0)).count() == 0


def test_an_entity_of_one_text_counts_and_copies_do_not(spark):
    filler = "the quick brown fox and the lazy dog of the house " * 6
    rows = [(0, f"{filler} zebulon wrote from zeb@clinic.org to the house {filler}", "en"),
            (1, f"{filler} the yarrow wrote to 10.0.0.1 {filler}", "en"), (2, f"{filler} wrote yarrow {filler}", "en")]
    rows += [(10 + i, f"{filler} number{i} " + filler * 4, "en") for i in range(40)]
    once = {r.doc_id: r for r in sanitise.sanitise(frame(spark, rows)).collect()}
    assert "zebulon" not in once[0].text and once[0].n_remove >= 1 and "the house" in once[0].text
    # a text met more often changes nothing
    for copied in (0, 1, 2):
        more = sanitise.sanitise(frame(spark, rows + [(100 + i, rows[copied][1], "en") for i in range(5)])).collect()
        assert len(more) == len(rows) + 5
        assert all(r.spans == once[r.doc_id if r.doc_id < 100 else copied].spans for r in more)


def test_disclosing_terms_go_from_the_whole_text(spark):
    filler = "the quick brown fox and the lazy dog of the house " * 6
    far = f"Zebulon {filler} patient zebulon wrote from zeb@clinic.org to the house {filler} zebulon's end zebulon@q.r"
    rows = [(0, far, "en"), (1, far, "en"), (2, f"{filler} ask 10.0.0.1 {filler} zebulon", "en")]
    rows += [(10 + i, f"{filler} number{i} " + filler * 4, "en") for i in range(40)]
    got = {r.doc_id: r for r in sanitise.sanitise(frame(spark, rows)).collect()}
    assert got[0].spans == got[1].spans and "zebulon" not in got[0].text.lower()
    assert "the house" in got[0].text and got[0].text.endswith("[EMAIL]") and got[0].n_email == 2
    # no mention of the entity: left alone
    assert got[2].text.endswith("zebulon")


def _entities(text):
    """(start, end, entity) of the base spans."""
    out = []
    for a, k, z in reference_spans(text):
        v = text[a:z]
        out.append((a, z, (k, re.sub("[^0-9]", "", v) if k >= 2 else v.lower())))
    return out


def reference_extra(texts, reach, remove, generalise, gain):
    """Spans (start, end, kind) to remove or generalise in each text, word by word."""
    words = {t: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_][^\W_]*", t)] for t in texts}
    free = {t: [w for w in ws if not any(a < w[1] and z > w[0] for a, z, _ in _entities(t))] for t, ws in words.items()}
    n_t, beside = Counter(w for ws in words.values() for *_, w in ws), Counter()
    for t, ws in free.items():
        for s, e, w in ws:
            beside.update({(c, w) for a, z, c in _entities(t) if a - reach <= s and e <= z + reach})
    kind, n_c = {}, Counter()
    for (c, w), n in beside.items():
        n_c[c] += n
    for (c, w), n in beside.items():
        bits = np.log2((n_t[w] + 1) / (n + 1))
        if bits <= generalise and np.log2(sum(n_t.values()) / n_c[c]) - bits >= gain:
            kind[c, w] = 4 if bits <= remove else 5
    return {t: sorted((s, e, min(ks)) for s, e, w in ws
                      if (ks := [kind[c, w] for c in {c for *_, c in _entities(t)} if (c, w) in kind]))
            for t, ws in free.items()}


def test_disclosure_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    common = ["the", "of", "and", "house", "été", "x2", "well"] * 12
    rare = [f"name{i}" for i in range(60)] + [f"Ward{i}" for i in range(20)]
    values = ["zeb@clinic.org", "Zeb@Clinic.org", "10.0.0.1", "+15551234567", "4111 1111 1111 1111", "q.name3@x.org",
              "+1(555)1234567name7", "long" * 60 + "@x.y"]
    texts = [" ".join(rng.choice(common + rare + (values if i % 3 else []), 20 + i)) for i in range(60)]
    texts += [f"{' '.join(rng.choice(common + rare, 40))} solo{i} some{i % 12} u{i}@x.org" for i in range(40)]
    texts += ["a" * 500 + " 10.0.0.1", "10.0.0.1" + "b" * 300, "zeb@clinic.org" * 3, "name1 " * 600 + "10.0.0.1", ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900 + i, texts[i], "en") for i in range(5)] + [(None, None, "en")]
    want = reference_extra(set(texts), sanitise.REACH, sanitise.REMOVE, sanitise.GENERALISE, sanitise.GAIN)
    got = sanitise.sanitise(frame(spark, rows)).collect()
    seen, names = Counter(), sanitise.KINDS + sanitise.EXTRA
    for r in got:
        if r.doc_id is not None:
            text = dict((i, t) for i, t, _ in rows)[r.doc_id]
            every = sorted(reference_spans(text) + [(s, k, e) for s, e, k in want[text]])
            assert r.spans == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in every)
            seen.update(k for *_, k in want[text])
            clean, at = "", 0
            for s, k, e in every:
                if e > at:
                    clean, at = clean + text[at:max(s, at)] + sanitise.MARKS[names[k]], e
            assert r.text == clean + text[at:]
    assert seen[4] > 20 and seen[5] > 20


def test_one_text_of_many_mentions(spark):
    text = " ".join(f"word{i % 5000} m{i}@x.org" for i in range(100_000))
    r = sanitise.sanitise(frame(spark, [(1, text, "en"), (2, "plain words", "en")]), texts=False).where("doc_id = 1").first()
    spans = r.spans.split(",")
    assert r.n_email == 100_000 and sum(s.startswith("email:") for s in spans) == 100_000
    assert spans[1].startswith("email:") or spans[0].startswith("email:")
    last = [s for s in spans if s.startswith("email:")][-1]
    assert last == f"email:{len(text) - len('m99999@x.org')}:{len(text)}"


def test_sanitise_plan_is_native(spark):
    df = sanitise.sanitise(frame(spark, [(1, "a@b.c", "en")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- op3

def sentences(rng, words, n):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(1)
    words = {"xx": ["kral", "vokt", "strum", "grobt"], "yy": ["ailé", "ouié", "éau", "liane"],
             "zz": ["мир", "дом", "река"]}
    rows = [(i, sentences(rng, words[w], 1 + i % 90), w) for i, w in enumerate(["xx", "yy", "zz"] * 100)]
    return rows + [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 ...", "xx"), (1003, "kral vokt " * 20000, None),
                   (None, "kral strum", "xx"), (0, rows[0][1], "xx")]


def test_language_learns_and_holds_out(spark, tongues):
    docs = frame(spark, tongues)
    pieces = language.training_pieces(docs)
    held = {t for i, t, _ in tongues if i is not None and t and zlib.crc32(str(i).encode()) % 5 == 0}
    assert {y for _, y in pieces} == {"xx", "yy", "zz"}
    net = language.fit(pieces)
    out = language.with_language(docs, net).select(
        "doc_id", "lang", language.held_out(docs["doc_id"]).alias("held"), "language.*").toDF(
        "doc_id", "lang", "held", "pred", "sc").collect()
    assert len(out) == len(tongues) and all(0 <= r.sc <= 1 for r in out)
    tested = [r for r in out if r.held and r.doc_id < 1000]
    assert len(tested) > 30 and sum(r.pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in out if r.doc_id is not None)
    by_id = {r.doc_id: r for r in out}
    assert [by_id[i].pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003].pred == "xx"


def test_language_of_nothing(spark, tongues):
    docs = frame(spark, tongues)
    assert language.training_pieces(docs.limit(0)) == []
    assert language.fit([]) is None
    assert {r.language.lang for r in language.with_language(docs, None).collect()} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}
    assert language.keep_known(docs.limit(0)).count() == 0


def test_every_window_counts():
    net = language.fit([("kral vokt " * 20, "xx"), ("ouié éau " * 20, "yy")] * 10)
    assert language.cut(b"").shape == (1, language.WINDOW)
    whole = language.cut(("kral vokt " * 100).encode())
    assert whole.size >= 1000
    one = net.posterior(whole)
    many = np.concatenate([net.posterior(whole[i:i + 1]) for i in range(len(whole))])
    assert np.allclose(one, many, atol=1e-5)


# --- op7

def toxic_rows():
    rng = np.random.default_rng(2)
    words = [f"wort{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        lines = [sentences(rng, words, 8) for _ in range(int(rng.integers(1, 30)))]
        bad = i % 5 == 0
        if bad:
            k = int(rng.integers(0, len(lines)))
            lines[k] += " " + str(rng.choice(["scoundrel", "villainy"]))
        rows.append((i, ". ".join(lines), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_documents_and_sentences(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "wort1 wort2. " * 20000, "en"), (0, rows[0][1], "en"),
             (None, "wort3 villainy", "en")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1), (7, None, 0)],
                                "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, lab, held_out=toxicity.held_out(lab["doc_id"])))
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    tested = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = sum(by_id[i].predicted == (i % 5 == 0) for i in tested)
    assert len(tested) > 100 and hits >= 0.97 * len(tested)
    assert (by_id[1000].score, by_id[1001].score, by_id[1002].predicted) == (0.0, 0.0, 0)
    text = dict((i, t) for i, t, _ in rows)
    for i in tested:
        if i % 5 == 0 and by_id[i].predicted:
            assert any(re.search("scoundrel|villainy", text[i][s.start:s.end]) for s in by_id[i].offending)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", "en")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, none))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0]


def test_noisy_or_combines_sentences():
    model = toxicity.Model({"bad": 6.0}, -6.0)
    one, n, marked = model.score("fine. bad! fine")
    two, _, _ = model.score("bad. bad")
    assert n == 3 and abs(one - 0.5) < 1e-9 and abs(two - 0.75) < 1e-9
    assert [("fine. bad! fine"[a:z]).strip() for a, z, _ in marked] == ["bad"]


# --- op4

def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([4, 1, 1], 3000)
    n = rng.integers(0, 500, 3000)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    for goal in ([0.5, 0.3, 0.2], [0.8, 0.15, 0.05], [0.95, 0.04, 0.01]):
        steps, left = mixing.solve(rows, goal)
        got = rows.select("n_tokens", "p", mixing.rate_of(rows["p"], steps).alias("r")).collect()
        r = np.array([x.r for x in got])
        w = np.array([x.n_tokens for x in got])
        posterior = np.array([x.p for x in got])
        total = (r * w) @ posterior / w.sum()
        # brute force: plain projected steps on dense arrays, run to the end
        dense = np.ones(len(w))
        inverse = np.linalg.inv((posterior * w[:, None]).T @ posterior / w.sum())

        def loss(x):
            left = (x * w) @ posterior / w.sum() - goal
            return left @ inverse @ left
        for _ in range(2000):
            dense = np.maximum(0, dense - posterior @ (inverse @ ((dense * w) @ posterior / w.sum() - goal)))
        assert (r >= 0).all()
        # the last goal is out of reach (nearly all rates are cut off): close is enough
        assert loss(r) - loss(dense) < (1e-6 if goal[0] < 0.9 else 0.02 * loss(np.ones(len(w))))
        if goal[0] < 0.9:
            assert np.abs(total - goal).max() < 1e-3
        assert abs(left - np.abs(total - goal).max()) < 1e-2


def test_mixing_of_documents(spark):
    rng = np.random.default_rng(4)
    good, poor = [f"gut{i}" for i in range(50)], [f"mies{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(300):
        rows.append((i, sentences(rng, poor if i % 4 == 0 else good, 40) + (" venom" if i % 6 == 1 else ""), "en"))
        labels.append((i, 0 if i % 4 == 0 else 1, int(i % 6 == 1)))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "gut1 gut2", "en"), (0, rows[0][1], "en")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels + [(9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out, _, _, left = mixing.rates(docs, lab)
    assert left < 1e-3
    got = out.collect()
    assert len(got) == len(rows)
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([r.p for r in got])
    share = (n * np.array([r.rate for r in got])) @ p / n.sum()
    assert np.abs(share - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 1e-3
    assert all(int(np.floor(r.rate)) <= r.copies <= int(np.floor(r.rate)) + 1 for r in got)
    mixed = mixing.mix(docs, lab)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0), lab).count() == 0
    even, *_ = mixing.rates(docs, lab.limit(0))
    assert np.allclose([r.p for r in even.collect()], 1 / 3)


def test_domains_are_told_apart(spark):
    """Held-out labelled documents of the given tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    texts, shares = mixing.training_rows(docs, labels.where("doc_id % 2 = 0"))
    model = mixing.fit(texts, shares=shares)
    held = (docs.join(labels.where("doc_id % 2 = 1"), "doc_id").where("text is not null")
            .select("text", mixing.domain_of(labels["quality"], labels["toxic"]).alias("d")).where("d is not null").collect())
    right = sum(mixing.DOMAINS[int(model.posterior(r.text)[1].argmax())] == r.d for r in held)
    assert len(held) > 1000 and right >= 0.88 * len(held)


def test_rows_without_ids_are_copied_each_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(None, sentences(rng, ["mies1", "mies2", "gut1"], 12), "en") for _ in range(400)]
    rows += [(None, "mies1 gut1", "en")] * 400
    labels = [(i, i % 2, 0) for i in range(60)]
    learned = [(i, "gut1 gut2 gut3" if i % 2 else "mies1 mies2 mies3", "en") for i in range(60)]
    docs = frame(spark, rows + learned)
    out, _, _, left = mixing.rates(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                                   {"good": 0.5, "poor": 0.25, "toxic": 0.0})
    own = [r for r in out.collect() if r.doc_id is None]
    expected, copies = sum(r.rate for r in own), sum(r.copies for r in own)
    assert len(own) == 800 and abs(copies - expected) < 80
    parts = {r.copies for r in own if 0.1 < r.rate % 1 < 0.9}
    assert len(parts) > 1 or not parts


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = np.random.default_rng(12)
    words = [f"wort{i}" for i in range(100)]
    rows = [(i, sentences(rng, words, 1600) + (". sly villainy here" if i % 2 else "")
             + f". {sentences(rng, words, 4)}", "en") for i in range(60)]
    assert min(len(t) for _, t, _ in rows) > 8000
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(frame(spark, rows), lab))
    assert [r.predicted for r in toxicity.score(frame(spark, rows), model).orderBy("doc_id").collect()] == [0, 1] * 30
    # the bound takes whole texts only
    few = toxicity.training_rows(frame(spark, rows), lab, chars=40_000)
    assert {y for _, y in few} == {0, 1} and len(few) < 12 and {t for t, _ in few} <= {t for _, t, _ in rows}


def test_languages_need_labels_and_none_is_left_out(spark):
    bare = frame(spark, [(1, "kral vokt", None), (2, "ouié", None)])
    with pytest.raises(ValueError):
        language.keep_known(bare)
    many = frame(spark, [(i, f"kral{i % 230} vokt " * 3, f"l{i % 230:03d}") for i in range(1380)])
    pieces = language.training_pieces(many)
    assert len({y for _, y in pieces}) == 230
    one = language.training_pieces(many, chars=10)
    assert len(one) == 230 == len({y for _, y in one})


def test_language_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abc", "xx", 1), (2, "abc", "yy", 2)],
                                 "doc_id long, text string, lang string, language int")
    net = language.fit([("abc", "xx"), ("abc", "yy")])
    for name in ("out", "out_bias"):
        getattr(net, name)[:] = 0
    out = language.with_language(docs, net)
    assert [(r.language, r.language_.lang) for r in out.orderBy("doc_id").collect()] == [(1, "xx"), (2, "xx")]
