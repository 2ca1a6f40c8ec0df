"""op1, op5, op6 and the pipeline: files written and read back, chat repair."""
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from matflow.llm import chat, common, tokens, warc

TOKENIZER = "byte_bpe_50k.json"


# --- op1

def test_archives_round_trip_and_revisits(spark):
    big = "x" * 200
    rows = [(5, "http://a/\r\nInjected: 1", big), (2, "http://b", big), (9, None, big), (2, "http://b", big),
            (7, "http://c", "short"), (8, "http://d", "short"), (1, "u", None), (3, "u", ""), (None, "v", big),
            (4, "w", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (6, "w", "é😀" * 60), (10, "l", "y" * 300000)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows],
                                  "page_id long, url string, html string, payload string, record_id int")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    data = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(data[r.page_id])
        assert r.payload_digest == hashlib.sha256(data[r.page_id]).hexdigest()
    kind = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got
                  if r.payload_digest == hashlib.sha256(big.encode()).hexdigest())
    assert kind == [(-1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (5, "revisit", 2), (9, "revisit", 2)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_revisits_of_archives_that_hold_revisits(spark):
    """A second pass keeps revisits, and joins them to the original again."""
    pages = spark.createDataFrame([(i, f"http://{i}", "p" * 150) for i in range(6)], "page_id long, url string, html string")
    folder = common.new_folder(spark, "warc-test")
    warc.write_pages(pages, f"{folder}/raw")
    warc.deduplicate_archives(spark, f"{folder}/raw", f"{folder}/once")
    warc.deduplicate_archives(spark, f"{folder}/once", f"{folder}/twice")
    rows = warc.read_archives(spark, f"{folder}/twice", payloads=True).collect()
    assert sorted((r.page_id, r.warc_type, r.refers_to_page, r.payload is None) for r in rows) == [
        (0, "response", None, False)] + [(i, "revisit", 0, True) for i in range(1, 6)]
    original = next(r for r in rows if r.page_id == 0)
    assert {r.refers_to_id for r in rows if r.page_id} == {original.record_id}
    assert len({r.record_id for r in rows}) == 6


def test_damaged_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc._parse(b"garbage"))


# --- op5

@pytest.mark.parametrize("trial", range(40))
def test_simple8b_round_trip(trial):
    rng = np.random.default_rng(trial)
    lengths = rng.integers(0, 3000, rng.integers(0, 6))
    n = int(lengths.sum())
    v = rng.integers(0, 1 << 62, n, dtype=np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
    if trial % 3 == 0:
        v %= np.uint64(50257)
    if trial % 7 == 0:
        v[:] = 0
    if trial % 5 == 0 and n:
        v[rng.integers(0, n, 3)] = np.uint64(2**64 - 1)
    words, first = tokens.encode(v, lengths)
    assert (tokens.decode(words, first, lengths) == v).all()
    # a block decodes by itself
    if len(first) > 2 and lengths[0] > tokens.BLOCK:
        part = words[first[0]:first[1]]
        assert (tokens.decode(part, np.array([0, len(part)]), np.array([tokens.BLOCK])) == v[:tokens.BLOCK]).all()


def test_simple8b_packs_small_ids():
    words, _ = tokens.encode(np.zeros(600, np.uint64), np.array([600]), block=1024)
    assert len(words) == 10
    words, _ = tokens.encode(np.full(400, 40000, np.uint64), np.array([400]), block=1024)
    assert len(words) == 134


def test_tokens_match_the_tokenizer(spark):
    rng = np.random.default_rng(0)
    alphabet = list("abcé ÀßZ019'\n\t.,;!?-—  日") + ["'s", "'ll", " \n ", "<|endoftext|>", " ", "\x0b", "\x0c", "\x1c", "\x00", "\x7f", "\x85", "½", "𝒜"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(300)]
    texts += ["word " * 40000, "", None, "  lead", "trail  ", "It's we'LL"]
    ids = [int(i) for i in rng.permutation(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in zip(ids, texts)], "doc_id long, text string, start int, file string")
    got = {r.doc_id: r for r in tokens.tokenize(docs, tokenizer=TOKENIZER).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    at = 0
    for i, t in sorted(zip(ids, texts)):
        own = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_tokens_over_several_files(spark):
    docs = spark.createDataFrame([(i % 90 if i else None, "some words here " * (i % 7)) for i in range(200)],
                                 "doc_id long, text string")
    folder = common.new_folder(spark, "tokens-test") + "/t"
    tokens.write_tokens(docs, folder, file_bytes=1500)
    rows = tokens.read_tokens(spark, folder).orderBy("file", "at").collect()
    assert len({r.file for r in rows}) > 3 and len(rows) == 200
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    assert tokens.tokenize(docs.limit(0)).count() == 0


# --- op6

def cheapest(roles):
    """Least cost over all legal repairs, by trying every choice."""
    best = [chat.BIG]

    def walk(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.ENDING[state][0])
            return
        for y in (1, 2, 3):
            label = chat._label_cost(roles[i], y)
            if (state, y) in chat.LEGAL:
                walk(i + 1, y, cost + label)
            if state == y:
                walk(i + 1, y, cost + chat.MERGE + label)
            for z in (1, 2, 3):
                if (state, z) in chat.LEGAL and (z, y) in chat.LEGAL:
                    walk(i + 1, y, cost + chat.INSERT + label)
    walk(0, chat.START, 0)
    return best[0]


def cost_of(roles, picks):
    state, total = chat.START, 0
    for role, (action, y, z) in zip(roles, picks):
        if action == "insert":
            assert (state, z) in chat.LEGAL and (z, y) in chat.LEGAL
            total += chat.INSERT
        elif action == "merge":
            assert state == y
            total += chat.MERGE
        else:
            assert (state, y) in chat.LEGAL
        total += chat._label_cost(role, y)
        state = y
    return total + chat.ENDING[state][0]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_repair_costs_are_least(length):
    for roles in itertools.product(range(4), repeat=length):
        assert cost_of(roles, chat.choose(list(roles))) == cheapest(roles)


def test_segments_compose():
    rng = np.random.default_rng(0)
    for _ in range(50):
        roles = [int(r) for r in rng.integers(0, 4, 30)]
        cut = int(rng.integers(1, 30))
        a, b, whole = (chat.segment_matrix(x) for x in (roles[:cut], roles[cut:], roles))
        for x, y in itertools.product(range(4), repeat=2):
            assert whole[4 * x + y] == min(chat.BIG, min(a[4 * x + z] + b[4 * z + y] for z in range(4)))


ROLE = [None, "system", "user", "assistant", "Tool"]


def test_conversations_across_partitions(spark, no_coalesce):
    """One conversation with most of the rows spans several tasks; the repair is as
    cheap as in one piece, and the fragments make the legal text."""
    rng = np.random.default_rng(6)
    rows = [(1, i, ROLE[rng.integers(0, 5)], f"t{i}") for i in range(2000)]
    rows += [(c, t, ROLE[rng.integers(1, 4)], f"{c}.{t}") for c in range(2, 60) for t in range(int(rng.integers(1, 6)))]
    rows += [(None, 0, "user", "n"), (None, None, None, None), (70, 0, "assistant", "<|im_end|> x" * 9000), (71, 3, "user", ""),
             (71, 3, "user", ""), (72, 0, "system", None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, rid int, pid string")
    out = chat.repair(df).collect()
    assert len(out) == len(rows)
    by_conv = {}
    for r in out:
        by_conv.setdefault(r.conv_id, []).append(r)
    number = {r: i + 1 for i, r in enumerate(chat.ROLES)}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r.turn is not None, r.turn or 0))
        roles = [chat.role_code(r.role) for r in turns]
        picks = [(r.action, number[r.new_role], number.get(r.inserted, 0)) for r in turns]
        assert cost_of(roles, picks) == cost_of(roles, chat.choose(roles))
        text = "".join(r.fragment for r in turns)
        parts = text.split(chat.OPEN)
        names = [p.split("\n")[0] for p in parts[1:]]
        assert parts[0] == "" and all(p.endswith(chat.CLOSE) for p in parts[1:])
        body = names[1:] if names[0] == "system" else names
        assert body == ["user", "assistant"] * (len(body) // 2) and body
    assert chat.repair(df.limit(0)).count() == 0


# --- pipeline

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    extra = docs.selectExpr("*", "1 as found", "'x' as language").unionByName(
        docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars",
                                 "1 found", "'x' language"))
    for name, stage in corpus_pipeline.STAGES:
        before = extra
        extra = common.shared_table(stage(spark, before, sf), f"test-{name}")
        if name != "token_files":
            assert extra.columns == before.columns
            assert 0 < extra.count() <= before.count() * 2
    assert extra.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(extra.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]]))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_rows_of_one_id_fill_several_files(spark):
    rows = [(None, f"w{i} " * 300, "en", "x", "y") for i in range(200)] + [(7, "same " * 200, "en", "x", "y")] * 200
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    folder = common.new_folder(spark, "hot-id") + "/t"
    tokens.write_tokens(docs, folder, file_bytes=40_000)
    read = tokens.read_tokens(spark, folder).collect()
    of = {}
    for r in read:
        of.setdefault(r.doc_id, set()).add(r.file)
    assert len(read) == 400 and len(of[None]) > 1 and len(of[7]) > 1


def test_offsets_come_from_groups_of_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_FILES", 3)
    monkeypatch.setattr(tokens, "FILE_TEXT_BYTES", 500)
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    folder = common.new_folder(spark, "groups") + "/t"
    tokens.write_tokens(docs, folder, file_bytes=5_000)
    monkeypatch.setattr(tokens, "write_tokens", lambda *a, **k: None)
    got = tokens.tokenize(docs, folder).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert len(got) == 300


def test_the_memory_of_pieces_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    enc = tokens.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = " ".join(f"piece{i}x" for i in range(2000))
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False)
    for _ in range(3):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == plain.ids
        held = sum(tokens._held(p, i) for p, i in enc.known.items())
        assert held < 20_500
        enc.known.trim()
        assert enc.known.room > 0


def test_white_space_around_roles_does_not_matter(spark):
    roles = ["user", "assistant\n", " user\t", "\r\nuser", "assistant", "\x0bsystem "]
    rows = [(c, t, r if c else r.strip(), f"t{t}") for c in (0, 1) for t, r in enumerate(roles)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): (r.action, r.new_role, r.inserted, r.fragment) for r in got}
    assert [by[0, t] for t in range(6)] == [by[1, t] for t in range(6)]


def test_pipeline_without_labels_raises(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(ValueError):
        corpus_pipeline.language_id(spark, docs, "")
