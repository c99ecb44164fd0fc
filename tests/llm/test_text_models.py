"""Language, tokens, mixing, chat, search and scoring on hand-made rows and against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from fixtures import LONG, ROWS, collected, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwheel.llm import bpe, chat, importance, langid, lm_scoring, mixing, token_counts, topk_search
from tarnwheel.llm.base import slices
from tarnwheel.sources.tables import load_table

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


# ---- tokens -----------------------------------------------------------------

ODD = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "ß", "中", "😀", "̀", " ", " th", "e", "ing", "0", "9", "\x00",
       "!", "..", "\t", "՘", "ᲊ", "\U000323b0", "ſ", "<|endoftext|>", "<|endof", "text|>", "\x1c", "\x85"]


def odd_texts(tokens, n=3000):
    rng = random.Random(4)
    vocabulary = [t.decode("utf-8", "ignore") for t in tokens]
    for k in range(n):
        pick = (ODD, vocabulary)[k % 2]
        yield "".join(rng.choice(pick) for _ in range(rng.randint(0, 14)))
        yield "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 12)))


def test_encoder_equals_merging_in_order():
    tokens = bpe.read_ranks(RANKS)
    encoder = bpe._encoder(RANKS, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in [*odd_texts(tokens), LONG, "a" * 5000, "ab" * 3000, " " * 3000]:
        ids = encoder.encode(text).tolist()
        assert ids == theirs.encode_ordinary(text)
        assert bpe.decoded(bpe._vocabulary(RANKS), np.array([0, len(ids)]), np.array(ids, np.int32)).to_pylist() == [text.encode()]


def test_transducer_equals_the_library():
    compiled = token_counts.counter(BYTES)
    theirs = Tokenizer.from_file(BYTES)
    for text in [*odd_texts(compiled.transducer.merges.tokens), LONG, "a" * 5000, "ab" * 3000, " " * 3000]:
        want = len(theirs.encode(text, add_special_tokens=False).ids)
        assert compiled.count(text) == want
        assert compiled.count(text, chunk_chars=7) == want


def test_transducer_starts_over_when_it_has_grown(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 5)
    compiled = token_counts.Counter(BYTES)
    want = len(Tokenizer.from_file(BYTES).encode(LONG, add_special_tokens=False).ids)
    assert compiled.count(LONG) == want
    assert len(compiled.transducer.steps) < 200


def test_token_counts(spark):
    theirs = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text, *_ in ROWS:
        n = len(theirs.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    found = token_counts.token_counts(documents(spark), BYTES)
    assert collected(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(documents(spark, []), BYTES).count() == 0


def test_bpe(spark):
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    coded = bpe.decode(bpe.encode(documents(spark), RANKS), RANKS)
    got = collected(coded, "doc_id", "ids", "decoded")
    want = [(d, theirs.encode_ordinary(t or ""), bytearray((t or "").encode())) for d, t, *_ in ROWS]
    assert got == sorted(want, key=repr)
    first = coded.select("doc_id", *bpe.digests()).where("doc_id = 4").first()
    assert (first["n_tokens"], first["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode(documents(spark, []), RANKS).count() == 0
    null_ids = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(null_ids, RANKS).first()["decoded"] is None


# ---- language ---------------------------------------------------------------


def test_a_worker_forgets_what_it_encoded(spark):
    """What an encoder remembers of texts goes with its task: workers live on in other work."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(64)]
    assert bpe.encode(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(16), path).count() == 64

    def remembered(batches):
        for _ in batches:
            known = [bpe._encoder(path, public_tokenizers.PATTERN)] if bpe._encoder.cache_info().currsize else []
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.pieces) + len(e.merges.agreed) for e in known)], pa.int64())], ["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(remembered, "n long").collect()} == {0}


def test_what_was_forgotten_changes_no_ids():
    encoder = bpe._encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    first = encoder.encode(LONG[:5000]).tolist()
    assert encoder.pieces and encoder.merges.agreed
    encoder.forget()
    assert not encoder.pieces and not encoder.merges.agreed
    assert encoder.encode(LONG[:5000]).tolist() == first


def test_slices_give_unused_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["n"]) for n in (5, 2)]
    assert [b.num_rows for b in slices(iter(batches), 2)] == [2, 2, 1, 2]
    assert len(freed) == 2


def test_language_of_all_documents(spark):
    docs = load_table(spark, FOLDER, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", langid.held_out())
    rows = found.where("held").collect()
    assert len(rows) > 30 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    # labelled documents stay
    assert found.where("rejected").count() == 0
    assert langid.accepted(docs, model).count() == docs.count()


def test_language_of_other_texts(spark):
    docs = load_table(spark, FOLDER, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60))
    rows = [(20, noise, None, None), (21, "Это совсем другой язык, которого нет среди размеченных документов", None, None), *ROWS]
    found = {r["doc_id"]: r for r in langid.identify(documents(spark, rows), model).collect()}
    assert found[20]["rejected"] and found[21]["rejected"]
    for doc_id in (3, 4, 7, 9):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"], found[doc_id]["rejected"]) == ("und", 0.0, True)
    assert found[1]["lang_pred"] in model.langs
    kept = langid.accepted(documents(spark, rows), model)
    assert kept.columns == documents(spark).columns and not {3, 4, 7, 9, 20, 21} & {r["doc_id"] for r in kept.collect()}


def test_models_are_distributions(spark):
    """The probabilities of all codes after any context add up to one, the unseen code's share included."""
    model = langid.fit({"x": [*langid_counts("abab bac cab")], "y": [*langid_counts("zzz zy")]})
    alphabet = sorted(set(b"abczy ".decode().replace(" ", "\x01")))
    codes = [ord(c) for c in alphabet]
    for context in ("", "a", "ab", "aba", "zz", "q"):
        before = [1] * langid.ORDER + [ord(c) for c in context]
        grams = []
        for c in codes:
            gram = 0
            for code in [*before, c][-langid.ORDER :]:
                gram = gram << 16 | code
            grams.append(gram)
        total = np.exp(-langid.losses(model, np.array(grams, np.uint64)).astype(float)).sum(axis=0)
        unseen = np.exp(-langid.losses(model, np.array([grams[0] & ~0xFFFF | 0x4E2D], np.uint64)).astype(float))[0]
        assert np.allclose(total + unseen, 1, atol=1e-5)


def langid_counts(text):
    codes, piece_of, _, _ = langid.encoded([text])
    return np.unique(langid.packed(codes)[piece_of >= 0], return_counts=True)


def test_texts_do_not_touch_each_other(spark):
    texts = ["abc", "", "Zz zz", "...", "x" * 10]
    codes, piece_of, lengths, letters = langid.encoded(texts)
    for i, text in enumerate(texts):
        own, piece, n, l = langid.encoded([text])
        assert (langid.packed(codes)[piece_of == i] == langid.packed(own)[piece == 0]).all()
        assert (lengths[i], letters[i]) == (n[0], l[0])


def test_without_labels_or_rows(spark):
    empty = langid.train(documents(spark, [r for r in ROWS if r[2] is None]))
    found = langid.identify(documents(spark), empty).collect()
    assert len(found) == len(ROWS) and all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in found)
    assert langid.identify(documents(spark, []), empty).count() == 0


# ---- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    """By repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(2 * sizes[s] for s in stopped)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in stopped else level * weight[s] for s in order}
        stopped |= above


def check_mix(rows, found, block, loose=0.0):
    sizes, taken, target = Counter(), Counter(), {}
    source_of = {}
    for doc_id, text, _, source in rows:
        source_of.setdefault(doc_id, source)
        sizes[source] += len((text or "").encode().split())
    for r in found:
        source = source_of[r["doc_id"]]
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source]
    want = brute_targets({s: sizes[s] for s in {r[3] for r in rows}})
    for source, value in want.items():
        assert math.isclose(target[source], value, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[source] - value) <= 2 * block + 2 + loose * value


@pytest.mark.parametrize("shard_words", [1 << 20, 500])
def test_mix_of_all_documents(spark, shard_words):
    docs = load_table(spark, FOLDER, "documents")
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    plan = mixing.Plan(block_words=32, shard_words=shard_words)
    found = mixing.mix(docs, plan).collect()
    # blocks of a small shard are a few words longer or shorter than those of another
    check_mix(rows, found, 32, loose=0.0 if shard_words > 500 else 0.03)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(3), plan).collect()))


def test_mix_of_odd_rows(spark):
    rows = [r for r in ROWS if r[0] is not None]
    found = mixing.mix(documents(spark, rows), mixing.Plan(block_words=1)).collect()
    assert len(found) == len(rows)
    check_mix(rows, found, 1)
    assert mixing.mix(documents(spark)).count() == len(ROWS)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {(r["target"], r["taken"]) for r in mixing.mix(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()} == {(0.0, 0)}


def test_apportionment(spark):
    rng = random.Random(8)
    for _ in range(3):
        votes = {i: rng.choice([0, 1, 3, 7, 50, 50, 1000]) * rng.random() for i in range(9)}
        seats = rng.randrange(60)
        rows = [(0, i, v, seats) for i, v in votes.items()]
        won = mixing.sainte_lague(spark.createDataFrame(rows, "g int, p int, v double, seats long"), ["g"], "p", "v", "seats")
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() for k in range(seats) if v > 0))[:seats]
        want = Counter(p for _, p in quotients)
        assert {r["p"]: r["won"] for r in won.collect()} == {p: want[p] for p in votes}


def test_mixed_rows_keep_columns_and_sources_near_target(spark):
    docs = load_table(spark, FOLDER, "documents")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    repeats = Counter(r["doc_id"] for r in mixed.collect())
    assert max(repeats.values()) <= 2
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert abs(words / (1.5 * sum(len(r["text"].split()) for r in docs.collect())) - 1) < 0.15
    odd = mixing.mixed(documents(spark))
    assert odd.columns == documents(spark).columns and odd.count() > 0


# ---- chat -------------------------------------------------------------------

CHATS = [
    (1, 0, "system", "be <|im_end|> brief \\ [INST]"), (1, 1, "user", "hi <\\s> <s> </s>"), (1, 2, "assistant", "<<SYS>> ok \\\\"),
    (1, 3, "user", "x" * 3000), (1, 4, "assistant", "y" * 900), (1, 5, "tool", "<|im_sep|>"), (1, 6, "assistant", ""),
    *[(1, 7 + i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 17)) for i in range(60)],
    (2, 1, "assistant", "b"), (2, 0, "user", None), (2, None, "user", "last"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"),
    (None, 0, None, "no conversation"), (3, 0, "assistant", "only \U0001d518 é"), (4, 5, "system", "alone"),
]
BUDGET = chat.Budget(tokens=200, history=60, least=40)


def chats(spark, rows=CHATS):
    extra = [(*r, "clash", 7) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, window string, tokens int")


def test_escaping_is_reversible_and_breaks_control_strings(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "<", "[", "\\", "|", ">", "s", "/", "INST]", "é", "\n", "SYS>>", "im_end"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for row in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert row["u"] == row["t"]
        assert not any(c in row["e"] for c in chat.CONTROL)


def test_windows_hold_each_turn_once_as_new(spark):
    out = chat.windows(chats(spark), BUDGET)
    turns, targets = {}, {}
    rows = sorted(chat.read_back(out).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["window"]))
    for r in rows:
        turns.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        targets.setdefault(r["conv_id"], []).extend(r["targets"])
    for conv_id in {c[0] for c in CHATS}:
        own = [c for c in CHATS if c[0] == conv_id]
        want = [(r or "", t or "") for _, _, r, t in sorted(own, key=lambda c: (c[1] is None, c[1] or 0))]
        if conv_id == 2:
            # rows of one turn stand in the order of a hash
            assert turns[2][0] == ("user", "") and turns[2][-1] == ("user", "last") and sorted(turns[2]) == sorted(want)
        else:
            assert turns[conv_id] == want
        assert targets[conv_id] == [t for r, t in turns[conv_id] if r == "assistant"]


def test_windows_keep_to_the_budget(spark):
    system = chat.rendered(F.lit("system"), F.lit(CHATS[0][3]))
    lead = spark.range(1).select(system).first()[0]
    for r in chat.windows(chats(spark), BUDGET).where("conv_id = 1").collect():
        parts = r["formatted"].split(chat.END)[:-1]
        cost = [-(-len((p + chat.END).encode()) // 4) for p in parts]
        assert r["formatted"].startswith(lead)
        new = cost[r["repeated"] :]
        assert new and (sum(cost) <= BUDGET.tokens or len(new) == 1)
        if r["window"] > 0:
            # the system turn and history within its budget
            assert r["repeated"] >= 1 and sum(cost[1 : r["repeated"]]) <= BUDGET.history


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    from tarnwheel.operators import ordered

    whole = collected(chat.digests(chat.windows(chats(spark), BUDGET)), "*")
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 10)
    assert collected(chat.digests(chat.windows(chats(spark), BUDGET)), "*") == whole
    assert chat.digests(chat.windows(chats(spark, []), BUDGET)).count() == 0


# ---- search -----------------------------------------------------------------


def brute_top(rows, k, asked):
    vectors = []
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((vec_id, [math.floor(64 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in vectors if asked(i)}):
        own = min((v for i, v in vectors if i == q), key=lambda v: (len(v), v))
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in vectors if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(-20, 120)]
    rows += [(200, None), (220, [None, 1.0, 2.0]), (240, [float("nan"), 1.0, 1.0]), (260, [float("inf"), 0.0, 0.0]), (280, []),
             (300, [1.0, 2.0]), (301, [2.0, -1.0]), (7, rows[5][1]), (7, rows[5][1]), (20, rows[3][1]), (None, [1.0, 1.0, 1.0]),
             (320, [1e5, 2e7, 3.0]), (321, [-1e5, 2e7, 9.0])]
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    found = topk_search.top_k(table, F.col("vec_id") % 20 == 0, k=5)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 5, lambda i: i % 20 == 0)
    assert topk_search.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def search_tables(data, n_queries, pivots=32):
    """A block of candidates and queries as they meet in a task."""
    whole = np.floor(64 * data)
    far = np.sqrt(((whole[:, None] - whole[None, :pivots]) ** 2).sum(axis=2))
    columns = {"vec_id": np.arange(len(data)), "dim": np.full(len(data), data.shape[1], np.int32)}
    table = pa.table(columns | {"v": pa.array(list(whole)), "far": pa.array(list(far))})
    beat = pa.array([None, -(10**9)] * (n_queries // 2), pa.float64())
    return whole, table, table.slice(0, n_queries).append_column("beat", beat)


@pytest.mark.parametrize("kind", ["clusters", "spread", "ties"])
def test_slices_in_bound_order(kind):
    """Over a thousand vectors: apart from each other nearly all are looked at, in groups few, and the result is exact."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(1500, 16)) * 0.2
    if kind == "clusters":
        data = 0.02 * data + rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] * 3
    if kind == "ties":
        data = np.round(data * 3) / 3
    whole, candidates, queries = search_tables(data, 300)
    tally = [0, 0]
    found = list(topk_search._evaluate(queries, candidates, 20, tally))
    scores = (whole[:300] @ whole.T).astype(np.int64)
    assert len(found) == 300 and tally[1] == 300 * 1500
    for (own, ids, got), q in zip(found, range(300)):
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        assert set(own) == {q} and ids.tolist() == order and got.tolist() == scores[q, order].tolist()
    share = tally[0] / tally[1]
    assert share < 0.3 if kind == "clusters" else share > 0.3


def test_a_score_to_beat_stops_a_block():
    rng = np.random.default_rng(8)
    whole, candidates, queries = search_tables(rng.normal(size=(1200, 16)), 10)
    best = np.sort((whole[:10] @ whole.T) - 10**9 * np.eye(10, 1200), axis=1)[:, -3]
    queries = queries.set_column(queries.schema.get_field_index("beat"), "beat", pa.array(best))
    found = list(topk_search._evaluate(queries, candidates, 20))
    # all that reach the score to beat, and no others
    assert [len(ids) for _, ids, _ in found] == [3] * 10
    assert all((scores >= b).all() for (_, _, scores), b in zip(found, best))


def test_a_block_is_multiplied_a_few_times_only(monkeypatch):
    """Where pivots leave out next to nothing, slices must not repeat the work of a tile over and over."""
    rng = np.random.default_rng(12)
    data = rng.normal(size=(6000, 64))
    whole, candidates, queries = search_tables(data / np.sqrt((data**2).sum(axis=1))[:, None], 256)
    scores, made = topk_search._scores, []

    def counted(q, c):
        made.append(len(q) * len(c))
        return scores(q, c)

    monkeypatch.setattr(topk_search, "_scores", counted)
    tally = [0, 0]
    found = list(topk_search._evaluate(queries, candidates, 20, tally))
    exact = (whole[:256] @ whole.T).astype(np.int64)
    np.fill_diagonal(exact, -(2**62))
    for (_, ids, got), row in zip(found, exact, strict=True):
        order = np.lexsort((np.arange(6000), -row))[:20]
        assert ids.tolist() == order.tolist() and got.tolist() == row[order].tolist()
    assert tally[0] > 0.8 * tally[1] and sum(made) <= 4 * tally[1]


@pytest.mark.parametrize("scale", [1, 3e4, 2e8])
def test_bounds_hold_in_single_precision(scale):
    """Also where distances to a far pivot lose more than whole units, and for equal vectors."""
    rng = np.random.default_rng(6)
    whole = np.floor(rng.normal(size=(500, 8)) * 64)
    whole[::7] = np.floor(whole[::7] * scale)
    whole[250:260] = whole[0]
    far = np.sqrt(((whole[:, None] - whole[None, :32]) ** 2).sum(axis=2))
    bounds = topk_search._bounds(whole[:100], far[:100], (whole**2).sum(axis=1), far.T)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in whole] for x in whole[:100]]
    assert all(bound >= score for row, scores in zip(bounds.tolist(), exact) for bound, score in zip(row, scores))


# ---- scoring ----------------------------------------------------------------


def brute_lm(rows, good):
    docs = [(d, (t or "").encode().lower().split(), d in good) for d, t, *_ in rows]
    ids = {w: i for i, w in enumerate({w for _, words, _ in docs for w in words})}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for _, words, chosen in docs:
        line = ["<", *words, ">"]
        for m in [0, 1] if chosen else [0]:
            uni[m].update(line)
            bi[m].update(zip(line, line[1:]))
    out, predicted = [], [sum(v for w, v in uni[m].items() if w != "<") for m in (0, 1)]
    for d, words, _ in docs:
        line, sums = ["<", *words, ">"], [0.0, 0.0]
        for a, b in zip(line, line[1:]):
            for m in (0, 1):
                prior = (uni[m][b] + 1) / (predicted[m] + len(ids) + 2)
                sums[m] -= math.log((bi[m][a, b] + lm_scoring.PRIOR * prior) / (uni[m][a] + lm_scoring.PRIOR))
        each = len(words) + 1
        out.append((d, len(words), sums[1] / each, sums[0] / each))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"step_tokens": 20, "bucket_keys": 500}, {"step_tokens": 1, "bucket_keys": 10**4}])
def test_lm_scores(spark, sizes):
    rows = [r for r in ROWS if r[0] != 12] + [(13, "The Cat sat! on two mats", None, None)]
    target = spark.createDataFrame([(1,), (10,), (10,), (None,), (999,)], "doc_id long")
    found = lm_scoring.lm_scores(documents(spark, rows), target, **sizes)
    got = collected(found, "doc_id", "n_tokens", "target_loss", "background_loss", "score")
    want = brute_lm(rows, {1, 10})
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], abs=1e-7) and g[4] == pytest.approx(w[2] - w[3], abs=1e-7)


def test_lm_scores_without_rows_or_target(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.lm_scores(documents(spark, []), none).count() == 0
    assert lm_scoring.lm_scores(documents(spark), none).count() == len(ROWS)


def test_every_word_is_in_the_vocabulary(spark):
    """More words than 16 bits can number are all told apart."""
    rows = [(i, " ".join(f"w{n}" for n in range(1000 * i, 1000 * i + 1000)), "en", "a") for i in range(70)] + [(99, "w5 w69005", "en", "a")]
    target = spark.createDataFrame([(0,)], "doc_id long")
    found = {r["doc_id"]: r for r in lm_scoring.lm_scores(documents(spark, rows), target, step_tokens=5000).collect()}
    want = {r[0]: r for r in brute_lm(rows, {0})}
    for doc_id, row in found.items():
        assert (row["target_loss"], row["background_loss"]) == pytest.approx(want[doc_id][2:], abs=1e-7)


def test_numbers_by_byte_planes():
    for dtype in (np.uint32, np.int64, np.uint64):
        for values in ([], [0], [1, 2**31, 7] * 1000):
            array = np.array(values, dtype)
            assert (lm_scoring.unpacked(lm_scoring.packed(array), dtype, len(array)) == array).all()


def brute_ratio(rows, good):
    hashes = importance._Hashes()
    found = [(d, importance.features((t or "").encode(), hashes)) for d, t, *_ in rows]
    counts = np.ones((2, importance.FEATURES))
    for d, f in found:
        for m in [0, 1] if d in good else [0]:
            np.add.at(counts[m], f, 1)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return sorted(((d, len(f), float((logs[1] - logs[0])[f].mean()) if len(f) else 0.0) for d, f in found), key=repr)


def test_importance(spark):
    target = spark.createDataFrame([(1,), (6,), (None,)], "doc_id long")
    found = importance.importance(documents(spark), target, keep=0.4)
    got = collected(found, "doc_id", "n_features", "log_ratio")
    for g, w in zip(got, brute_ratio(ROWS, {1, 6})):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9)
    rows = sorted(found.collect(), key=lambda r: (-r["key"], r["doc_id"] is None, r["doc_id"]))
    assert [r["selected"] for r in rows] == [i < round(0.4 * len(ROWS)) for i in range(len(ROWS))]
    again = importance.importance(documents(spark).repartition(3), target, keep=0.4)
    assert collected(found, "doc_id", "key", "selected") == collected(again, "doc_id", "key", "selected")
    assert importance.importance(documents(spark, []), target).count() == 0


def test_noise_samples_by_weight(spark):
    """Of documents with two weights, those e times as likely are selected about as often as that says."""
    docs = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(4000)], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(4000) if i % 8 in (1, 3, 5, 0)], "doc_id long")
    found = importance.importance(docs, target, keep=0.05).collect()
    weight = {r["doc_id"] % 2: r["log_weight"] for r in found}
    share = np.mean([r["doc_id"] % 2 for r in found if r["selected"]])
    odds = math.exp(min(30, weight[1] - weight[0]))
    assert share > 0.9 if odds > 20 else abs(share - odds / (1 + odds)) < 0.1
