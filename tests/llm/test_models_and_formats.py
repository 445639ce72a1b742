"""Sharding, chat formatting, and the models trained here."""

from __future__ import annotations

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import chat, language_id, lm_scoring, quality_model, sharding
from ledgerloom.llm import words as W


# sharding

def check_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        assert r.grown_shard in (r.shard, sharding.SHARDS)
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def winner(key, weights):
    """The shard of a key by a plain loop over all shards."""
    def score(shard):
        h = xxhash.xxh64_intdigest(sharding.SEED.encode(), 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), h) >> 11
        return -math.log((bits + 0.5) / 2**53) / weights[shard]
    return min(range(len(weights)), key=score)


@pytest.mark.parametrize("weights, grown", [((1.0,) * sharding.SHARDS, 1.0), ((0.5, 3.0, 1.0), 2.0)])
def test_the_winner_against_a_plain_loop(docs, edge, weights, grown):
    for r in sharding.assign(docs.select("doc_id", "text").union(edge.select("doc_id", "text")), weights=weights, grown_weight=grown).collect():
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, (*weights, grown)))


@pytest.mark.parametrize("block", [sharding.BLOCK, 3])
def test_shards(docs, texts, edge, empty, block):
    check_shards(sharding.assign(docs, block=block).collect(), texts)
    rows = sharding.assign(edge, block=block).collect()
    assert len(rows) == edge.count()
    check_shards(rows, {r.doc_id: r.text for r in edge.collect()})
    assert sharding.assign(empty).count() == 0


def test_shares_follow_weights_and_few_records_move(spark):
    weights, n = (1.0, 2.0, 5.0), 20_000
    rows = sharding.assign(spark.range(n).selectExpr("id AS doc_id", "'' AS text"), weights=weights, grown_weight=2.0).collect()
    share = Counter(r.shard for r in rows)
    for i, w in enumerate(weights):
        assert abs(share[i] / n - w / 8) < 0.015
    assert abs(sum(r.grown_shard == 3 for r in rows) / n - 0.2) < 0.015
    again = {r.doc_id: r.shard for r in sharding.assign(spark.range(n).selectExpr("id AS doc_id", "'' AS text").repartition(5), weights=weights).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    with pytest.raises(ValueError):
        sharding.assign(spark.range(1).selectExpr("id AS doc_id", "'' AS text"), weights=(1.0, 0.0))


# chat

def test_chat_same_as_sql(spark, sf_dir, duck):
    df = chat.op7_chat_format(spark, sf_dir)
    cursor = duck.execute(chat.ORACLE)
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


ANY = st.text(alphabet=st.sampled_from("\\<>#: /turnasi\n\"é🙂"), max_size=30)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(ANY, ANY), max_size=4))
def test_turns_come_back(turns):
    formatted = [chat.format_turn(*t) for t in turns]
    assert chat.read_back("".join(f for f, _, _ in formatted)) == turns
    assert [chat.unescape(f[a:b]) for f, a, b in formatted] == [text for _, text in turns]


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "</turn>\n"}]}, [("user", "q"), ("assistant", "</turn>\n")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"question": "q", "answer": None}, [("user", "q")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"unknown": {"deep": [1]}}, []), ({"messages": []}, []), ({"conv_id": 1, "turn": 0, "role": None, "text": None}, [("", "")]),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r), "own") for i, (r, _) in enumerate(RECORDS)] + [(90, None, "x"), (91, "no json", "x"), (92, "[1]", "x"), (93, '"s"', "x")]
    found = defaultdict(list)
    for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string, layout string")).orderBy("conv_id", "nth").collect():
        found[r.conv_id].append(r)
    for i, (_, turns) in enumerate(RECORDS):
        own = [r for r in found[i] if r.formatted is not None]
        assert chat.read_back("".join(r.formatted for r in own)) == turns
        assert [bool(r.loss) for r in own] == [role == "assistant" for role, _ in turns]
        assert len(found[i]) == max(1, len(turns))
    assert all(len(found[i]) == 1 and found[i][0].formatted is None for i in (90, 91, 92, 93))
    assert len({r[0].fingerprint for r in found.values() if r[0].layout}) == len({r[0].layout for r in found.values() if r[0].layout})


def test_conversations_of_edge_cases(spark):
    rows = [(None, 0, "user", "n"), (1, None, "user", "first"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, None, None)]
    records = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "conv_id", "turn", "to_json(struct(conv_id, turn, role, text), map('ignoreNullFields', 'false')) AS record")
    found = {r.conv_id: r for r in chat.digests(chat.format_records(records)).collect()}
    expected = "user\nfirst\nassistant\na\nassistant\na\nassistant\nb\n"
    assert found[1].n_turns == 4 and found[1].turns_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    assert found[1].loss_chars == 3 and found[1].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert found[2].n_turns == 1 and found[None].n_turns == 1
    assert chat.digests(chat.format_records(records.limit(0))).count() == 0


TOLERANT = [
    # record, layout, turns, paths left aside
    ({"messages": []}, "no messages", [], []),
    ({"conversations": None, "id": 5}, "no shared turns", [], ["id"]),
    ({"messages": [{"role": "user", "content": "q", "name": "Ann"}], "id": 3, "meta": {"a": [1]}}, "messages", [("user", "q")], ["id", "messages[].name", "meta", "meta.a", "meta.a[]"]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a<"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]},
     "messages in parts", [("user", "a<b"), ("assistant", "c")], []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}]}]}, None, [], []),
    ([{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "bare messages", [("user", "q"), ("assistant", "")], []),
    ([{"from": "human", "value": "q", "weight": 0}], "bare shared turns", [("user", "q")], ["[].weight"]),
    ([], None, [], []), ({}, None, [], []), ([1], None, [], []), ({"messages": "text"}, None, [], []), ({"messages": {"role": "user"}}, None, [], []),
    ({"prompt": "p", "response": "r", "id": 1}, "response", [("user", "p"), ("assistant", "r")], ["id"]),
    ({"prompt": "p", "response": "r", "output": "o"}, None, [], []),
]


def test_layouts_with_more_or_fewer_fields(spark):
    rows = [(i, json.dumps(r), "own", "mine") for i, (r, *_) in enumerate(TOLERANT)]
    turns = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string, first string, last string")).withColumn("turn", F.lit(0)).cache()
    found = defaultdict(list)
    for r in turns.orderBy("conv_id", "nth").collect():
        assert (r["first"], r["last"]) == ("own", "mine")
        found[r.conv_id].append(r)
    for i, (_, layout, expected, ignored) in enumerate(TOLERANT):
        assert {r.layout for r in found[i]} == {layout} and all(r.ignored == ignored for r in found[i])
        assert chat.read_back("".join(r.formatted or "" for r in found[i])) == expected
    for r in chat.digests(turns).collect():
        _, layout, expected, ignored = TOLERANT[r.conv_id]
        assert (r.n_turns, r.n_unknown, r.n_ignoring) == (len(expected), layout is None, bool(ignored))
    turns.unpersist()


def test_the_query_meets_several_layouts(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(chat, "digests", lambda turns: seen.setdefault("turns", turns).withColumn("n_ignoring", F.lit(0)))
    chat.op7_chat_format(spark, sf_dir)
    layouts = {r.layout: r.n for r in seen["turns"].groupBy("layout").agg(F.count("*").alias("n")).collect()}
    assert set(layouts) == {"turn row", "messages", "shared turns", "messages in parts", "bare messages"}


# language identification

def slopes(weights, loss, grads, rng, pick=None, step=1e-4):
    """The largest difference between the given gradients and numeric ones."""
    worst = 0.0
    for name, w in weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w.shape)
            at = pick(name, at) if pick else at
            old = w[at]
            w[at] = old + step
            above = loss()
            w[at] = old - step
            below = loss()
            w[at] = old
            worst = max(worst, abs((above - below) / (2 * step) - grads[name][at]))
    return worst


def test_gradients_through_time():
    rng = np.random.default_rng(3)
    net = language_id.Network(["a", "b", "c"], 4)
    for group in (net.forward.w, net.backward.w, net.head):
        for name in group:
            group[name] = group[name].astype(np.float64) + rng.normal(0, 0.3, group[name].shape)
    net.forward.closed(), net.backward.closed()
    x, y = rng.integers(97, 102, (5, 7)), np.array([0, 1, 2, 1, 0])
    x[3, 5:] = language_id.PAD

    def loss():
        total = count = 0
        for at, _, _, p in net.positions(np.ascontiguousarray(x.T)):
            real = x[:, at] != language_id.PAD
            total -= np.log(p[np.arange(5), y])[real].sum()
            count += real.sum()
        return total / count

    for group, grads in zip((net.forward.w, net.backward.w, net.head), net._gradients(x.T, y)):
        assert slopes(group, loss, grads, rng, lambda n, at: (int(rng.integers(97, 102)), at[1]) if n[0] == "t" else at) < 1e-6


def test_padding_changes_nothing():
    net = language_id.Network(["a", "b"])
    net.head["f"][:] = net.head["b"][:] = np.random.default_rng(0).normal(size=net.head["f"].shape)
    short = np.array([[104, 101, 108]])
    padded = np.concatenate([short, np.full((1, 5), language_id.PAD)], axis=1)
    one = {at: p for at, _, _, p in net.positions(short.T)}
    two = {at: p for at, _, _, p in net.positions(padded.T)}
    assert all(np.allclose(one[at], two[at], atol=1e-6) for at in one)


def test_languages(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op10_language_id(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    net = language_id.learn(edge.selectExpr("doc_id AS id", "text AS t", "lang"))
    found = language_id.predict(edge, net).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert [by_id[i] for i in (1, 2, 3, 10)] == ["und"] * 4 and by_id[9] != "und"
    nothing = empty.selectExpr("doc_id AS id", "text AS t", "lang")
    assert language_id.learn(nothing) is None and language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}


# language-model scoring

def test_gradients_of_attention():
    rng = np.random.default_rng(3)
    m = lm_scoring.Attention.fresh()
    m.w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in m.w.items()}
    pad = len(m.w["embed"]) - 1
    x, y = rng.integers(0, 40, (3, 32)), rng.integers(0, lm_scoring.LEAVES, (3, 16))
    x[0, :20], x[2, 28:], y[0, :4], y[2, 12:] = pad, pad, -1, -1

    def loss():
        hidden, leaf = m.forward(x, m.tables())[-1], y.ravel()
        real = np.flatnonzero(leaf >= 0)
        hidden, leaf = hidden[real], leaf[real]
        out = lm_scoring._log_softmax_at(hidden @ m.w["group"] + m.w["group_prior"], leaf // lm_scoring.GROUPS)
        for _, rows, logits in m.leaf_logits(hidden, leaf):
            out[rows] += lm_scoring._log_softmax_at(logits, leaf[rows] % lm_scoring.GROUPS)
        return -out.mean()

    assert slopes(m.w, loss, m.gradients(x, y), rng, lambda n, at: (int(rng.integers(0, 40)), at[1]) if n == "embed" else at) < 1e-5


def test_windows_score_each_token_once():
    vocabulary = lm_scoring.Vocabulary(np.ones(301), [f"t{i}" for i in range(300)], [])
    ids = [np.arange(n) % 300 for n in (0, 1, 15, 16, 17, 70)]
    owner, x, following = lm_scoring.windows(ids, vocabulary)
    for i, own in enumerate(ids):
        seen = following[owner == i]
        assert seen[seen >= 0].tolist() == [*own.tolist(), vocabulary.end]
        inputs = [vocabulary.begin, *vocabulary.leaf[own]]
        for row, window in enumerate(x[owner == i]):
            places = [row * 16 + k for k in range(-16, 16)]
            assert window.tolist() == [inputs[p] if 0 <= p < len(inputs) else vocabulary.pad for p in places]


def test_no_token_sees_what_follows_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    vocabulary = lm_scoring.Vocabulary(rng.random(2001), [f"t{i}" for i in range(2000)], [])
    m = lm_scoring.Attention.fresh()
    m.w["leaf"] += rng.normal(0, 1, m.w["leaf"].shape).astype(np.float32)
    one = rng.integers(0, 2000, 40)
    two = one.copy()
    two[25:] = 7
    a, b = (m.log_probabilities([x], vocabulary) for x in (one, two))
    assert np.allclose(a[:25], b[:25]) and not np.allclose(a[25:], b[25:])
    total = sum(math.exp(m.log_probabilities([np.append(one[:20], [i])], vocabulary)[20]) for i in range(2000))
    total += math.exp(m.log_probabilities([one[:20]], vocabulary)[20])
    assert abs(total - 1) < 0.02  # but for leaves without ids


def test_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in lm_scoring.op9_lm_scoring(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_base(rows, texts)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows.values())


def check_base(rows, texts):
    words = {i: [*brute.solid(brute.lower(t)), None] for i, t in texts.items()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, own in words.items() if not held[i] and i is not None for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)


def test_partitions_train_on_all_windows_of_all_documents(spark):
    texts = [" ".join(f"word{i * k % 97}" for i in range(n)) for k, n in enumerate((3000, 1, 0, 40, 200, 700))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    encode = lm_scoring.subwords.loaded(lm_scoring.TOKENIZER, " ")
    size = encode.tokenizer.get_vocab_size()
    ids = lm_scoring._ids(texts, encode)
    vocabulary = lm_scoring.Vocabulary(np.ones(size + 1), [encode.tokenizer.id_to_token(i) or "" for i in range(size)], ids)
    found = lm_scoring.continued(docs, lm_scoring.Attention.fresh(), vocabulary, lm_scoring.TOKENIZER)
    assert sum(found.column("n").to_pylist()) == sum(-(-(len(x) + 1) // lm_scoring.STRIDE) for x in ids)


def test_texts_are_encoded_once_for_counts_and_training(spark):
    texts = [None, "", " a\u2003b\tA  z", "\u00e9t\u00e9 \u4f60\u597d 12", " ".join(f"Word{i * i % 89}" for i in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    encode = lm_scoring.subwords.loaded(lm_scoring.TOKENIZER, " ")
    size, ids = encode.tokenizer.get_vocab_size(), lm_scoring._ids(texts, encode)
    kind = lm_scoring.number_type(lm_scoring.TOKENIZER)
    coded = lm_scoring.encoded(docs, lm_scoring.TOKENIZER)
    rows = coded.collect()
    assert [np.frombuffer(r.ids, kind).tolist() for r in rows] == [x.tolist() for x in ids]
    assert [r.size for r in rows] == [len((t or "").encode()) for t in texts]
    assert {r.id: r.n for r in lm_scoring.id_counts(coded, kind).collect()} == Counter(i for x in ids for i in x.tolist())
    vocabulary = lm_scoring.Vocabulary(np.ones(size + 1), [encode.tokenizer.id_to_token(i) or "" for i in range(size)], ids)
    found, same = (lm_scoring.continued(x, lm_scoring.Attention.fresh(), vocabulary, lm_scoring.TOKENIZER).to_pylist() for x in (docs, coded))
    assert found == same and found[0]["n"] == sum(-(-(len(x) + 1) // lm_scoring.STRIDE) for x in ids)


def test_training_begins_with_all_documents_whole(spark, monkeypatch):
    """More than a thousand documents, one of them long: each pass takes all windows, those of short partitions in one task,
    and leaves are ordered by all texts."""
    texts = [f"word{i % 37} word{i % 53} {'x' * (i % 5)}" for i in range(1500)] + [" ".join(f"word{i * i % 89}" for i in range(12_000))]
    assert len(texts[-1]) > 1 << 16
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = lm_scoring._ids([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], lm_scoring.subwords.loaded(lm_scoring.TOKENIZER, " "))
    passes, made = [], []
    continued, vocabulary = lm_scoring.continued, lm_scoring.Vocabulary

    def watched(coded, model, vocabulary, tokenizer, rate=lm_scoring.LOCAL_RATE, *more):
        found = continued(coded, model, vocabulary, tokenizer, rate, *more)
        passes.append((rate, found.column("n").to_pylist()))
        return found

    def noted(*args, **named):
        made.append((args, named))
        return vocabulary(*args, **named)

    monkeypatch.setattr(lm_scoring, "continued", watched)
    monkeypatch.setattr(lm_scoring, "Vocabulary", noted)
    lm_scoring.score(docs)
    whole = sum(-(-(len(x) + 1) // lm_scoring.STRIDE) for x in ids)
    assert passes == [(lm_scoring.RATE, [whole])] * lm_scoring.EPOCHS + [(lm_scoring.LOCAL_RATE, [whole])]
    (counts, tokens), named = made[0]
    leaf = lm_scoring.leaves_by_count(counts, tokens)
    pairs = Counter((int(a), int(b)) for x in ids for own in [leaf[[*x, len(tokens)]]] for a, b in zip(own[1:], own))
    follows = named["follows"].reshape(lm_scoring.LEAVES, lm_scoring.LEAVES)
    assert {(int(a), int(b)): int(follows[a, b]) for a, b in zip(*np.nonzero(follows))} == pairs
    assert (vocabulary(counts, tokens, ids).leaf == vocabulary(counts, tokens, **named).leaf).all()


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 3])
def test_scores_of_edge_cases(edge, empty, head):
    once = edge.dropDuplicates(["doc_id"])
    rows = lm_scoring.score(once, head=head).collect()
    check_base({r.doc_id: r for r in rows}, {r.doc_id: r.text for r in once.collect()})
    assert lm_scoring.score(edge, head=head).count() == edge.count()
    assert lm_scoring.score(empty).count() == 0
    alone = lm_scoring.score(edge.where("doc_id IS NULL")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)


# quality model

def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    known = labels.where("doc_id % 2 = 0")
    rows = [r for r in quality_model.classify(spark.read.parquet(f"{sf}/documents.parquet"), known).collect() if r.doc_id in truth and r.doc_id % 2]
    clean = [r.kept for r in rows if truth[r.doc_id].quality == 1 and truth[r.doc_id].toxic == 0]
    low = [r.kept for r in rows if truth[r.doc_id].quality == 0 and truth[r.doc_id].toxic == 0]
    assert np.mean(clean) > 0.98 and np.mean(low) < 0.1


def test_toxic_documents_with_held_out_labels(spark):
    """The cutoff was looked at with other labels than these (ids of remainder 1) held out."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    rows = [r for r in quality_model.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 3 != 2")).collect() if r.doc_id in truth and r.doc_id % 3 == 2]
    toxic = [r for r in rows if truth[r.doc_id].toxic == 1]
    fine = [r for r in toxic if truth[r.doc_id].quality == 1]
    clean = [r for r in rows if truth[r.doc_id].quality == 1 and truth[r.doc_id].toxic == 0]
    told = lambda rows: np.mean([r.p_toxic >= quality_model.MAX_TOXIC for r in rows])
    gone = lambda rows: np.mean([not r.kept for r in rows])
    print(len(toxic), told(toxic), gone(toxic), len(fine), told(fine), gone(fine), len(clean), told(clean), gone(clean))
    assert told(fine) > 0.6 and gone(toxic) > 0.6 and gone(clean) < 0.02


def test_a_toxic_document_goes_whatever_its_quality_score(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        for word in ("scum", "moron", "clown") if i % 10 == 0 else ():
            words[int(rng.integers(60))] = word
        rows.append((i, " ".join(words), "s", "en"))
        if i % 2 == 0 and i < 500:
            labels.append((i, 1, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in quality_model.classify(docs, labels, min_score=0.0).collect()}
    assert [i for i in range(500, 600) if not found[i]] == list(range(500, 600, 10))


def test_rates_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None]), rng.uniform(0.05, 0.95)) for i in range(300)]
    rows = [(*r, float(r[3] > 0.5) if r[0] % 3 == 0 else r[3]) for r in rows]
    found = {r.id: r for r in quality_model.combine(spark.createDataFrame(rows, "id long, host string, path string, p double, evidence double")).collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, _, e in rows:
        hosts[host].append(e)
        paths[host, path].append(e)
    mean = sum(sum(v) for v in hosts.values()) / len(rows)
    strength = lambda m, var: min(max(m * (1 - m) / var - 1, 1), 1e6) if var > 0 else 1e6
    k = strength(mean, np.var([np.mean(v) for v in hosts.values()]))
    shrunk = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k2 = strength(mean, np.mean([(np.mean(v) - shrunk[h]) ** 2 for (h, _), v in paths.items()]))
    odds = lambda x: math.log(x / (1 - x))
    for i, host, path, p, e in rows:
        host_rate = (k * mean + sum(hosts[host]) - e) / (k + len(hosts[host]) - 1)
        path_rate = (k2 * host_rate + sum(paths[host, path]) - e) / (k2 + len(paths[host, path]) - 1)
        assert math.isclose(found[i].path_rate, path_rate, rel_tol=1e-9)
        assert math.isclose(odds(found[i].score), odds(p) + odds(path_rate) - odds(mean), rel_tol=1e-6, abs_tol=1e-9)


def test_quality_of_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, None), (10, 0, 0), (12, 0, 1), (12, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_model.classify(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 < r.score < 1 for r in rows)
    assert quality_model.classify(empty, labels).count() == 0
    assert all(r.p == 0.5 for r in quality_model.classify(edge, labels.limit(0)).collect())


# words

@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="aB0é .\n🙂", max_size=12), max_size=5))
def test_words_and_hashes(texts):
    own = W.Texts.of(pa.array(texts, pa.large_string()))
    for table, words in ((W.SOLID, lambda t: brute.solid(t)), (W.ALNUM, lambda t: brute.alnum(t))):
        a, b, text = own.runs(table[own.data])
        found = [own.data[x:y].tobytes().decode() for x, y in zip(a, b)]
        assert [brute.lower(w) for w in found] == [brute.lower(w) for t in texts for w in words(t)]
        assert text.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
        hashes = own.hashes(a, b, W.LOWER)
        assert len(set(zip(hashes.tolist(), map(brute.lower, found)))) == len(set(hashes.tolist())) == len(set(map(brute.lower, found)))


def test_sample_has_its_number_of_rows_whatever_the_ids(spark):
    """Many rows that share an id, and a language with fewer rows than asked for."""
    rows = [(9, f"text {i}", "en") for i in range(3000)] + [(i, "same text", "de") for i in range(50)] + [(7, "équal", "fr")] * 400 + [(None, "x", "en"), (1, None, "en"), (2, "x", None), (3, "", "en")]
    df = spark.createDataFrame(rows, "id long, t string, lang string").repartition(4)
    found = language_id.sample(df, 100, 3).collect()
    assert sorted((lang, sum(r.lang == lang for r in found)) for lang in ("en", "de", "fr")) == [("de", 50), ("en", 100), ("fr", 1)]
    assert {r.lang for r in language_id.sample(df, 100, 1).collect()} == {"en"}
    assert sorted(map(tuple, found)) == sorted(map(tuple, language_id.sample(df.repartition(2), 100, 3).collect()))
