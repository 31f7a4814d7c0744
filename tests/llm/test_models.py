"""Hidden Markov scores and toxicity."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from symdex.llm import hidden_markov as hm
from symdex.llm import toxicity
from symdex.llm.registry import QUERIES


def small_model(rng, states=3):
    emissions = np.zeros((hm.SYMBOLS, states))
    emissions[:5] = rng.random((5, states))
    moves = rng.random((states, states))
    start = rng.random(states)
    return hm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def all_paths(model, seq):
    """(probability, path) of every path of states."""
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emissions[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.moves[a, b] * model.emissions[s, b]
        yield p, path


def test_forward_recursion_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 7, 2, 7, 1)]
    got = model.log10_likelihood(seqs)
    wanted = [math.log10(sum(p for p, _ in all_paths(model, s))) for s in seqs]
    assert got == pytest.approx(wanted, rel=1e-12)


def test_a_long_text_does_not_underflow():
    model = small_model(np.random.default_rng(2))
    seq = np.random.default_rng(3).integers(0, 5, 50_000).astype(np.uint16)
    whole = model.log10_likelihood([seq, seq[:10]])
    a, log = model.start * model.emissions[seq[0]], 0.0
    for s in seq[1:]:
        a = (a @ model.moves) * model.emissions[s]
        log, a = log + math.log10(a.sum()), a / a.sum()
    assert whole[0] == pytest.approx(log, rel=1e-9)


def test_expected_counts_are_those_over_all_paths():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    seqs = [rng.integers(0, 5, n) for n in (5, 1, 6)]
    ones = np.ones((3, 3))
    start, moves, emissions, _ = hm.expected(model, hm.Block.of(seqs), ones * model.start, ones)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((hm.SYMBOLS, 3))
    for seq in seqs:
        total = sum(p for p, _ in all_paths(model, seq))
        for p, path in all_paths(model, seq):
            w = p / total
            s2[path[0]] += w
            for a, b in zip(path, path[1:], strict=False):
                m2[a, b] += w
            for s, k in zip(seq, path, strict=True):
                e2[s, k] += w
    assert np.allclose(start, s2) and np.allclose(moves, m2) and np.allclose(emissions, e2)


def test_a_long_document_is_counted_in_pieces_as_it_is_whole():
    rng = np.random.default_rng(6)
    model = small_model(rng)
    seq = rng.integers(0, 5, 57)
    ones = np.ones((1, 3))
    whole = hm.expected(model, hm.Block.of([seq]), ones * model.start, ones)
    for piece in (1, 2, 9, 56):
        assert all(np.allclose(a, b) for a, b in zip(hm.expected_of_long(model, seq, piece), whole, strict=False))


def plain_round(model, seqs):
    """One round of Baum-Welch, sequence by sequence and token by token."""
    start, moves, emissions = np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emissions)
    for seq in seqs:
        alpha = [model.start * model.emissions[seq[0]]]
        for x in seq[1:]:
            alpha.append(alpha[-1] @ model.moves * model.emissions[x])
            alpha[-1] /= alpha[-1].sum()
        beta = np.ones_like(model.start)
        for t in range(len(seq) - 1, -1, -1):
            gamma = alpha[t] * beta
            emissions[seq[t]] += gamma / gamma.sum()
            if t:
                told = model.emissions[seq[t]] * beta
                pair = alpha[t - 1][:, None] * model.moves * told
                moves += pair / pair.sum()
                beta = model.moves @ told
                beta /= beta.sum()
            else:
                start += gamma / gamma.sum()
    return hm.estimate(start, moves, emissions, model.emissions.sum(axis=1) > 0)


def test_scores_against_brute_force(spark, monkeypatch):
    """The whole query, with so few symbols that most tokens are known by their class."""
    for name, value in (("VOCAB", 6), ("CLASSES", 5), ("END", 11), ("SYMBOLS", 12), ("SLICE", 4), ("PIECE", 40), ("BLOCK_TOKENS", 90)):
        monkeypatch.setattr(hm, name, value)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc1", k=rng.choice([1, 2, 2, 10])))
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 7, 30, 100])))) for i in range(60)] + [(70, None)]
    got = {r["doc_id"]: r for r in hm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    texts = {i: (t or "").encode().lower().split() for i, t in docs}
    count = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    ends = sum(not x for x in held.values())
    of = {w: int(h) for w, h in zip(count, hm.signed(hm.split_words([w.decode() for w in count]).hashes), strict=True)}
    top = sorted(count, key=lambda w: (-count[w], of[w]))[:6]
    top.sort(key=lambda w: of[w] % 2**64)
    kind = lambda w: (w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 7 + (len(w) > 8) * 3 + any(48 <= c <= 57 for c in w) * 5) % 5
    in_class, words_of = collections.Counter(), collections.Counter()
    for w in set(count) - set(top):
        in_class[kind(w)] += count[w]
        words_of[kind(w)] += 1
    symbol = lambda w: top.index(w) if w in top else 6 + kind(w)
    seqs = {i: [*map(symbol, t), 11] for i, t in texts.items()}
    counts = hm.Counts(np.array([0] * 6, np.uint64), np.array([count[w] for w in top]), np.array([in_class[k] for k in range(5)]), np.array([words_of[k] for k in range(5)]), ends)
    model = hm.first_model(counts)
    for _ in range(2):
        model = plain_round(model, [s for i, s in seqs.items() if not held[i]])
    for i, seq in seqs.items():
        a = model.start * model.emissions[seq[0]]
        for x in seq[1:]:
            a = a @ model.moves * model.emissions[x]
        log = math.log10(a.sum()) if a.sum() else None
        rare = sum(math.log10((count[w] + 0.5) / (in_class[kind(w)] + 0.5 * (words_of[kind(w)] + 1))) for w in texts[i] if w not in top)
        assert got[i]["n_tokens"] == len(seq) and got[i]["held_out"] == held[i] and got[i]["score"] == pytest.approx(log + rare, rel=1e-6)


def test_rounds_of_training_raise_the_likelihood(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, more = (hm.lm_scores(df, n).where("not held_out").groupBy().sum("score").first()[0] for n in (1, 4))
    base = hm.lm_scores(df, 1).where("not held_out").groupBy().sum("base_score").first()[0]
    assert base < few < more


def test_scores_of_odd_texts(spark, odd):
    rows = QUERIES["op8_hidden_markov_scores"](spark, odd).collect()
    assert len(rows) == 14 and all(math.isfinite(r["score"]) and r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    n = {r["train_tokens"] for r in rows}
    assert len(n) == 1


def toxic_rows(n, seed):
    rng = random.Random(seed)
    mild, foul = ["river", "stone", "cloud", "garden", "letter", "window", "music"], ["grumblefoot", "snarlwit", "mudgobbler"]
    rows = []
    for i in range(n):
        words, bad = rng.choices(mild, k=rng.randint(3, 60)), rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(foul))
        rows.append((i, " ".join(words) if i % 2 else " ".join(words).upper(), bad))
    return rows


def test_held_out_accuracy(spark, folder):
    rows = toxic_rows(900, 7)
    path = folder(documents=[(i, t) for i, t, _ in rows] + [(None, "snarlwit"), (5000, None), (5001, "")], labels=[(i, 1, int(bad)) for i, _, bad in rows if i % 3] + [(1, 0, 1), (1, 0, 0), (None, 1, 1), (2, None, None)])
    got = QUERIES["op9_toxicity"](spark, path).collect()
    truth = {i: bad for i, _, bad in rows}
    assert len(got) == len(rows) + 3
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97
    again = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, path).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in got})


def test_ngrams_do_not_span_texts_and_scores_are_of_whole_texts():
    a = toxicity.present(["abcdef", None, "abcdef", ""])
    of = [set(a[1][a[0] == i].tolist()) for i in range(4)]
    assert of[0] == of[2] == set(toxicity.present(["abcdef"])[1].tolist()) and of[1] == of[3] < of[0]  # blanks alone
    weights = np.zeros(1 << toxicity.BITS)
    weights[toxicity.present(["snarl"])[1]] = 1.0
    model = toxicity.Model(weights, -5.0)
    far = model.scores(["word " * 30_000 + "SNARL", "word " * 30_000])
    assert far[0] > 0.5 > far[1]


def test_features_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab c,D", k=n)) for n in (900, 0, 37, 2000)]
    whole = toxicity.present(texts)
    for piece in (10, 64, 997):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.present(texts), whole, strict=True))


def test_long_labelled_rows_teach(spark, folder):
    """All toxic rows of the sample are long."""
    rng = random.Random(6)
    known = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    plain = lambda n: " ".join(rng.choices(known, k=n))
    docs = [(i, plain(12_000) + " vile snarl vile" if i % 10 == 0 else plain(rng.randint(3, 400)), "en", "s", 0) for i in range(300)]
    path = folder(documents=docs, labels=[(i, 1, int(i % 10 == 0)) for i in range(300)])
    assert all(len(t) > 50_000 for i, t, *_ in docs if i % 10 == 0)
    got = {r["doc_id"]: r["predicted"] for r in QUERIES["op9_toxicity"](spark, path).collect()}
    assert got == {i: int(i % 10 == 0) for i in range(300)}


def test_without_both_labels(spark, folder):
    path = folder(documents=[(i, f"text {i}") for i in range(9)], labels=[(i, 1, 0) for i in range(9)])
    assert all(r["score"] < 0.01 for r in QUERIES["op9_toxicity"](spark, path).collect())


def test_the_stage_keeps_clean_documents(spark, folder):
    rows = toxic_rows(600, 9)
    path = folder(documents=[(i, t, "en", "s", len(t)) for i, t, _ in rows], labels=[(i, 1, int(bad)) for i, _, bad in rows])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = toxicity.stage(spark, docs, path)
    assert kept.columns == docs.columns
    ids, truth = {r["doc_id"] for r in kept.select("doc_id").collect()}, {i: bad for i, _, bad in rows}
    assert sum(not truth[i] for i in ids) / sum(not b for b in truth.values()) > 0.98 and sum(truth[i] for i in ids) / sum(truth.values()) < 0.05
