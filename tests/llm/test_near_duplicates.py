"""Near-duplicates of texts and vectors against all pairs, and the pipeline."""

import collections
import random

import numpy as np
import pytest
from symdex.llm import embedding_duplicates as ed
from symdex.llm import near_duplicates as nd
from symdex.llm.registry import QUERIES
from symdex.llm.shared import components, table


def closure(nodes, links):
    """The least node that each node reaches."""
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(300 - i, 301 - i) for i in range(150)] + [(7, 7), (5, 7), (7, 5)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == closure({n for e in real for n in e}, real)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted(seed):
    """Originals, exact and near copies at many similarities, chains, a large group of copies, and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(40):
        own = [word() for _ in range(rng.choice([4, 6, 12, 40, 200]))]
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 4)):
            copy = list(own)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    chain = [word() for _ in range(120)]
    for i in range(12):  # each is near its neighbours alone
        texts.append(" ".join(chain))
        chain = chain[2:] + [word() for _ in range(2)] if i % 2 else [word() for _ in range(2)] + chain[2:]
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(10)]
    texts += ["the very same text again and again"] * 30 + ["", None, " \n ", "one", "one", "two words"]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_against_all_pairs(spark, folder, seed):
    rows = planted(seed)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = closure(sets, links)
    got = QUERIES["op10_minhash_near_duplicates"](spark, folder(documents=rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in sets}


def test_repeated_rows_are_compared_once(spark):
    """Two near texts of 50 rows each are one pair; their sets are made once. A hot hub's members are dealt over parts."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"])}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items() for _ in range(50)], "doc_id long, text string").repartition(7)
    for _ in range(3):
        rows = nd.near_duplicates(docs, percent=85).collect()
        assert len(rows) == 100 and {r["component_id"] for r in rows} == {1} and sum(r["kept"] for r in rows) == 50
    own = {i: nd.fingerprints(nd.shingle_sets([t])[0])[0] for i, t in texts.items()}
    wanted = spark.createDataFrame(list(own.items()), "cid long, f1 long")
    assert nd.sets_of(docs.withColumnRenamed("doc_id", "cid"), wanted).count() == 2


def test_a_hub_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "STAR", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)] + [" ".join(w if k != i else "x" for k, w in enumerate(base)) for i in range(40)] + [" ".join(rng.choices(base, k=80)) for _ in range(9)]
    sets = nd.shingle_sets(texts)
    rows = [(i, nd.fingerprints(h)[0], h.tobytes()) for i, h in enumerate(sets)]
    frame = spark.createDataFrame([(i, f, bytearray(b)) for i, f, b in rows], "cid long, f1 long, shingles binary")
    pairs = spark.createDataFrame([(0, rows[0][1], i, f) for i, f, _ in rows[1:]], "u long, fu long, v long, fv long")
    got = {(r["a"], r["b"]) for r in nd.stars(pairs, frame, 85).collect()}
    assert got == {(0, i) for i in range(1, len(texts)) if nd.similar(sets[0], sets[i], 85)} and len(got) == 40


def test_words_are_told_apart_as_bytes():
    rng = random.Random(3)
    texts = ["", None, " \t", "One ONE one", "é É", "a" * 700_000 + " b", *(" ".join("".join(rng.choices("ab\x0bc", k=5)) for _ in range(50)) for _ in range(40))]
    w = nd.split_words(texts)
    seen = {}
    for i, t in enumerate(texts):
        plain = (t or "").encode().lower().split()
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
        assert len(own) == len(plain)
        for word, h in zip(plain, own, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_torn_bucket_is_joined():
    """Members that are not near a bucket's centre are compared with each other."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    other = np.sort(np.concatenate([base[:97], rng.integers(0, 2**63, 2, dtype=np.uint64)]))
    far = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    bands = np.array([[1, 2], [1, 3], [1, 2]])
    found = nd.connect([far, base, other], np.array([0, 1, 2]), bands, 1, np.zeros(3), False, 85)
    assert found == [(1, 2)]


def test_the_stage_keeps_one_of_each_group(spark, folder):
    rows = planted(3)
    docs = spark.read.parquet(folder(documents=[(i, t, "en", "s", 1) for i, t in rows] + [(None, "the very same text again and again")]) + "/documents.parquet")
    kept = nd.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    wanted = closure(sets, links)
    assert sorted(ids) == sorted(i for i in sets if wanted[i] == i)


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            v = rng.standard_normal(24)
            for spread in [0.0] + list(rng.choice([0.0, 0.05, 0.2, 0.35, 0.45], rng.integers(0, 4))):
                rows.append((n, (v / np.linalg.norm(v) + spread * rng.standard_normal(24) / 5).astype(np.float32).tolist(), label))
                n += 1
    centre = rng.standard_normal(24)
    for _ in range(150):  # one dense group: lists are saturated
        rows.append((n, (centre / np.linalg.norm(centre) + 0.02 * rng.standard_normal(24)).astype(np.float32).tolist(), 1))
        n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)] + [(n + 50, rows[0][1], 2)]
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 24, 0), (9004, [nan] + [1.0] * 23, 0), (9005, [inf] + [1.0] * 23, 0), (9006, [None] + [1.0] * 23, 0), (9007, rows[0][1], None), (9008, [1.0, 2.0], 0), (9009, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    return rows


def test_vectors_against_all_pairs(spark, folder, monkeypatch):
    rows = vectors(5)
    got = {r["vec_id"]: r for r in QUERIES["op7_embedding_near_duplicates"](spark, folder(embeddings=rows)).collect()}
    fine = {i: (l, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v, l in rows if v and l is not None and i is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][0] == fine[b][0] and len(fine[a][1]) == len(fine[b][1]) and float(fine[a][1] @ fine[b][1]) >= 0.93]
    wanted = closure({i for i, _, _ in rows if i is not None}, links)
    degree = collections.Counter(x for e in links for x in e)
    assert len(got) == len({r[0] for r in rows})
    for i, r in got.items():
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], wanted[i], wanted[i] == i), i
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)


def test_a_measured_link_between_two_dense_groups_counts(spark, folder):
    """Lists are full of nearer vectors, so the one link between the groups is in none of them."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    turned = lambda angle: np.cos(angle) * axes[0] + np.sin(angle) * axes[1]
    around = lambda angle: [turned(angle) + 0.01 * rng.standard_normal(24) for _ in range(50)]
    group = [*around(0), turned(0.1), turned(0.475), *around(0.575)]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(group)]
    x = ed.unit(np.array([r[1] for r in rows], np.float32))
    near = x @ x.T >= 0.93
    assert not near[:50, 52:].any() and near[50, 51] and near[:50, :51].all() and near[51:, 51:].all() and near[:51, 51:].sum() < 200
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op7_embedding_near_duplicates"](spark, folder(embeddings=rows)).collect()}
    assert got == {i: (int(near[i].sum()) - 1, 0) for i in range(len(rows))}


def test_rare_links_are_found_whatever_the_rounds_see(spark, folder, monkeypatch):
    """Pairs among many lone vectors, in one label, with rounds that compare next to nothing."""
    rng = np.random.default_rng(4)
    x = ed.unit(rng.standard_normal((400, 24)))
    x[200:260] = ed.unit(x[:60] + 0.06 * rng.standard_normal((60, 24)))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    x = ed.unit(np.array([r[1] for r in rows], np.float32))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    wanted = closure(range(400), np.argwhere(near).tolist())
    assert near.sum() > 60
    for name, value in (("RUN", 4), ("ORDERS", 1), ("ROUNDS", (1, 1)), ("AUDIT", 8), ("TILE", 8000), ("STRIP", 50)):
        monkeypatch.setattr(ed, name, value, raising=False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op7_embedding_near_duplicates"](spark, folder(embeddings=rows)).collect()}
    assert got == {i: (int(near[i].sum()), wanted[i]) for i in range(400)}


def test_the_rounds_find_rare_links_by_themselves(spark):
    """200 pairs among 8,000 vectors of one label: the audit grows until it sees them, and the rounds go on."""
    rng = np.random.default_rng(9)
    x = ed.unit(rng.standard_normal((8000, 32)))
    x[7800:] = ed.unit(x[:200] + 0.05 * rng.standard_normal((200, 32)))
    rows = [(i, v.astype(np.float32).tolist(), 0, 32) for i, v in enumerate(x)]
    nodes = ed.materialize(spark.createDataFrame(rows, "node long, vec array<float>, label int, dim int").repartition(4), "nodes")
    _, linked, size = ed.audited(nodes)
    assert linked >= ed.LINKED and size > ed.AUDIT
    joined, recall = ed.descend(nodes)
    of = {r["node"]: r["component"] for r in joined.collect()}
    near = ed.unit(np.array([r[1] for r in rows], np.float32))
    pairs = np.argwhere(np.triu(near @ near.T >= 0.93, 1)).tolist()
    met = sum(of.get(a, a) == of.get(b, b) for a, b in pairs) / len(pairs)
    assert len(pairs) > 150 and met >= 0.9 and recall >= 0.9


def test_links_of_a_component_are_counted_in_blocks(spark, monkeypatch):
    rows = [(0, i, 1 + i % 2, v) for i, (_, v, _) in enumerate(r for r in vectors(6) if r[2] == 1 and r[1] and len(r[1]) == 24 and None not in r[1] and np.isfinite(r[1]).all())][:120]
    df = spark.createDataFrame(rows, "component long, node long, members long, vec array<float>")
    x = ed.unit(np.array([r[3] for r in rows]))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    wanted = near @ np.array([r[2] for r in rows])
    for size in (1024, 16):
        monkeypatch.setattr(ed, "BLOCK", size)
        got = {r["node"]: r["links"] for r in ed.count_links(df).collect()}
        assert [got[i] for i in range(len(rows))] == wanted.tolist()


def test_the_pipeline(spark):
    """Each stage on its own input: columns stay, copies and clean documents are treated as the operators say."""
    import corpus_pipeline as p

    path = "/root/testdata/sf0.001"
    docs = table(spark, path, "documents").cache()
    out = p.run(spark, path)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(24) for i in range(sum(x["shard"] == s for x in rows))]
    kept = p.STAGES[2][1](spark, docs, path)
    bad = {r["doc_id"] for r in QUERIES["op2_benchmark_decontamination"](spark, path).where("contaminated").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    mixed = p.STAGES[3][1](spark, docs, path).collect()
    taken = collections.Counter()
    for r in mixed:
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(r["text"].encode().split())
    assert {i: n for i, n in taken.items() if n} == {r["doc_id"]: r["taken"] for r in QUERIES["op3_source_mixing"](spark, path).collect() if r["taken"]}


def test_the_pipeline_bears_odd_and_empty_tables(spark, odd, nothing):
    import corpus_pipeline as p

    assert p.run(spark, nothing).count() == 0
    assert p.run(spark, odd).count() > 0
