"""Sharding, mixing, decontamination, licences and personal data against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from symdex.llm import decontamination, licenses, mixing, privacy, sharding
from symdex.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


# ---- sharding -------------------------------------------------------------------------------


def test_one_more_shard_takes_rows_only_into_itself(spark, odd):
    for path in (SF, odd):
        rows = QUERIES["op1_rendezvous_sharding"](spark, path).collect()
        assert all(r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        shard_of = collections.defaultdict(set)
        for r in rows:
            shard_of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert all(len(s) == 1 for s in shard_of.values())


def test_sizes_and_checksums(spark, odd):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{odd}/documents.parquet").where("doc_id is not null").collect()}
    for r in QUERIES["op1_rendezvous_sharding"](spark, odd).where("doc_id is not null").collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")


def test_weights_are_kept_and_a_changed_weight_moves_one_shards_rows(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = {r["k"]: r["shard"] for r in sharding.assign(df, "k", 3, [1, 2, 1]).collect()}
    b = {r["k"]: r["shard"] for r in sharding.assign(df, "k", 3, [1, 3, 1]).collect()}
    n = collections.Counter(a.values())
    assert abs(n[1] / len(a) - 0.5) < 0.02 and abs(n[0] / len(a) - 0.25) < 0.02
    assert all(b[k] in (s, 1) for k, s in a.items())
    with pytest.raises(ValueError):
        sharding.assign(df, "k", 2, [1, 0])


# ---- mixing ---------------------------------------------------------------------------------


def targets(sizes):
    """Exact targets by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(share.get(s, full.get(s))) for s in order}
        full |= {s: 3 * sizes[s] for s in over}


def check_mix(docs, rows):
    sizes, taken = collections.Counter(), collections.Counter()
    source = {}
    for d in docs:
        n = len((d["text"] or "").encode().split())
        sizes[d["source"]] += n
        source.setdefault(d["doc_id"], []).append(d["source"])
    wanted = targets(dict(sizes))
    for r in rows:
        s = source[r["doc_id"]][0] if r["doc_id"] is not None else None
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], wanted[s], rel_tol=1e-9, abs_tol=1e-9)
            taken[s] += r["taken"]
    return sizes, taken, wanted


def test_the_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op3_source_mixing"](spark, SF).collect()
    sizes, taken, wanted = check_mix(docs, rows)
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    again = QUERIES["op3_source_mixing"](spark, SF).collect()
    key = lambda r: (r["doc_id"], r["taken"], tuple(r["shards"]), tuple(r["order"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    for r in rows:  # each copy that is taken has a shard
        assert len(r["shards"]) >= -(-r["taken"] // r["size"]) if r["size"] else True


def test_the_mix_bears_odd_sources(spark, odd):
    check_mix(spark.read.parquet(f"{odd}/documents.parquet").where("doc_id is not null").collect(), [])
    rows = QUERIES["op3_source_mixing"](spark, odd).collect()
    assert sum(r["taken"] for r in rows) > 0


def test_the_stage_takes_documents_without_words_with_their_block(spark, folder):
    path = folder(documents=[(i, [f"some words {i}", "", None, " "][i % 4], "en", "ab"[i % 3 == 0], 0) for i in range(200)])
    wanted = {r["doc_id"]: len(r["shards"]) for r in QUERIES["op3_source_mixing"](spark, path).collect() if r["shards"]}
    got = collections.Counter(r["doc_id"] for r in mixing.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect())
    assert got == wanted and any(i % 4 for i in got)


def test_shards_get_their_leaves_and_draw_disjoint_blocks(spark, monkeypatch):
    """Each drawn block of a source goes to one shard, shards get the quotas of their leaves, and the mix is written in each shard's order."""
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 7), "abc"[min(i % 8, 2)]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, n_shards=5, blocks=64).collect()
    of = {r["doc_id"]: r for r in rows}
    block = {r["doc_id"]: r["b"] for r in docs.select("doc_id", F.pmod(mixing.hash52(F.concat(mixing.key_text(F.col("doc_id")), F.lit(":mix:0"))), F.lit(64)).alias("b")).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    shards = collections.defaultdict(set)  # of each draw of a block
    for i, r in of.items():
        for turn, s in enumerate(r["shards"]):
            shards[source[i], block[i], turn].add(s)
    assert all(len(s) == 1 for s in shards.values())
    drawn = collections.Counter(next(iter(s)) for s in shards.values())
    assert max(drawn.values()) - min(drawn.values()) <= 1  # the tree deals all blocks evenly, so leaves have the same number
    per_source = collections.defaultdict(collections.Counter)
    for (name, _, _), s in shards.items():
        per_source[name][next(iter(s))] += 1
    assert all(set(c) == set(range(5)) for c in per_source.values())
    out = mixing.emit(docs, n_shards=5, blocks=64).withColumn("p", F.spark_partition_id()).collect()
    assert collections.Counter(r["doc_id"] for r in out) == {i: len(r["shards"]) for i, r in of.items() if r["shards"]}
    taken = collections.Counter()
    for r in out:
        taken[r["doc_id"]] += len(r["text"].split())
    assert taken == {i: r["taken"] for i, r in of.items() if r["taken"]}
    # a shard's documents aren't in the order of their ids
    ids = [r["doc_id"] for r in out]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_a_plan_that_is_joined_by_shuffle_gives_the_same_mix(spark, monkeypatch):
    wanted = sorted(map(str, QUERIES["op3_source_mixing"](spark, SF).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(map(str, QUERIES["op3_source_mixing"](spark, SF).collect())) == wanted


def test_the_splitting_tree_deals_every_block(spark):
    quotas = [700, 3, 0, 41, 1]
    rows = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), 7, 3).collect()
    assert sorted(r["shard"] for r in rows) == list(range(7))
    assert [sum(r["quotas"][i] for r in rows) for i in range(5)] == quotas
    n = sum(quotas)
    assert all(sum(r["quotas"]) == n * (r["shard"] + 1) // 7 - n * r["shard"] // 7 for r in rows)


def test_hypergeometric_quantiles(spark):
    total, good, draws = 30, 11, 9
    p = [math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) for k in range(10)]
    us = [i / 50 + 0.003 for i in range(50)]
    df = spark.createDataFrame([(u, total, good, draws) for u in us], "u double, t long, g long, d long")
    got = [r[0] for r in df.select(mixing.hypergeometric(*(F.col(c) for c in "utgd"))).collect()]
    assert got == [next(k for k in range(10) if sum(p[: k + 1]) >= u) for u in us]


# ---- decontamination --------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=8):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            q = words(t)
            n = min(window, len(q))
            for i in range(len(q) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=str)


def test_contamination(spark, odd, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect() if len(words(r["text"])) < 1000]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    for block in (10**7, 20):  # one pass, and one pass for nearly each item
        monkeypatch.setattr(decontamination.blocks, "__defaults__", ("item_id", "text", block))
        rows = QUERIES["op2_benchmark_decontamination"](spark, odd).collect()
        small = [tuple(r)[:6] for r in rows if r["n_words"] < 1000]
        assert len(rows) == 14 and sorted(small, key=str) == brute(docs, items)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (4, "alpha")], "doc_id long, text string")
    index = decontamination.build_index(df.coalesce(1))
    rows = {r["doc_id"]: r for r in decontamination.search(index, [(7, "alpha beta")], within=4).collect()}
    assert {d for d, r in rows.items() if r["near"]} == {1, 3} and rows[1]["near"] == ["7"] and not any(r["items"] for r in rows.values())
    exact = {r["doc_id"]: r["spans"] for r in decontamination.search(index, [(7, "beta alpha")]).collect()}
    assert exact == {1: [], 2: [], 3: [0, 2], 4: []}


def test_proximity_against_all_runs_of_words(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices("abcdef", [9, 5, 3, 2, 1, 1], k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(60)]
    items = [(i, text(rng.choice([1, 3, 9, 12]))) for i in range(12)]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {r["doc_id"]: r for r in decontamination.search(index, items, window=4, within=6).collect()}
    for d, t in docs:
        w = t.split()
        runs = [set(w[i : i + 6]) for i in range(len(w))]
        near, exact = set(), set()
        for k, item in items:
            own = item.split()
            for i in range(max(1, len(own) - 3)):
                x = own[i : i + 4]
                near |= {str(k)} if any(set(x) <= r for r in runs) else set()
                exact |= {str(k)} if any(w[j : j + len(x)] == x for j in range(len(w))) else set()
        assert (got[d]["near"], got[d]["items"]) == (sorted(near), sorted(exact))


# ---- licences -------------------------------------------------------------------------------

MIT = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(t for n, t in licenses.SENTENCES if n in ("MIT_GRANT", "MIT_NOTICE", "MIT_ASIS", "MIT_LIABILITY"))
APACHE = "// Copyright 2021 Some One\n" + "\n".join("// " + t for n, t in licenses.SENTENCES if n.startswith("APACHE2_") and n != "APACHE2_UNDER").replace("License at", "License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n//")
LICENCES = [
    (MIT, "MIT", "known"),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n" + APACHE, "Apache-2.0", "known"),
    ("Words.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "known"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "known"),
    ("a b c\nReleased under the MIT License.\nd e f", "MIT", "known"),
    ("/*\n * SPDX-License-Identifier: BSD-3-Clause\n */", "BSD-3-Clause", "known"),
    ("This is licensed in some way of our own.", "", "unknown"),
    ("No such thing here.", "", "none"),
    (None, "", "none"),
    ("", "", "none"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General\nPublic License as published by the Free Software Foundation; either version 2.1 of the License, or (at your\noption) any later version.", "LGPL-2.1-or-later", "known"),
    ("\n\n".join(t for n, t in licenses.SENTENCES if n.startswith("BSD_")), "BSD-4-Clause", "known"),
    ("\n\n".join(t for n, t in licenses.SENTENCES if n.startswith("BSD_") and n != "BSD_ADVERTISING"), "BSD-3-Clause", "known"),
    ("\n\n".join(t for n, t in licenses.SENTENCES if n.startswith("BSD_") and n not in ("BSD_ADVERTISING", "BSD_NO_ENDORSE")), "BSD-2-Clause", "known"),
    ("This project is dual licensed under the MIT license or the Apache License 2.0.", "Apache-2.0,MIT", "known"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT", "known"),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0-or-later", "known"),
    ("This is licensed under the GNU General Public License, version 2 or any later version.", "GPL-2.0-or-later", "known"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "GPL-3.0-only", "known"),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\n" + "\n\n".join(t for n, t in licenses.SENTENCES if n in ("BOOST_GRANT", "BOOST_NOTICE")), "BSL-1.0", "known"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", "known"),
    ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");", "EUPL-1.2", "known"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", "GPL-3.0-only", "known"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", "known"),
    # sentences on both sides of a run, or of an unknown sentence, don't stand together
    ("\n\n".join(dict(licenses.SENTENCES)[n] for n in ("LGPL_TERMS", "ISC_GRANT", "V3_LATER")), "ISC", "known"),
    ("\n\n".join([dict(licenses.SENTENCES)["LGPL_TERMS"], "No warranty of ours here", dict(licenses.SENTENCES)["V3_LATER"]]), "", "unknown"),
]


def test_licence_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LICENCES)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [(rows[i]["licenses"], rows[i]["verdict"]) for i in range(len(LICENCES))] == [(x, v) for _, x, v in LICENCES]


def test_every_known_sentence_has_a_cue_and_is_known(spark):
    df = spark.createDataFrame([(n, t) for n, t in licenses.SENTENCES], "doc_id string, text string")
    for r in licenses.scan(df).collect():
        assert r["doc_id"] in r["sentence_ids"].split(","), r


# ---- personal data --------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "a@b.com_x@y.zz and a.b@c, x@y..z q@w.e.r.t@u.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.1.1.1000", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (743) 555-3824. +12 +1234567 +12345678 +1 2 3 4 5 6 7 8 (", "é@é.fr é x@é.y a@b.c" + "🙂" * 3 + "d@e.f", "9" * 5000, "a" * 20_000 + "@", "x@" + "a." * 9000 + "b", "1." * 5000, "+" * 3000 + "1", "1 " * 3000, None, "",
]


def test_base_spans(spark, folder):
    path = folder(documents=[(i, t) for i, t in enumerate(TEXTS)])
    for r in QUERIES["op6_pii_sanitisation"](spark, path).collect():
        wanted = base_spans(TEXTS[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in wanted)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(w[0] == k for w in wanted) for k, _ in PATTERNS]
        assert r["spans"].startswith(joined)


def test_terms_that_reveal_an_entity_go(spark):
    rows = [(i, f"notes by Zorblatt at zed@x.example about common things {i}") for i in range(3)]
    rows += [(10 + i, f"common things about notes at other{i}@y.example by someone") for i in range(20)] + [(40 + i, "common notes about things by someone") for i in range(20)]
    rows += [(99, None), (98, "Zed@X.example by zorblatt")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sanitized", F.lit("old"))
    got = {r["doc_id"]: r["sanitized"] for r in privacy.sanitise(df).collect()}
    assert got[0] == "notes by [term] at [email] about common things 0" and got[98] == "[email] by [term]"
    assert got[10] == "common things about notes at [email] by someone" and got[40] == rows[23][1] and got[99] is None


def test_a_term_far_from_the_mention_goes_everywhere(spark):
    far = "plain words of no one in particular " * 5
    rows = [(i, f"Zorblatt wrote {far}to zed@x.example and {far}left; zorblatt again {i}") for i in range(3)]
    rows += [(10 + i, f"{far}wrote to other{i}@y.example and again left") for i in range(40)]
    got = {r["doc_id"]: r["sanitized"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == f"[term] wrote {far}to [email] and {far}left; [term] again 0"
    assert got[10] == f"{far}wrote to [email] and again left"


def test_disclosure_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    names = ["ann@a.aa", "bob@b.bb", "10.0.0.1"]
    vocabulary = ["river", "stone", "cloud", "eagle", "piano", "tiger"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(4)) + (" " + rng.choice(names) + " " if rng.random() < 0.5 else " ") + " ".join(rng.choice(vocabulary) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    found = privacy.detect(df, "text").cache()
    pairs = privacy.near_terms(found).cache()
    got = {(r["entity"], r["term"]): round(r["share"], 9) for r in privacy.disclosing(df, found, pairs, "text").collect()}
    n, df_e, df_t, both = len(texts), collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        own = set(re.findall(r"[^\W\d_]{4,}", t))
        df_t.update(own)
        for k, e in (("0:" + names[0], names[0]), ("0:" + names[1], names[1]), ("1:" + names[2], names[2])):
            if e in t:
                df_e[k] += 1
                both.update((k, w) for w in own)
    wanted = {p: round(math.log2(c * n / (df_e[p[0]] * df_t[p[1]])) / math.log2(n / df_e[p[0]]), 9) for p, c in both.items() if c >= privacy.SUPPORT}
    assert got == {p: s for p, s in wanted.items() if s >= privacy.GENERALISE}
