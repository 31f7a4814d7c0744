import pytest
from pyspark.sql import functions as F
from symdex.functions import render
from symdex.functions import vectors as V
from symdex.operators import search, tracking


def test_substrings_fold_ascii_alone(spark):
    names = ["Get_User", "getXuser", "GÉT", "get", "a%b", "a\\b", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = lambda q: {r[0] for r in df.where(search.contains_like(F.col("n"), q)).collect()}
    assert found("GET_USER") == {"Get_User", "getXuser"}
    assert found("gÉt") == {"GÉT"} and found("gét") == set()
    assert found("\\") == {"a\\b"} and found("a%b") == {"a%b", "a\\b"}
    assert found("") == set(names) - {None}


def test_longest_word_is_the_first_of_several():
    assert search.longest_word("ab cde fgh") == "cde" and search.longest_word(" .! ") is None


def test_nearest_passes_over_what_is_no_vector(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [5.0, 5.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    assert [(r["id"], round(r["distance"], 6)) for r in V.nearest(df, [0.0, 0.0], 2).collect()] == [(1, 1.0), (2, 1.0)]
    assert [r["id"] for r in V.nearest(df, [0.0, 0.0], 9).collect()] == [1, 2, 6]
    assert V.nearest(df.limit(0), [0.0, 0.0], 3).count() == 0
    native = df.select("id", V.l2(F.col("embedding"), [0.0, 0.0]).alias("d")).collect()
    assert {r["id"] for r in native if r["d"] is None} >= {3, 4}


def test_fusion_keeps_the_order_of_the_legs(spark):
    near = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.2)], "id long, distance double")
    text = spark.createDataFrame([(9, -3.0), (2, -2.0), (8, -2.0)], "id long, rank double")
    rows = search.fuse(near, text, 10).collect()
    assert [r["id"] for r in rows] == [2, 1, 9, 3, 8]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 62) and rows[1]["rank"] is None and rows[2]["distance"] is None
    kinds = spark.createDataFrame([(1, "section"), (2, "enum"), (3, "method"), (8, "class"), (9, "constant")], "id long, symbol_type string")
    boosted = search.fuse(near, text, 2, kinds).collect()
    assert [r["id"] for r in boosted] == [2, 3] or [r["id"] for r in boosted] == [2, 8]
    assert boosted[0]["score"] == pytest.approx(0.8 * 2 / 62)


def test_boosts(spark):
    df = spark.createDataFrame([("method",), ("section",), ("trait",), (None,)], "k string")
    assert [r[0] for r in df.select(search.boost(F.col("k"))).collect()] == [1.15, 0.6, 0.8, 0.8]


def broken():
    """An embedder that fails; made here, so that workers need no import of this file."""

    class Broken:
        dimension = 3

        def encode(self, texts):
            raise RuntimeError("no model")

    return Broken()


def test_embedding_is_ordered_and_failures_are_null(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(700)], "id long, t string")
    e = V.HashEmbedder(16)
    rows = {r["id"]: r["embedding"] for r in V.embed(df, e, "t").collect()}
    wanted = e.encode([f"text number {i}" for i in range(700)]).tolist()
    assert all(rows[i] == pytest.approx(wanted[i]) for i in range(700))
    assert V.embed(df, broken(), "t").where("embedding is not null").count() == 0
    q = V.QueryVectors(broken())
    assert q("x") is None and not q.held
    q = V.QueryVectors(e, most=2)
    assert q("a") == q("a") and q("b") and q("c") and list(q.held) == ["b", "c"]


def slow_model():
    """Loaders that fail and that hang; made here, so that workers need no import of this file."""
    import time

    class Hangs:
        def encode(self, texts):
            time.sleep(60)

    def broken():
        raise RuntimeError("no weights")

    return broken, Hangs


def test_a_lazy_embedder_loads_once_and_remembers_a_failure(spark):
    import time

    calls = []
    good = V.LazyEmbedder("good", lambda: calls.append(1) or V.HashEmbedder(8), 8)
    assert good.encode(["a"]).shape == (1, 8) and good.encode(["b", "c"]).shape == (2, 8) and calls == [1]
    load, hangs = slow_model()
    bad = V.LazyEmbedder("bad", lambda: calls.append(2) or load(), 8)
    for _ in range(2):
        with pytest.raises(V.EmbedderGone):
            bad.encode(["a"])
    assert calls == [1, 2]
    bad.reset()
    with pytest.raises(V.EmbedderGone):
        bad.encode(["a"])
    assert calls == [1, 2, 2]
    df = spark.createDataFrame([(i, "t") for i in range(2000)], "id long, t string").coalesce(1)
    began = time.time()
    assert V.embed(df, V.LazyEmbedder("hangs", hangs, 8, timeout=0.5), "t", batch=10).where("embedding is not null").count() == 0
    assert time.time() - began < 30


def test_fused_ids_are_those_of_the_fusion(spark):
    import random

    rng = random.Random(4)
    kinds = ["section", "enum", "method", "class", "constant", "other"]
    for _ in range(3):
        near = sorted(((i, rng.random()) for i in rng.sample(range(40), 15)), key=lambda x: (x[1], x[0]))
        text = sorted(((i, -rng.random()) for i in rng.sample(range(40), 15)), key=lambda x: (x[1], x[0]))
        kind = {i: rng.choice(kinds) for i in range(40)}
        wanted = search.fuse(spark.createDataFrame(near, "id long, distance double"), spark.createDataFrame(text, "id long, rank double"), 12, spark.createDataFrame(list(kind.items()), "id long, symbol_type string")).collect()
        got = search.fused_ids(near, text, kind)[:12]
        assert [g[0] for g in got] == [r["id"] for r in wanted] and [g[1:3] for g in got] == [(r["distance"], r["rank"]) for r in wanted] and [g[3] for g in got] == pytest.approx([r["score"] for r in wanted])


def test_every_path_has_one_action(spark):
    tracked = spark.createDataFrame([("same", 1.0, 5, "h1"), ("touched", 1.0, 5, "h2"), ("changed", 1.0, 5, "h3"), ("gone", 1.0, 5, "h4"), ("nulls", None, None, None)], "file_path string, file_mtime double, file_size long, content_hash string")
    current = spark.createDataFrame([("same", 1.0, 5, "other"), ("touched", 2.0, 5, "h2"), ("changed", 1.0, 6, "hx"), ("fresh", 1.0, 1, "h5"), ("nulls", None, None, None)], "file_path string, file_mtime double, file_size long, content_hash string")
    rows = tracking.diff(current, tracked, current).select("file_path", "action").collect()
    assert {tuple(r) for r in rows} == {("same", "unchanged"), ("touched", "touched"), ("changed", "changed"), ("gone", "deleted"), ("fresh", "new"), ("nulls", "unchanged")}
    first = {r["file_path"]: r["action"] for r in tracking.diff(current, tracked).collect()}
    assert first["touched"] == first["changed"] == "suspect" and len(first) == 6


def test_upsert_and_last_write(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "k string, v int")
    found = tracking.upsert(old, tracking.last_by(new, "k", "v"), "k")
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("b", 3), ("c", 5)}


def test_rendering():
    row = {"symbol_type": "route", "symbol_name": "f", "file_path": "a.py", "line_start": 1, "line_end": 2, "score": None, "source_code": "x" * 600, "route_path": "/r", "parent_class": "C", "docstring": "one\ntwo" + "z" * 100}
    assert render.hits([row]).startswith("**route** `f` in `a.py` (L1-2) [relevance=0]\n```python\n" + "x" * 500 + "\n```")
    assert render.symbols("f", [row]) == "**route** `f` in `a.py` (L1-2) route=/r class=C"
    assert render.overview("a.py", [row]).splitlines()[2] == "  - **route** `f` (L1-2) route=/r — one two" + "z" * 73
    assert render.hits([]) and render.symbols("f", []) and render.overview("a", [])
    assert render.bar(1, 0) == "[" + "?" * 30 + "]" and render.bar(5, 10).endswith(" 50%") and render.bar(20, 10).endswith("100%")
    assert render.remaining(10, 5, 10) == "about 10 s left" and render.remaining(0.1, 5, 10) == "" and render.remaining(100, 99, 100) == "almost done"
