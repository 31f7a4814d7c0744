"""Steps whose time or shuffled bytes had grown too fast."""

from pyspark.sql import functions as F
from symdex.api import Engine
from symdex.functions import text
from symdex.functions.paths import prune
from symdex.operators import chunks, fulltext
from symdex.plans.index import TableIndexer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prose_is_not_cut_into_declaration_tokens():
    prose = "of the class  of words,  a function  or two  " * 20_000
    assert chunks.ScriptDeclarations(prose).tokens == [] and chunks.PhpDeclarations(prose.replace("class ", "").replace("function ", "")).tokens == []
    assert [x[2:] for x in chunks.ScriptDeclarations("a\nexport class B {}").found()] == [("class", "B")]
    assert sorted(x[2:] for x in chunks.PhpDeclarations("a\n  final CLASS b\n x define( 'C'").found()) == [("class", "b"), ("constant", "C")]


def test_stemmed_texts_rank_as_their_postings(spark):
    rows = [(1, "Running dogs of the dyed étions"), (2, "of_the the of the runs"), (3, None), (4, ""), (5, "dies of\nthe x dying")]
    docs = spark.createDataFrame(rows, "id long, t string")
    index = fulltext.postings(docs, "id", ["t"])
    n = sum(len(text.tokens(t)) for _, t in rows)
    for query in ("runs of_the étion", "of_the of_the x", "dies", "absent"):
        found = fulltext.rank_stemmed_texts(docs, "id", "t", text.phrases(query))
        assert {r[0]: round(r[1], 9) for r in found.collect()} == {r[0]: round(r[1], 9) for r in fulltext.rank(index, text.phrases(query), len(rows), n).collect()}


def test_plain_postings_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "b a B c"), (2, None), (3, ""), (4, "a")], "id long, t string").repartition(2)
    index = fulltext.plain_postings(docs, "id", "t")
    assert sorted(map(tuple, index.collect())) == [("a", 1, 0, [1], 4), ("a", 4, 0, [0], 1), ("b", 1, 0, [0, 2], 4), ("c", 1, 0, [3], 4)]
    assert "Exchange" not in plan(fulltext.plain_postings(spark.range(1).select("id", F.col("id").cast("string").alias("t")), "id", "t"))


def test_pruning_shuffles_only_rows_that_may_go(spark):
    files = spark.createDataFrame([("a/x.txt", b"1"), ("wp-content/themes/t.txt", b"2"), ("b/plugins/p.txt", b"3")], "file_path string, content binary")
    found = prune(files)
    assert "Union" in plan(found) and sorted(r[0] for r in found.collect()) == ["a/x.txt", "b/plugins/p.txt", "wp-content/themes/t.txt"]


def test_a_refresh_reads_contents_once_and_leaves_no_working_folders(spark, tmp_path, monkeypatch):
    calls = []
    contents = TableIndexer.contents
    monkeypatch.setattr(TableIndexer, "contents", lambda self, files=None: calls.append(1) or contents(self, files))
    rows = [(f"a{i}.txt", 1.0, 20, b"some words of a file") for i in range(3)]
    kind = "file_path string, file_mtime double, file_size bigint, content binary"
    Engine(spark, index=str(tmp_path / "i"), files=spark.createDataFrame(rows[:2], kind)).refresh()
    calls.clear()
    s = Engine(spark, index=str(tmp_path / "i"), files=spark.createDataFrame([("a0.txt", 2.0, 21, b"other words of a file"), *rows[1:]], kind)).refresh()
    assert s["total_chunks"] == 3 and s["meta"]["files_reindexed"] == "2" and len(calls) == 1
    assert not [p.name for p in (tmp_path / "i").iterdir() if p.name.startswith(("looked", "diff"))]


def test_texts_are_cut_into_lines_once(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) + end for n in (1, 29, 30, 31, 50, 51, 100, 101) for end in ("", "\n", "\r\n", "\n\n")]
    texts += [None, "", "a\rb\x85c d\r\ne\x1c", "x\n" + " \n" * 60, "y\n" * 50 + "\x1f\n" * 50 + "z"]
    files = spark.createDataFrame([(f"f{i}.txt", t, 1.0) for i, t in enumerate(texts)], "file_path string, text string, file_mtime double")
    found = chunks.plain_chunks(files)
    assert "Union" not in plan(found)
    apart = chunks.file_summaries(files).unionByName(chunks.sections(files))
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    lines = {r[0]: r[1] for r in files.select("file_path", text.lines(F.col("text"))).collect()}
    assert [lines[f"f{i}.txt"] for i in range(len(texts))] == [(t or "").splitlines() for t in texts]


def test_a_distinct_word_is_stemmed_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(fulltext, "stem", lambda w: calls.append(w) or text.stem(w))
    found = fulltext.grouped(pa.array([7, 8]), np.array([[1, 3], [0, 2]]), pa.array("runs run dogs runs dogs run".split()), True)
    assert sorted(map(tuple, (r.values() for r in found.to_pylist()))) == [("dog", 7, 1, [1], 4), ("dog", 8, 1, [0], 2), ("run", 7, 0, [0], 4), ("run", 7, 1, [0, 2], 4), ("run", 8, 1, [1], 2)]
    assert sorted(calls) == ["dogs", "run", "runs"]
    assert fulltext.grouped(pa.array([], pa.int64()), np.zeros((0, 2), np.int64), pa.array([], pa.string()), True).num_rows == 0


def test_contents_of_an_unchanged_table_are_not_looked_for(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.txt", 1.0, 20, b"some words of a file")], "file_path string, file_mtime double, file_size bigint, content binary")
    e = Engine(spark, index=str(tmp_path / "i"), files=files)
    e.refresh()
    before = e.store.manifest()
    monkeypatch.setattr(TableIndexer, "contents", lambda self, files=None: 1 / 0)
    e.refresh()
    assert e.store.manifest() == before and not [p.name for p in (tmp_path / "i").iterdir() if p.name.startswith(("looked", "diff"))]


def test_the_earlier_state_is_one_pass_over_the_documents(spark):
    from symdex import queries

    sf_dir = "/root/testdata/sf0.001"
    found = queries.files_before(spark, sf_dir)
    assert plan(found).count("FileScan") == 2
    texts = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "documents").collect()}
    marks = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "labels").collect()}
    expected = []
    for i, m in marks.items():
        if (d := texts.get(i)) is not None:
            t = d["text"] or ""
            expected.append((f"{d['source']}/{i}.txt", 1.0 if m["toxic"] == 1 or m["quality"] == 1 else 2.0, "old\n" + t if m["toxic"] == 1 else t))
            expected += [(f"gone/{i}.txt", 1.0, t)] if m["quality"] == 0 else []
    assert sorted((r["file_path"], r["file_mtime"], bytes(r["content"]).decode()) for r in found.collect()) == sorted(expected)


def test_empty_tables_of_a_store_and_the_status_start_no_worker(spark, tmp_path):
    from symdex import queries, schema
    from symdex.sources.store import Store

    empty = Store(spark, str(tmp_path)).empty(schema.CHUNKS)
    assert empty.schema == schema.CHUNKS and "LocalTableScan" in plan(empty)
    assert "LocalTableScan" in plan(queries.engine_status(spark, "/root/testdata/sf0.001"))
