import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from symdex.functions import text
from symdex.operators import fulltext

WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll users running runner database connections".split()


def fts5(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, a, b) values (?, ?, ?)", rows)
    return con


def test_stems_are_those_of_the_full_text_engine():
    con = fts5([(1, " ".join(WORDS), "")])
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    found = [r[0] for r in con.execute("select term from v order by offset")]
    assert found == [text.stem(w) for w in WORDS]


@pytest.mark.parametrize(("given", "tokens"), [("get_user", ["get", "user"]), ("été", ["et"]), ("Users RUNNING", ["user", "run"]), ("", []), (None, []), ("a-b.c", ["a", "b", "c"])])
def test_tokens(given, tokens):
    assert text.tokens(given) == tokens


def test_phrases_keep_repeats_and_drop_wordless_ones():
    assert text.phrases("run run get_user ___ !") == [["run"], ["run"], ["get", "user"]]


def test_bm25_with_phrases_equals_the_full_text_engine(spark):
    rng = random.Random(5)
    vocabulary = ["get", "user", "users", "running", "database", "the", "the", "été", "connection", "x1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 3))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(1, 80)]
    con = fts5(rows)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    index = fulltext.postings(df, "id", ["a", "b"]).cache()
    n_tokens = index.groupBy("id").agg(F.max("n_tokens").alias("n")).agg(F.sum("n")).first()[0]
    for query in ("user", "run run", "get_user database", "the", "ete x1 connections", "missing", "user missing_word"):
        wanted = " OR ".join(f'"{w}"' for w in text.QUERY_WORD.findall(query))
        theirs = {r[0]: r[1] for r in con.execute("select rowid, rank from t where t match ? order by rank", [wanted])}
        ours = {r["id"]: r["rank"] for r in fulltext.rank(index, text.phrases(query), len(rows), n_tokens).collect()}
        assert ours.keys() == theirs.keys(), query
        assert all(math.isclose(ours[i], theirs[i], rel_tol=1e-9, abs_tol=1e-12) for i in ours), query


def test_ranking_needs_words_and_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, t string")
    assert fulltext.rank_texts(df, "id", "t", [["a"]]).count() == 1
    assert fulltext.rank_texts(df, "id", "t", []).count() == 0
    assert fulltext.rank_texts(df.limit(0), "id", "t", [["a"]]).count() == 0
    with pytest.raises(ValueError):
        fulltext.rank_texts(df, "id", "t", [["a", "b"]])


@pytest.mark.parametrize("given", ["", "\n", "a", "a\n", "a\n\nb", "a\r\nb\rc\fd\x0be\x1cf\x85g h ", None])
def test_lines_are_those_of_splitlines(spark, given):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.lines(F.col("t")).alias("l")).first()["l"] == (given or "").splitlines()
