import subprocess
import sys

import pytest
from symdex import queries

ROOT = __file__.rpartition("/tests/")[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_has_the_rows_of_its_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_engine_stands_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nfor m in ('symdex.llm',): sys.modules[m] = None\nfrom symdex import api, queries\nassert not any(m.startswith('symdex.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_the_driver_entry_stands_without_the_corpus_folder(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/symdex", tmp_path / "symdex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'hybrid_rrf' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_a_refreshed_index_searches_like_one_built_in_one_go(spark):
    sf_dir = "/root/testdata/sf0.001"
    one, other = queries.refreshed(spark, sf_dir), queries.built(spark, sf_dir)
    a, b = one.store.manifest(), other.store.manifest()
    assert (a.n_chunks, a.n_tokens) == (b.n_chunks, b.n_tokens) and len(a.layers) == 2 and a.gone
    for words in (queries.WORDS, "edble reble", "in the"):
        # ids differ, and with them the order of ties, so the hits are taken without a limit that could cut a tie
        ranks = [{(r["file_path"], r["symbol_name"]): round(r["rank"], 6) for r in e.search_text(words, 10_000).collect()} for e in (one, other)]
        assert ranks[0] == ranks[1] and ranks[0]


def test_an_index_of_a_table_needs_a_folder(spark):
    from symdex.api import Engine

    with pytest.raises(ValueError):
        Engine(spark, files=queries.files_now(spark, "/root/testdata/sf0.001"))
