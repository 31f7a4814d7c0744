import subprocess

import pytest
from symdex.llm import registry

ROOT = __file__.rpartition("/tests/")[0]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_has_the_rows_of_its_sql(same_as_sql, name):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_bear_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_bear_odd_rows(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    assert len(rows) == (0 if "embedding" in name or "warc" in name else 14)


def test_ten_operators_are_registered():
    assert {int(n[2:].partition("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11))


def test_nothing_else_in_the_library_imports_the_operators():
    found = subprocess.run(["grep", "-rlE", r"symdex\.llm|from \.*llm", "--include=*.py", f"{ROOT}/symdex"], capture_output=True, text=True).stdout.split()
    assert all("/symdex/llm/" in f for f in found)
