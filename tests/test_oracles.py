"""Every registered query equals its SQL on the test tables."""

import os
import sys

import pytest
from compare import duckdb_rows, spark_rows

import __spark_entry__ as entry_module
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_queries_do_not_need_the_optional_packages(monkeypatch):
    """Without a package that only the corpus operators use, all other queries stay."""
    for name in [n for n in sys.modules if n.startswith(("ordertide.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(entry_module.queries()) == set(QUERIES)
    assert set(entry_module.oracle_sql()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected_rows = duckdb_rows(SF_DIR, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows
