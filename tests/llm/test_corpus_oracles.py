"""Corpus queries that SQL can express equal their SQL."""

import os

import pytest
from compare import duckdb_rows, spark_rows

import __spark_entry__ as entry_module
from ordertide.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_every_operator_has_one_query():
    registered = entry_module.queries()
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registered)
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected_rows = duckdb_rows(SF_DIR, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows
