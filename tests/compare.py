"""Exact comparison of a Spark result with DuckDB's answer on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def duckdb_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), _sorted_rows(columns, result.fetchall())


def spark_rows(frame: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), _sorted_rows(frame.columns, frame.collect())
