"""Hand-written event rows for the golden cases."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ordertide.contract import EVENT_COLUMNS, ORDER_EVENT_SCHEMA

BASE = {
    "order_id": "O1",
    "customer_id": "C1",
    "product_id": "P1",
    "category": "Home",
    "province": "Ha Noi",
    "quantity": 2,
    "unit_price_vnd": 100.0,
    "event_type": "created",
    "event_ts": "2025-01-06T10:00:00+00:00",
}


def event(event_id, **fields) -> dict:
    row = {"event_id": event_id, **BASE, **fields}
    row.setdefault("ingest_ts", row["event_ts"])
    return row


def _typed(name: str, value):
    if name.endswith("_ts") and value is not None:
        return datetime.fromisoformat(value).astimezone(timezone.utc)
    return value


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    typed = [tuple(_typed(name, row[name]) for name in EVENT_COLUMNS) for row in rows]
    return spark.createDataFrame(typed, ORDER_EVENT_SCHEMA)


def write_jsonl(path: Path, rows: list[dict | str]) -> None:
    """One JSON-lines file; strings are written as they are (broken lines)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [row if isinstance(row, str) else json.dumps(row) for row in rows]
    path.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")


def as_dicts(result: DataFrame) -> list[dict]:
    return [row.asDict() for row in result.collect()]
