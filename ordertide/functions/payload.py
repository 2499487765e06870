"""The JSON wire payload: events to key/value records and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.contract import EVENT_COLUMNS, ORDER_EVENT_SCHEMA, WIRE_TIMESTAMP_FORMAT

JSON_OPTIONS = {"timestampFormat": WIRE_TIMESTAMP_FORMAT}


def encode_payload(events: DataFrame) -> DataFrame:
    """Records keyed by order_id, so that one order's events share a topic partition."""
    value = F.to_json(F.struct(*EVENT_COLUMNS), JSON_OPTIONS)
    return events.select(F.col("order_id").alias("key"), value.alias("value"))


def decode_payload(records: DataFrame, *keep: str) -> DataFrame:
    """Event columns from a ``value`` column (bytes or text), plus the record columns in ``keep``.

    A value that is not a JSON object, or a NULL value, gives a row of NULL fields.
    """
    event = F.from_json(F.col("value").cast("string"), ORDER_EVENT_SCHEMA).alias("event")
    return records.select(event, *keep).select("event.*", *keep)
