"""ordertide: order-event analytics on Spark DataFrames and Structured Streaming."""

from ordertide.contract import DEFAULT_CONTRACT, ORDER_EVENT_SCHEMA, OrderContract
from ordertide.plans.curate import curate_and_publish, open_table, read_reports
from ordertide.streaming.incremental import IncrementalMarts
from ordertide.streaming.landing import land_file_stream, stream_from_kafka

__all__ = [
    "DEFAULT_CONTRACT",
    "ORDER_EVENT_SCHEMA",
    "IncrementalMarts",
    "OrderContract",
    "curate_and_publish",
    "land_file_stream",
    "open_table",
    "read_reports",
    "stream_from_kafka",
]
