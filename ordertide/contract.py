"""The order-event contract: schema, closed value domains and quality rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Wire schema, domains, reason codes and labels that consumers of the tables
# depend on.
ORDER_EVENT_FIELDS = (
    ("event_id", "string"),
    ("order_id", "string"),
    ("customer_id", "string"),
    ("product_id", "string"),
    ("category", "string"),
    ("province", "string"),
    ("quantity", "integer"),
    ("unit_price_vnd", "double"),
    ("event_type", "string"),
    ("event_ts", "timestamp"),
    ("ingest_ts", "timestamp"),
)
PROVINCES = (
    "Ha Noi", "Ho Chi Minh City", "Da Nang", "Hai Phong", "Can Tho", "Quang Ninh",
    "Thanh Hoa", "Nghe An", "Khanh Hoa", "Lam Dong", "Binh Duong", "Dong Nai",
)
CATEGORIES = ("Electronics", "Home", "Beauty", "Fashion", "Grocery", "Sports")
EVENT_TYPES = ("created", "updated", "cancelled")
CANCELLED = "cancelled"
FORECAST_MODEL = "linear_trend_weekday_seasonality"
FORECAST_HORIZON = 7
REPORT_PROFILE = "fixture-stream"
REPORT_SEED = 2026
DEFAULT_TOPIC = "ecommerce.order_events"
# ISO-8601 with offset and full microseconds; Spark's default JSON format stops at milliseconds.
WIRE_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# --- end of fixed values ----------------------------------------------------


def schema_of(*fields: tuple[str, str]) -> T.StructType:
    """A schema of nullable (name, type) fields; unlike DDL text it needs no running session."""
    schema = T.StructType()
    for name, kind in fields:
        schema = schema.add(name, kind)
    return schema


ORDER_EVENT_SCHEMA = schema_of(*ORDER_EVENT_FIELDS)
EVENT_COLUMNS = tuple(ORDER_EVENT_SCHEMA.fieldNames())


@dataclass(frozen=True)
class Rule:
    """A quality rule: rows for which ``broken`` is TRUE get ``reason``.

    ``broken`` builds the predicate lazily, because a Column needs a running session. A predicate
    that evaluates to NULL does not fire, so a NULL field passes every rule.
    """

    reason: str
    broken: Callable[[], Column]


@dataclass(frozen=True)
class OrderContract:
    """Domains and rules for one deployment. The defaults are the published contract."""

    provinces: tuple[str, ...] = PROVINCES
    categories: tuple[str, ...] = CATEGORIES
    event_types: tuple[str, ...] = EVENT_TYPES

    def rules(self) -> tuple[Rule, ...]:
        """Rules in priority order; the first broken one names the rejection."""
        return (
            Rule("non_positive_quantity", lambda: F.col("quantity") <= 0),
            Rule("non_positive_price", lambda: F.col("unit_price_vnd") <= 0),
            Rule("unknown_province", lambda: ~F.col("province").isin(*self.provinces)),
            Rule("unknown_event_type", lambda: ~F.col("event_type").isin(*self.event_types)),
        )


DEFAULT_CONTRACT = OrderContract()
