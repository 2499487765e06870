"""Latest-row resolution: one row per event, then one row per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.contract import CANCELLED, EVENT_COLUMNS

# After the two clocks every other field breaks ties, so the survivor never depends on row order.
EVENT_RECENCY = ("ingest_ts", "event_ts") + tuple(
    name for name in EVENT_COLUMNS if name not in ("event_id", "ingest_ts", "event_ts")
)
COPIES = "copies"
STATE_RECENCY = ("event_ts", "ingest_ts", "event_id")


def latest_per_key(frame: DataFrame, keys: Sequence[str], recency: Sequence[Column]) -> DataFrame:
    """The first row of every key group under ``recency``; NULL keys form one group.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle as well, so a
    task sends at most one row per key. A key that holds a third of all rows therefore arrives at
    its reducer as one row per map task.
    """
    order = Window.partitionBy(*keys).orderBy(*recency)
    return (
        frame.withColumn("_position", F.row_number().over(order))
        .filter("_position = 1")
        .drop("_position")
    )


def dedup_latest_event(events: DataFrame) -> DataFrame:
    """Collapse re-delivered copies: the copy ingested last wins, good or bad."""
    provenance = [name for name in events.columns if name not in EVENT_COLUMNS]
    recency = [F.col(name).desc() for name in EVENT_RECENCY + tuple(provenance)]
    return latest_per_key(events, ["event_id"], recency)


def dedup_counting_copies(events: DataFrame) -> DataFrame:
    """``dedup_latest_event`` with ``copies``, the occurrences each surviving row stands for.

    Copies are counted while they are collapsed, so their sum tells whether an occurrence got lost.
    Partial aggregates run before the shuffle, so a hot event id costs one row per map task. What ranks a copy is
    all of it, so the aggregate holds each copy once.
    """
    columns = events.columns
    provenance = [name for name in columns if name not in EVENT_COLUMNS]
    recency = F.struct(*[n for n in EVENT_RECENCY if n in columns], *provenance)
    grouped = events.groupBy("event_id").agg(F.max(recency).alias("latest"), F.count("*").alias(COPIES))
    return grouped.select("event_id", "latest.*", COPIES).select(*columns, COPIES)


def current_order_state(accepted: DataFrame) -> DataFrame:
    """The latest accepted event of every order, with its order date and revenue."""
    recency = [F.col(name).desc() for name in STATE_RECENCY]
    return priced_orders(latest_per_key(accepted, ["order_id"], recency))


def priced_orders(latest: DataFrame) -> DataFrame:
    """Latest events of orders with their order date and revenue."""
    return latest.withColumns(
        {
            "order_date": F.to_date("event_ts"),
            "revenue_vnd": F.col("quantity") * F.col("unit_price_vnd"),
        }
    )


def active_orders(state: DataFrame) -> DataFrame:
    """Orders that count as sales. An order with a NULL event type is neither active nor cancelled."""
    return state.filter(F.col("event_type") != CANCELLED)


def cancelled_orders(state: DataFrame) -> DataFrame:
    return state.filter(F.col("event_type") == CANCELLED)
