"""Random events, NULLs, NaN and hot keys included, against the rules stated in plain Python."""

import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from events import as_dicts, frame
from test_streaming import random_events

from ordertide.contract import EVENT_COLUMNS, EVENT_TYPES, PROVINCES
from ordertide.operators import marts, quality, resolve


def rank(value):
    """NULL is lowest and NaN highest, as in a descending sort with NULLs last."""
    if value is None:
        return (0, 0)
    if isinstance(value, float) and math.isnan(value):
        return (2, 0)
    return (1, value)


def latest(rows, key, recency):
    best = {}
    for row in rows:
        k = row[key]
        order = [rank(row[name]) for name in recency]
        if k not in best or order > best[k][0]:
            best[k] = (order, row)
    return [row for _, row in best.values()]


def reason(row):
    quantity, price = row["quantity"], row["unit_price_vnd"]
    if quantity is not None and quantity <= 0:
        return "non_positive_quantity"
    if price is not None and price <= 0:
        return "non_positive_price"
    if row["province"] is not None and row["province"] not in PROVINCES:
        return "unknown_province"
    if row["event_type"] is not None and row["event_type"] not in EVENT_TYPES:
        return "unknown_event_type"
    return None


def cents(value):
    return float(value.quantize(Decimal("0.01"), ROUND_HALF_UP))


def provinces(state):
    """Orders, units, revenue and average per province; only for groups without stray doubles."""
    groups = defaultdict(list)
    for row in state:
        if row["event_type"] is not None and row["event_type"] != "cancelled":
            groups[row["province"]].append(row)
    result = {}
    for province, rows in groups.items():
        amounts = [
            row["quantity"] * Decimal(repr(row["unit_price_vnd"]))
            for row in rows
            if row["quantity"] is not None and row["unit_price_vnd"] is not None
        ]
        units = [row["quantity"] for row in rows if row["quantity"] is not None]
        result[province] = {
            "province": province,
            "orders": sum(row["order_id"] is not None for row in rows),
            "units": sum(units) if units else None,
            "revenue_vnd": cents(sum(amounts)) if amounts else None,
            "average_order_value_vnd": cents(sum(amounts) / len(amounts)) if amounts else None,
        }
    return result


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_state_and_marts(spark, seed):
    rows = list(random_events(seed, n=600))
    for row in rows:  # amounts that a decimal holds, to compare sums exactly
        price = row["unit_price_vnd"]
        if math.isnan(price) or price > 1e12:
            row["unit_price_vnd"] = None if math.isnan(price) else 333.335
    events = frame(spark, rows)
    plain = as_dicts(events)
    resolved = latest(plain, "event_id", resolve.EVENT_RECENCY)
    state = latest(
        [row for row in resolved if reason(row) is None], "order_id", resolve.STATE_RECENCY
    )

    classified = quality.classify_events(resolve.dedup_latest_event(events.repartition(5)))
    got = {row["event_id"]: row for row in as_dicts(classified)}
    assert got == {
        row["event_id"]: {**row, "rejection_reason": reason(row)} for row in resolved
    }

    current = resolve.current_order_state(quality.accepted_events(classified))
    assert {row["order_id"]: row for row in as_dicts(current.select(*EVENT_COLUMNS))} == {
        row["order_id"]: row for row in state
    }

    cells = marts.sales_cells(resolve.active_orders(current))
    mart = {row["province"]: row for row in as_dicts(marts.province_sales(cells))}
    assert mart == provinces(state)
