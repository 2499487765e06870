"""Sales marts.

All marts are sums over *cells*: additive rows keyed by hour, province and category. An order is
projected to a one-order cell, cells add up along any subset of the keys, and only the last step
turns them into published columns. The batch plan reads the order state once for one cell table and
derives every mart from that; the incremental plan adds and subtracts cells.

Each order is one row of the state, so counting order ids equals counting distinct ones, without the
second shuffle a distinct count needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import money

CELL_KEYS = ("sales_hour", "province", "category")
# rows: orders in the cell, with or without an id; counted and priced: orders with a quantity and
# with a revenue. A sum over none of those is NULL, also after orders were subtracted again.
CELL_COUNTS = ("rows", "orders", "units", "counted", "priced")


def order_cells(active: DataFrame, *kept: str) -> DataFrame:
    """One cell row per active order; ``kept`` columns stay beside it."""
    quantity, price = F.col("quantity"), F.col("unit_price_vnd")
    return active.select(
        *kept,
        F.date_trunc("hour", "event_ts").alias("sales_hour"),
        "province",
        "category",
        F.lit(1).cast("long").alias("rows"),
        F.col("order_id").isNotNull().cast("long").alias("orders"),
        quantity.cast("long").alias("units"),
        quantity.isNotNull().cast("long").alias("counted"),
        (quantity * price).isNotNull().cast("long").alias("priced"),
        money.exact_amount(quantity, price).alias("amount"),
        money.stray_amount(quantity, price).alias("stray"),
    )


def sum_cells(cells: DataFrame, *keys) -> DataFrame:
    """Add cells up; partial sums run before the shuffle, so a hot key costs one row per task."""
    return cells.groupBy(*keys).agg(
        *(F.sum(name).alias(name) for name in CELL_COUNTS),
        F.sum("amount").cast(money.AMOUNT_TYPE).alias("amount"),
        F.sum("stray").alias("stray"),
    )


def _units() -> Column:
    return F.when(F.col("counted") > 0, F.col("units"))


def _revenue() -> Column:
    return F.when(F.col("priced") > 0, money.rounded_total(F.col("amount"), F.col("stray")))


def _sales_columns() -> list[Column]:
    mean = money.rounded_mean(F.col("amount"), F.col("stray"), F.col("priced"))
    return [
        F.col("orders"),
        _units().alias("units"),
        _revenue().alias("revenue_vnd"),
        mean.alias("average_order_value_vnd"),
    ]


def sales_cells(active: DataFrame) -> DataFrame:
    """Hour x province x category cells: the finest grain any mart needs."""
    return sum_cells(order_cells(active), *CELL_KEYS)


def daily_sales(cells: DataFrame) -> DataFrame:
    day = F.to_date("sales_hour").alias("order_date")
    summed = sum_cells(cells, day, "province", "category")
    return summed.select("order_date", "province", "category", *_sales_columns())


def province_sales(cells: DataFrame) -> DataFrame:
    return sum_cells(cells, "province").select("province", *_sales_columns())


def sales_velocity(cells: DataFrame) -> DataFrame:
    return sum_cells(cells, "sales_hour", "province").select(
        "sales_hour",
        "province",
        F.col("orders").alias("orders_per_hour"),
        _revenue().alias("revenue_per_hour_vnd"),
    )
