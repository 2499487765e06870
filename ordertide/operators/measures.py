"""Dashboard tables over the marts: measures, geography, ranking, matrix and outlook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertide.functions import money
from ordertide.plans.settings import scratch_path
from ordertide.sinks.files import write_table


def _measure_columns() -> list:
    revenue, orders = money.total(F.col("revenue_vnd")), F.sum("orders")
    return [
        revenue.alias("revenue"),
        orders.alias("orders"),
        F.sum("units").alias("units"),
        # A ratio of sums, not a mean of the mart's averages; NULL without orders.
        F.try_divide(revenue, orders).alias("average_order_value"),
    ]


def slice_mart(
    mart: DataFrame,
    categories: Sequence[str] | None = None,
    provinces: Sequence[str] | None = None,
) -> DataFrame:
    """Dashboard slicers: keep the chosen categories and provinces."""
    if categories is not None:
        mart = mart.filter(F.col("category").isin(*categories))
    if provinces is not None:
        mart = mart.filter(F.col("province").isin(*provinces))
    return mart


def measures(daily: DataFrame, *by: str) -> DataFrame:
    """Revenue, orders, units and average order value in one context."""
    return daily.groupBy(*by).agg(*_measure_columns())


def measures_cube(daily: DataFrame, *dimensions: str) -> DataFrame:
    """The measures in every context over ``dimensions``; ``context`` is the grouping id."""
    context = F.grouping_id(*dimensions).cast("int").alias("context")
    return daily.cube(*dimensions).agg(context, *_measure_columns())


def with_geography(mart: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the province dimension many-to-one; provinces it does not list keep NULLs.

    Spark broadcasts the dimension only while it is below the broadcast threshold.
    """
    return mart.join(dimension, "province", "left")


def value_ranks(values: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(value, rank) of every distinct value of ``column``, the largest first, NULL last.

    Equal values are counted together before anything is sorted, so a value of a third of all rows is one row.
    Distinct values are dealt into ``parts`` ranges, each range counts ahead of its own values, and the totals of
    the ranges, one number each, say how many rows lie in the ranges before. No task sees more than one range.
    """
    spark = values.sparkSession
    counted = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, F.desc("value")).withColumn("part", F.spark_partition_id())
    ranged = write_table(ranged, scratch_path(spark, "ranks"))
    totals = dict(ranged.groupBy("part").agg(F.sum("rows")).collect())
    before = [sum(totals.get(p, 0) for p in range(part)) for part in range(max(totals, default=-1) + 1)]
    ahead = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("part"))
    earlier = Window.partitionBy("part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    rank = ahead + F.coalesce(F.sum("rows").over(earlier), F.lit(0)) + 1
    return ranged.select("value", rank.alias("rank"))


def ranked_provinces(provinces: DataFrame, top: int | None = None) -> DataFrame:
    """Provinces by revenue, equal revenue sharing a rank; ``top`` keeps the best ranks.

    The best ranks come from the ``top`` largest revenues, which Spark finds without a global sort:
    a revenue has as many ahead of it as there are larger ones among them. All ranks come from ranges of
    revenues, so a mart of any size is ranked without sorting it in one task.
    """
    same = F.col("revenue_vnd").eqNullSafe(F.col("value"))
    if top is None:
        # Ranks and rows both read the mart: it is computed once.
        provinces = write_table(provinces, scratch_path(provinces.sparkSession, "provinces"))
        ranks = value_ranks(provinces, "revenue_vnd")
        return provinces.join(ranks, same).select(
            *provinces.columns, F.col("rank").cast("int").alias("revenue_rank")
        )
    largest = provinces.select(F.struct("revenue_vnd").alias("r")).orderBy(F.desc("r")).limit(top)
    ahead = largest.agg(F.sort_array(F.collect_list("r"), asc=False).alias("all"))
    ranks = (
        ahead.select(F.posexplode("all").alias("position", "r"))
        .groupBy(F.col("r.revenue_vnd").alias("value"))
        .agg((F.min("position") + 1).alias("revenue_rank"))
    )
    return provinces.join(ranks, same).drop("value")


def category_matrix(daily: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Province rows, one revenue column per category of the closed domain."""
    return (
        daily.groupBy("province")
        .pivot("category", list(categories))
        .agg(money.total(F.col("revenue_vnd")))
    )


def outlook_series(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Historical daily revenue followed by the forecast, told apart by ``kind``."""
    past = history.select(
        F.col("order_date").alias("date"), "revenue_vnd", F.lit("history").alias("kind")
    )
    future = forecast.select(
        F.col("forecast_date").cast("date").alias("date"),
        F.col("forecast_revenue_vnd").alias("revenue_vnd"),
        F.lit("forecast").alias("kind"),
    )
    return past.unionByName(future)
