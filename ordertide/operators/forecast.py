"""Linear trend times weekday seasonality, fitted for one series or for many at once.

Every function takes ``by``: the columns that tell series apart. ``by=()`` is one global series.
Fitting is a single grouped aggregate, so thousands of series fit in parallel and nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.contract import FORECAST_HORIZON, FORECAST_MODEL
from ordertide.functions import money


def daily_revenue(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue per series and date, from the daily mart."""
    return daily.groupBy(*by, "order_date").agg(
        money.total(F.col("revenue_vnd")).alias("revenue_vnd")
    )


def series_bounds(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return history.groupBy(*by).agg(
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        F.count("order_date").alias("sales_days"),
    )


def dense_daily_series(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every calendar day between a series' first and last date, 0.0 where nothing was sold.

    ``day_index`` counts from 0. Rows without a date are not part of any calendar.
    """
    days = F.sequence("first_date", "last_date", F.expr("interval 1 day"))
    calendar = series_bounds(history, by).select(
        *by, "first_date", F.explode(days).alias("order_date")
    )
    c, h = calendar.alias("c"), history.alias("h")
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"h.{name}")) for name in by]
    on = reduce(Column.__and__, same, F.col("c.order_date") == F.col("h.order_date"))
    return c.join(h, on, "left").select(
        *(F.col(f"c.{name}") for name in by),
        F.col("c.order_date"),
        F.datediff("c.order_date", "c.first_date").alias("day_index"),
        F.coalesce("h.revenue_vnd", F.lit(0.0)).alias("revenue_vnd"),
    )


def fit_trend(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series: trend line, mean and the mean of each weekday (Monday first).

    A one-day series has no slope; its trend is flat at that day's value.
    """
    y, x = F.col("revenue_vnd"), F.col("day_index")
    weekday = F.weekday("order_date")
    return series.groupBy(*by).agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"),
        F.avg(y).alias("mean_revenue"),
        F.count("*").alias("training_days"),
        F.max("order_date").alias("last_date"),
        F.array(*(F.avg(F.when(weekday == d, y)) for d in range(7))).alias("weekday_means"),
    )


# --- moments: a fit that batches add up to --------------------------------------------------------

MOMENTS = ("total", "weighted", *(f"weekday_{d}" for d in range(7)))


def series_moments(revenue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics of the trend and weekday fit, one row per series.

    ``revenue`` has dates and revenues, any number of rows a date (of the daily mart, or of changes to it: a row
    that left counts negative). Dates without a row are zeros and add nothing, so only sums over rows are kept:
    revenue, revenue times the day's number since 1970, revenue per weekday, all as exact decimals, and the
    first and last date. Revenues that no decimal holds travel as doubles.
    """
    y = F.col("revenue_vnd")
    day, weekday = F.unix_date("order_date"), F.weekday("order_date")
    parts = {"total": F.lit(1), "weighted": day} | {
        f"weekday_{d}": F.when(weekday == d, F.lit(1)) for d in range(7)
    }
    dated = revenue.filter("order_date IS NOT NULL")
    return dated.groupBy(*by).agg(
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        *(money.exact_sum(y, factor).alias(name) for name, factor in parts.items()),
        *(money.stray_sum(y, factor).alias(f"{name}_stray") for name, factor in parts.items()),
    )


def merge_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of several batches added up. A first or last date whose sales all left must be set anew."""
    return moments.groupBy(*by).agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        *(F.sum(name).cast(money.AMOUNT_TYPE).alias(name) for name in MOMENTS),
        *(F.sum(f"{name}_stray").alias(f"{name}_stray") for name in MOMENTS),
    )


def fit_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same fit as `fit_trend` of the dense series, from moments alone.

    Sums over day indexes 0..n-1 are closed forms; shifting day numbers to indexes is one subtraction.
    """

    def sum_of(name: str) -> Column:
        return money.joined_sum(F.col(name), F.col(f"{name}_stray"))

    n = (F.datediff("last_date", "first_date") + 1).cast("double")
    first = F.unix_date("first_date")
    exact = F.col("weighted") - F.col("total") * first
    strays = F.col("weighted_stray") - F.coalesce("total_stray", F.lit(0.0)) * first
    weighted, total = money.joined_sum(exact, strays), sum_of("total")
    days = n * (n - 1) / 2
    squares = (n - 1) * n * (2 * n - 1) / 6
    slope = F.coalesce(F.try_divide(n * weighted - days * total, n * squares - days * days), F.lit(0.0))
    whole, rest = F.floor(n / 7), n % 7
    means = []
    for d in range(7):
        after = F.pmod(F.lit(d) - F.weekday("first_date"), F.lit(7))
        seen = whole + F.when(after < rest, 1).otherwise(0)
        means.append(F.when(seen > 0, sum_of(f"weekday_{d}") / seen))
    return moments.select(
        *by,
        slope.alias("slope"),
        ((total - slope * days) / n).alias("intercept"),
        (total / n).alias("mean_revenue"),
        n.cast("long").alias("training_days"),
        "last_date",
        F.array(*means).alias("weekday_means"),
    )


def _floored_mean() -> Column:
    return F.greatest(F.col("mean_revenue"), F.lit(1.0))


def weekday_factors(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weekday mean over overall mean, one row per weekday seen (Monday is 0)."""
    return (
        trend.select(*by, "mean_revenue", F.posexplode("weekday_means").alias("weekday", "day_mean"))
        .filter("day_mean IS NOT NULL")
        .select(*by, "weekday", (F.col("day_mean") / _floored_mean()).alias("factor"))
    )


def project_trend(
    trend: DataFrame, horizon: int = FORECAST_HORIZON, by: Sequence[str] = ()
) -> DataFrame:
    """Future rows of every fitted series; a weekday never seen keeps the bare trend."""
    steps = trend.filter("training_days > 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    )
    future = F.date_add("last_date", F.col("step"))
    level = F.col("intercept") + F.col("slope") * (F.col("training_days") - 1 + F.col("step"))
    factor = F.coalesce(
        F.get("weekday_means", F.weekday(future)) / _floored_mean(), F.lit(1.0)
    )
    return steps.select(
        *by,
        future.cast("string").alias("forecast_date"),
        F.round(F.greatest(F.lit(0.0), level * factor), 2).alias("forecast_revenue_vnd"),
        F.lit(FORECAST_MODEL).alias("model"),
        "training_days",
    )


def sales_forecast(
    daily: DataFrame, horizon: int = FORECAST_HORIZON, by: Sequence[str] = ()
) -> DataFrame:
    """Forecast the next ``horizon`` days of the daily mart's revenue."""
    series = dense_daily_series(daily_revenue(daily, by), by)
    return project_trend(fit_trend(series, by), horizon, by)
