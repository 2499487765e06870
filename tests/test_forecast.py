"""The forecast against a plain statement of its formulas."""

from datetime import date, timedelta

import numpy as np
import pytest

from ordertide.operators import forecast as fc

MONDAY = date(2025, 1, 6)
DDL = "order_date date, province string, revenue_vnd double"


def expected(sales: dict[date, float], horizon: int = 7) -> list[tuple[str, float, int]]:
    first, last = min(sales), max(sales)
    days = [first + timedelta(n) for n in range((last - first).days + 1)]
    y = np.array([sales.get(day, 0.0) for day in days])
    x = np.arange(len(y))
    if len(y) > 1:
        design = np.vstack([x, np.ones(len(y))]).T
        slope, intercept = np.linalg.lstsq(design, y, rcond=None)[0]
    else:
        slope, intercept = 0.0, y[0]
    floor = max(y.mean(), 1.0)
    out = []
    for step in range(1, horizon + 1):
        day = last + timedelta(step)
        seen = [v for d, v in zip(days, y) if d.weekday() == day.weekday()]
        factor = np.mean(seen) / floor if seen else 1.0
        level = intercept + slope * (len(y) - 1 + step)
        out.append((day.isoformat(), round(max(0.0, level * factor), 2), len(y)))
    return out


def daily(spark, sales, province="Ha Noi"):
    return spark.createDataFrame([(d, province, v) for d, v in sales.items()], DDL)


SERIES = {
    "five weeks": {MONDAY + timedelta(n): 1000.0 + 37 * n + 250 * (n % 7) for n in range(35)},
    "gaps": {MONDAY + timedelta(n): 500.0 + 11 * n for n in range(0, 30, 4)},
    "one day": {MONDAY: 750.5},
    "three days": {MONDAY + timedelta(n): 100.0 * (n + 1) for n in range(3)},
    "falling to the floor": {MONDAY + timedelta(n): 900.0 - 100 * n for n in range(10)},
    "tiny mean": {MONDAY + timedelta(n): 0.2 for n in range(9)},
}


@pytest.mark.parametrize("name", SERIES)
def test_forecast_matches_the_formulas(spark, name):
    rows = fc.sales_forecast(daily(spark, SERIES[name])).collect()
    got = [(r["forecast_date"], r["forecast_revenue_vnd"], r["training_days"]) for r in rows]
    for mine, plain in zip(sorted(got), expected(SERIES[name]), strict=True):
        assert (mine[0], mine[2]) == (plain[0], plain[2])
        assert mine[1] == pytest.approx(plain[1], abs=0.011)
    assert {r["model"] for r in rows} == {"linear_trend_weekday_seasonality"}


def test_one_day_is_flat_and_unseen_weekdays_keep_the_trend(spark):
    rows = fc.sales_forecast(daily(spark, SERIES["one day"])).collect()
    assert [r["forecast_revenue_vnd"] for r in rows] == [750.5] * 7


def test_gaps_are_filled_with_zero(spark):
    sales = {MONDAY: 5.0, MONDAY + timedelta(3): 7.0}
    series = fc.dense_daily_series(fc.daily_revenue(daily(spark, sales)))
    rows = series.orderBy("order_date").collect()
    assert [(r["day_index"], r["revenue_vnd"]) for r in rows] == [
        (0, 5.0), (1, 0.0), (2, 0.0), (3, 7.0),
    ]


def test_series_are_fitted_apart(spark):
    a, b = SERIES["five weeks"], SERIES["gaps"]
    both = daily(spark, a, "A").unionByName(daily(spark, b, None))
    rows = fc.sales_forecast(both, by=["province"]).collect()
    for province, sales in (("A", a), (None, b)):
        got = sorted(
            (r["forecast_date"], r["forecast_revenue_vnd"]) for r in rows if r["province"] == province
        )
        assert got == [(d, pytest.approx(v, abs=0.011)) for d, v, _ in expected(sales)]


def test_horizon_is_a_parameter(spark):
    assert fc.sales_forecast(daily(spark, SERIES["gaps"]), horizon=14).count() == 14


def test_no_history_gives_no_rows(spark):
    empty = spark.createDataFrame([], DDL)
    assert fc.sales_forecast(empty).count() == 0
    assert fc.sales_forecast(empty, by=["province"]).count() == 0


def test_moments_of_batches_add_up_to_the_fit(spark):
    """Batches of a daily mart, changes that take back what an earlier batch brought, several series."""
    rows = [(d, name, v) for name, sales in SERIES.items() for d, v in sales.items()]
    late = [(d, name, v / 7) for d, name, v in rows[::3]]
    wrong = [(d, name, 99.5) for d, name, _ in rows[1::5]]
    batches = [rows[::2], rows[1::2], wrong, late, [(d, name, -v) for d, name, v in wrong]]
    by = ["province"]
    moments = None
    for batch in batches:
        part = fc.series_moments(spark.createDataFrame(batch, DDL), by)
        moments = part if moments is None else fc.merge_moments(moments.unionByName(part), by)
    found = {r.province: r for r in fc.fit_moments(moments, by).collect()}
    mart = spark.createDataFrame(rows + late, DDL)
    fitted = fc.fit_trend(fc.dense_daily_series(fc.daily_revenue(mart, by), by), by)
    for want in fitted.collect():
        got = found[want.province]
        assert got.training_days == want.training_days and got.last_date == want.last_date
        assert [got.slope, got.intercept, got.mean_revenue] == pytest.approx(
            [want.slope, want.intercept, want.mean_revenue], rel=1e-9, abs=1e-6
        )
        for a, b in zip(got.weekday_means, want.weekday_means, strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))


def test_moments_of_nothing_and_of_values_beyond_decimals(spark):
    assert fc.fit_moments(fc.series_moments(spark.createDataFrame([], DDL), ["province"]), ["province"]).count() == 0
    odd = spark.createDataFrame([(MONDAY, "a", 1e30), (MONDAY + timedelta(1), "a", 2.5), (None, "a", 7.0)], DDL)
    fit = fc.fit_moments(fc.series_moments(odd)).first()
    assert fit.mean_revenue == pytest.approx(5e29) and fit.training_days == 2
