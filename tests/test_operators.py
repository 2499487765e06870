"""Golden cases for resolution, classification and marts."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from events import as_dicts, event, frame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ordertide.contract import DEFAULT_CONTRACT
from ordertide.operators import marts, measures, quality, reconcile, resolve
from ordertide.plans.bucketed import changed_winners


def classify(spark, rows):
    return quality.classify_events(resolve.dedup_latest_event(frame(spark, rows)))


def state(spark, rows):
    return resolve.current_order_state(quality.accepted_events(classify(spark, rows)))


def cells(spark, rows):
    return marts.order_cells(resolve.active_orders(state(spark, rows)))


def test_latest_copy_is_judged_even_if_an_older_one_was_good(spark):
    rows = [
        event("e1", ingest_ts="2025-01-06T10:00:01+00:00"),
        event("e1", ingest_ts="2025-01-06T10:00:09+00:00", quantity=0),
    ]
    classified = classify(spark, rows)
    assert quality.accepted_events(classified).count() == 0
    assert [r["rejection_reason"] for r in as_dicts(quality.rejected_events(classified))] == [
        "non_positive_quantity"
    ]


def test_first_broken_rule_names_the_rejection(spark):
    bad = {"unit_price_vnd": -1.0, "province": "UNKNOWN", "event_type": "returned"}
    rows = [
        event("e1", quantity=0, **bad),
        event("e2", **bad),
        event("e3", province="UNKNOWN", event_type="returned"),
        event("e4", event_type="returned"),
    ]
    reasons = {r["event_id"]: r["rejection_reason"] for r in as_dicts(classify(spark, rows))}
    assert reasons == {
        "e1": "non_positive_quantity",
        "e2": "non_positive_price",
        "e3": "unknown_province",
        "e4": "unknown_event_type",
    }


@pytest.mark.parametrize("field", ["quantity", "unit_price_vnd", "province", "event_type"])
def test_null_passes_every_rule(spark, field):
    assert quality.accepted_events(classify(spark, [event("e1", **{field: None})])).count() == 1


def test_nan_price_passes_and_reaches_the_revenue(spark):
    rows = [
        event("e1", unit_price_vnd=float("nan")),
        event("e2", order_id="O2"),
        event("e3", order_id="O3", province="Da Nang"),
    ]
    by_province = {r["province"]: r for r in as_dicts(marts.province_sales(cells(spark, rows)))}
    assert str(by_province["Ha Noi"]["revenue_vnd"]) == "nan"
    assert by_province["Da Nang"]["revenue_vnd"] == 200.0


def test_price_beyond_the_decimal_range_is_kept(spark):
    rows = [event("e1", quantity=1, unit_price_vnd=1e15), event("e2", order_id="O2")]
    (row,) = as_dicts(marts.province_sales(cells(spark, rows)))
    assert row["revenue_vnd"] == 1e15 + 200.0
    assert row["average_order_value_vnd"] == (1e15 + 200.0) / 2


def test_null_event_ids_form_one_group(spark):
    rows = [event(None, order_id="O1"), event(None, order_id="O2"), event("e1", order_id="O3")]
    assert resolve.dedup_latest_event(frame(spark, rows)).count() == 2


@pytest.mark.parametrize("shuffled", [False, True])
def test_update_after_cancel_reactivates_whatever_the_arrival_order(spark, shuffled):
    rows = [
        event("e2", event_type="cancelled", event_ts="2025-01-06T10:00:00+00:00"),
        event("e3", event_type="updated", event_ts="2025-01-06T11:00:00+00:00", quantity=5),
    ]
    (row,) = as_dicts(resolve.active_orders(state(spark, rows[::-1] if shuffled else rows)))
    assert (row["event_type"], row["quantity"], row["revenue_vnd"]) == ("updated", 5, 500.0)


def test_update_before_create_in_event_time_loses(spark):
    rows = [
        event("e1", event_ts="2025-01-06T12:00:00+00:00"),
        event("e2", event_type="updated", event_ts="2025-01-06T11:00:00+00:00"),
    ]
    assert [r["event_id"] for r in as_dicts(state(spark, rows))] == ["e1"]


def test_state_ties_fall_to_ingest_time_then_event_id(spark):
    same = {"event_ts": "2025-01-06T10:00:00+00:00"}
    rows = [
        event("e1", ingest_ts="2025-01-06T10:00:09+00:00", **same),
        event("e9", ingest_ts="2025-01-06T10:00:01+00:00", **same),
        event("e3", order_id="O2", ingest_ts="2025-01-06T10:00:05+00:00", **same),
        event("e4", order_id="O2", ingest_ts="2025-01-06T10:00:05+00:00", **same),
    ]
    winners = {r["order_id"]: r["event_id"] for r in as_dicts(state(spark, rows))}
    assert winners == {"O1": "e1", "O2": "e4"}


def test_copies_with_equal_clocks_resolve_the_same_way_in_any_order(spark):
    rows = [event("e1", quantity=n, customer_id=f"C{n % 3}") for n in range(1, 9)]
    picks = {
        tuple(as_dicts(resolve.dedup_latest_event(frame(spark, order).repartition(n)))[0].values())
        for n, order in ((1, rows), (3, rows[::-1]), (7, rows[3:] + rows[:3]))
    }
    assert len(picks) == 1


def test_latest_event_moves_the_order_to_its_new_group(spark):
    rows = [
        event("e1"),
        event(
            "e2", event_type="updated", province="Da Nang", event_ts="2025-01-08T09:30:00+00:00"
        ),
    ]
    (row,) = as_dicts(marts.daily_sales(cells(spark, rows)))
    assert (row["order_date"], row["province"]) == (date(2025, 1, 8), "Da Nang")


def test_rejected_latest_event_leaves_the_older_accepted_one(spark):
    rows = [event("e1"), event("e2", quantity=-1, event_ts="2025-01-07T10:00:00+00:00")]
    assert [r["event_id"] for r in as_dicts(state(spark, rows))] == ["e1"]


def test_null_event_type_is_neither_active_nor_cancelled(spark):
    current = state(spark, [event("e1", event_type=None), event("e2", order_id="O2")])
    assert as_dicts(current.agg(*reconcile.state_columns())) == [
        {"current": 2, "active": 1, "cancelled": 0}
    ]


def test_event_date_is_the_utc_date(spark):
    (row,) = as_dicts(state(spark, [event("e1", event_ts="2025-01-06T23:30:00-05:00")]))
    assert row["order_date"] == date(2025, 1, 7)


def test_average_of_a_half_cent_rounds_up(spark):
    rows = [
        event("e1", quantity=1, unit_price_vnd=1_170_682.62),
        event("e2", order_id="O2", quantity=1, unit_price_vnd=0.01),
    ]
    (row,) = as_dicts(marts.province_sales(cells(spark, rows)))
    assert (row["revenue_vnd"], row["average_order_value_vnd"]) == (1_170_682.63, 585_341.32)


def test_sums_keep_fractions_of_a_cent_until_the_end(spark):
    rows = [event(f"e{n}", order_id=f"O{n}", quantity=1, unit_price_vnd=0.004) for n in range(5)]
    (row,) = as_dicts(marts.province_sales(cells(spark, rows)))
    assert (row["revenue_vnd"], row["average_order_value_vnd"]) == (0.02, 0.0)


def test_marts_do_not_depend_on_partitioning(spark):
    rows = [
        event(f"e{n}", order_id=f"O{n}", quantity=1 + n % 7, unit_price_vnd=0.1 + n * 1234.57)
        for n in range(300)
    ]
    orders = cells(spark, rows)
    results = {repr(as_dicts(marts.province_sales(orders.repartition(n)))) for n in (1, 3, 7)}
    assert len(results) == 1


def test_null_quantity_gives_null_sums_but_counts_the_order(spark):
    (row,) = as_dicts(marts.province_sales(cells(spark, [event("e1", quantity=None)])))
    assert row == {
        "province": "Ha Noi",
        "orders": 1,
        "units": None,
        "revenue_vnd": None,
        "average_order_value_vnd": None,
    }


def test_null_order_id_adds_revenue_but_no_order(spark):
    (row,) = as_dicts(marts.province_sales(cells(spark, [event("e1", order_id=None), event("e2")])))
    assert (row["orders"], row["units"], row["revenue_vnd"]) == (1, 4, 400.0)


def test_velocity_groups_by_hour(spark):
    rows = [
        event("e1", event_ts="2025-01-06T10:59:59+00:00"),
        event("e2", order_id="O2", event_ts="2025-01-06T10:00:00+00:00"),
        event("e3", order_id="O3", event_ts="2025-01-06T11:00:00+00:00"),
    ]
    hourly = {
        r["sales_hour"]: (r["orders_per_hour"], r["revenue_per_hour_vnd"])
        for r in as_dicts(marts.sales_velocity(cells(spark, rows)))
    }
    assert hourly == {datetime(2025, 1, 6, 10): (2, 400.0), datetime(2025, 1, 6, 11): (1, 200.0)}


def test_marts_from_summed_cells_equal_marts_from_orders(spark):
    rows = [
        event(
            f"e{n}",
            order_id=f"O{n}",
            category="Home" if n % 2 else "Beauty",
            event_ts=f"2025-01-{6 + n % 3:02d}T{n % 24:02d}:15:00+00:00",
            unit_price_vnd=n + 0.01,
        )
        for n in range(60)
    ]
    orders = resolve.active_orders(state(spark, rows))
    for mart in (marts.daily_sales, marts.province_sales, marts.sales_velocity):
        one_step = mart(marts.order_cells(orders)).collect()
        assert sorted(map(repr, one_step)) == sorted(
            map(repr, mart(marts.sales_cells(orders)).collect())
        )


def test_unknown_values_against_a_domain_table(spark):
    rows = [event("e1"), event("e2", province="X"), event("e3", province=None)]
    domain = spark.createDataFrame([("Ha Noi",), ("Ha Noi",), ("Da Nang",)], "name string")
    result = quality.classify_against_tables(frame(spark, rows), DEFAULT_CONTRACT, domain)
    assert {r["event_id"]: r["rejection_reason"] for r in as_dicts(result)} == {
        "e1": None,
        "e2": "unknown_province",
        "e3": None,
    }


def test_required_field_violations(spark):
    rows = [event("e1", quantity=None), event(None, quantity=None), event("e3")]
    found = {
        r["field"]: r["null_rows"]
        for r in as_dicts(quality.required_field_violations(frame(spark, rows)))
        if r["null_rows"]
    }
    assert found == {"event_id": 1, "quantity": 2}


def test_measures_use_a_ratio_of_sums(spark):
    daily = spark.createDataFrame(
        [("A", "x", 1, 1, 10.0, 10.0), ("A", "y", 3, 3, 90.0, 30.0), ("B", "x", 0, 0, 0.0, None)],
        "province string, category string, orders long, units long, revenue_vnd double,"
        " average_order_value_vnd double",
    )
    by_province = {r["province"]: r for r in as_dicts(measures.measures(daily, "province"))}
    assert by_province["A"]["average_order_value"] == 25.0
    assert by_province["B"]["average_order_value"] is None
    assert as_dicts(measures.measures(measures.slice_mart(daily, ["y"], ["A"])))[0]["revenue"] == 90


def test_ranked_provinces_share_ranks(spark):
    mart = spark.createDataFrame(
        [("A", 5.0), ("B", 9.0), ("C", 5.0), ("D", 1.0)], "province string, revenue_vnd double"
    )
    ranks = {r["province"]: r["revenue_rank"] for r in as_dicts(measures.ranked_provinces(mart))}
    assert ranks == {"B": 1, "A": 2, "C": 2, "D": 4}
    assert measures.ranked_provinces(mart, top=2).count() == 3


def test_top_provinces_with_ties_and_nulls(spark):
    rows = [(f"p{i}", None if i % 9 == 0 else float(i % 7)) for i in range(60)] + [("n", float("nan"))]
    mart = spark.createDataFrame(rows, "province string, revenue_vnd double")
    every = measures.ranked_provinces(mart)
    for top in (1, 5, 9, 60, 100):
        best = measures.ranked_provinces(mart, top=top)
        want = every.filter(F.col("revenue_rank") <= top)
        assert sorted(map(repr, best.collect())) == sorted(map(repr, want.collect()))
    assert measures.ranked_provinces(mart.limit(0), top=3).count() == 0
    window = F.rank().over(Window.orderBy(F.desc("revenue_vnd")))
    expected = mart.withColumn("revenue_rank", window)
    assert sorted(map(repr, every.collect())) == sorted(map(repr, expected.collect()))
    assert measures.ranked_provinces(mart.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks_of_many_values_are_exact(spark, parts):
    """A third of all rows share one value, which is one row before anything is sorted."""
    mart = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7).alias("v")
    )
    ranks = measures.value_ranks(mart, "v", parts).toPandas().sort_values("value", ascending=False)
    counts = mart.groupBy("v").count().toPandas().sort_values("v", ascending=False)
    assert (ranks["value"].to_numpy() == counts["v"].to_numpy()).all()
    assert (ranks["rank"].to_numpy() == counts["count"].cumsum().to_numpy() - counts["count"].to_numpy() + 1).all()


@pytest.mark.parametrize(
    ("price", "revenue"),
    [
        (4e-9, 8.0),
        (0.123456784, 246_913_568.0),
        (12345.678901234567, 24_691_357_802_469.13),
        (1e13, 2e22),
        (0.1, 200_000_000.0),
    ],
)
def test_no_digit_of_a_price_is_lost(spark, price, revenue):
    rows = [event("e1", quantity=2_000_000_000, unit_price_vnd=price), event("e2", order_id="O2")]
    mart = marts.province_sales(marts.sales_cells(resolve.active_orders(state(spark, rows[:1]))))
    (row,) = as_dicts(mart)
    assert row["revenue_vnd"] == pytest.approx(revenue, rel=1e-15)
    both = as_dicts(marts.province_sales(cells(spark, rows)))[0]
    assert both["revenue_vnd"] == pytest.approx(revenue + 200.0, rel=1e-15)


def test_copies_are_counted_while_they_are_collapsed(spark):
    rows = [event(None if i % 7 == 0 else f"e{i % 5}", quantity=i % 4 + 1) for i in range(100)]
    events = frame(spark, rows).withColumn("source_file", F.lit("a"))
    counted = resolve.dedup_counting_copies(events)
    plain = resolve.dedup_latest_event(events)
    assert counted.columns == [*plain.columns, "copies"]
    assert sorted(map(repr, counted.drop("copies").collect())) == sorted(map(repr, plain.collect()))
    assert counted.agg(F.sum("copies")).first()[0] == 100


def test_exact_amounts_are_decimals(spark):
    (row,) = as_dicts(
        cells(spark, [event("e1", quantity=3, unit_price_vnd=0.1)]).select(
            "amount", F.col("stray")
        )
    )
    assert row == {"amount": Decimal("0.30000000"), "stray": None}


def test_history_is_only_beaten_by_newer_rows(spark):
    """Also the row of the NULL key; an exact copy is no change."""
    later = {"ingest_ts": "2025-02-01T00:00:00+00:00"}
    history = resolve.dedup_latest_event(frame(spark, [event("e1"), event("e2", **later), event(None), event("e4")]))
    arrived = frame(spark, [event("e1", **later), event("e2"), event(None, **later), event("e3"), event("e4")])
    changed = changed_winners(history, arrived).collect()
    assert sorted(r.event_id or "" for r in changed) == ["", "e1", "e3"]
    nothing = frame(spark, [event("e4"), event(None)])
    assert changed_winners(history, nothing).isEmpty()
