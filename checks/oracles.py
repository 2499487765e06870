"""DuckDB SQL for the registered queries.

Money is added as integer cents here, which is exact for the test prices (two decimals), and as
doubles where prices have more digits.
"""

from __future__ import annotations

LINEITEM = """
bronze AS (
  SELECT *, event_ts + to_seconds(CAST(product_id AS BIGINT) % 120 + 1) AS ingest_ts
  FROM (
    SELECT concat(l_orderkey, '-', l_linenumber) AS event_id,
           CAST(l_orderkey AS VARCHAR) AS order_id,
           CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(l_partkey AS VARCHAR) AS product_id,
           p_type AS category,
           n_name AS province,
           CAST(l_quantity AS INTEGER) - 1 AS quantity,
           round(l_extendedprice - 1000.0, 2) AS unit_price_vnd,
           CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 'returned'
                WHEN l_returnflag = 'N' THEN 'created'
                WHEN l_returnflag = 'A' THEN 'updated'
                ELSE 'cancelled' END AS event_type,
           l_shipdate + to_hours(l_partkey % 24) + to_minutes(l_suppkey % 60) AS event_ts
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey)
)"""

ACTIVITY = """
bronze AS (
  SELECT concat('E', CASE WHEN event_id % 50 = 0 AND event_id > 0 THEN event_id - 1
                          ELSE event_id END) AS event_id,
         concat('O', event_id % 4000) AS order_id,
         concat('C', user_id) AS customer_id,
         concat('P', k) AS product_id,
         concat('CAT_', k % 6) AS category,
         concat('PROV_', user_id % 13) AS province,
         k % 20 AS quantity,
         value AS unit_price_vnd,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'created'
              WHEN event_type = 'click' THEN 'updated'
              WHEN event_type = 'error' THEN 'cancelled'
              ELSE event_type END AS event_type,
         ts AS event_ts,
         ts + to_seconds(event_id % 120 + 1) AS ingest_ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def _chain(known_province: str) -> str:
    """CTEs from ``bronze`` to the forecast."""
    return f""",
deduped AS (
  SELECT * FROM bronze
  QUALIFY row_number() OVER (
    PARTITION BY event_id
    ORDER BY ingest_ts DESC, event_ts DESC, order_id DESC, customer_id DESC, product_id DESC,
             category DESC, province DESC, quantity DESC, unit_price_vnd DESC, event_type DESC) = 1
),
classified AS (
  SELECT *, CASE WHEN quantity <= 0 THEN 'non_positive_quantity'
                 WHEN unit_price_vnd <= 0 THEN 'non_positive_price'
                 WHEN NOT ({known_province}) THEN 'unknown_province'
                 WHEN event_type NOT IN ('created', 'updated', 'cancelled')
                   THEN 'unknown_event_type' END AS rejection_reason
  FROM deduped
),
accepted AS (
  SELECT * EXCLUDE (rejection_reason) FROM classified WHERE rejection_reason IS NULL
),
state AS (
  SELECT *, CAST(event_ts AS DATE) AS order_date, quantity * unit_price_vnd AS revenue_vnd
  FROM accepted
  QUALIFY row_number() OVER (
    PARTITION BY order_id ORDER BY event_ts DESC, ingest_ts DESC, event_id DESC) = 1
),
active AS (
  SELECT *, CAST(round(revenue_vnd * 100) AS BIGINT) AS cents
  FROM state WHERE event_type <> 'cancelled'
),
daily AS (
  SELECT order_date, province, category, {_sales()} FROM active
  GROUP BY order_date, province, category
),
provinces AS (SELECT province, {_sales()} FROM active GROUP BY province),
velocity AS (
  SELECT date_trunc('hour', event_ts) AS sales_hour, province,
         count(DISTINCT order_id) AS orders_per_hour,
         CAST(sum(cents) AS DOUBLE) / 100 AS revenue_per_hour_vnd
  FROM active GROUP BY 1, 2
),
{_forecast("")},
{_forecast("province")}"""


def _sales() -> str:
    return """count(DISTINCT order_id) AS orders,
         CAST(sum(quantity) AS BIGINT) AS units,
         CAST(sum(cents) AS DOUBLE) / 100 AS revenue_vnd,
         CAST((2 * sum(cents) + count(*)) // (2 * count(*)) AS DOUBLE) / 100
           AS average_order_value_vnd"""


_CENTS = "CAST(sum(CAST(round(revenue_vnd * 100) AS BIGINT)) AS DOUBLE) / 100"


def _forecast(key: str) -> str:
    """Forecast CTEs, one series or one per ``key``; the names get the key as a suffix."""
    s = f"_{key}" if key else ""
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    same = f"AND h.{key} = c.{key}" if key else ""
    fit = f"AND f.{key} = t.{key}" if key else ""
    tk = f"t.{key}, " if key else ""
    ck = f"c.{key}, " if key else ""
    return f"""history{s} AS (
  SELECT {k}order_date, {_CENTS} AS revenue_vnd FROM daily GROUP BY {k}order_date
),
bounds{s} AS (
  SELECT {k}min(order_date) AS first_date, max(order_date) AS last_date,
         count(*) AS sales_days FROM history{s} {group}
),
calendar{s} AS (
  SELECT {k}first_date, CAST(unnest(generate_series(
           CAST(first_date AS TIMESTAMP), CAST(last_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
           AS order_date
  FROM bounds{s}
),
dense{s} AS (
  SELECT {ck}c.order_date, CAST(date_diff('day', first_date, c.order_date) AS INTEGER) AS day_index,
         coalesce(h.revenue_vnd, 0.0) AS revenue_vnd
  FROM calendar{s} c LEFT JOIN history{s} h ON h.order_date = c.order_date {same}
),
trend{s} AS (
  SELECT {k}coalesce(regr_slope(revenue_vnd, day_index), 0.0) AS slope,
         coalesce(regr_intercept(revenue_vnd, day_index), avg(revenue_vnd)) AS intercept,
         avg(revenue_vnd) AS mean_revenue, count(*) AS training_days,
         max(order_date) AS last_date
  FROM dense{s} {group}
),
factors{s} AS (
  SELECT {tk}CAST(weekday AS INTEGER) AS weekday,
         day_mean / greatest(mean_revenue, 1.0) AS factor
  FROM (SELECT {k}isodow(order_date) - 1 AS weekday, avg(revenue_vnd) AS day_mean
        FROM dense{s} GROUP BY {k}isodow(order_date)) f
  JOIN trend{s} t ON TRUE {fit}
),
forecast{s} AS (
  SELECT {tk}CAST(t.last_date + CAST(step AS INTEGER) AS VARCHAR) AS forecast_date,
         round(greatest(0.0, (intercept + slope * (training_days - 1 + step))
                             * coalesce(factor, 1.0)), 2) AS forecast_revenue_vnd,
         'linear_trend_weekday_seasonality' AS model, training_days
  FROM (SELECT *, unnest(generate_series(1, 7)) AS step FROM trend{s}) t
  LEFT JOIN factors{s} f
    ON f.weekday = isodow(t.last_date + CAST(step AS INTEGER)) - 1 {fit}
)"""


def _lineitem(select: str) -> str:
    return f"WITH {LINEITEM}{_chain(_LISTED_NATION)}\n{select}"


def _activity(select: str) -> str:
    return f"WITH {ACTIVITY}{_chain(_LISTED_PROV)}\n{select}"


_LISTED_NATION = "province IN (" + ", ".join(f"'NATION_{n}'" for n in range(24)) + ")"
_LISTED_PROV = "province IN (" + ", ".join(f"'PROV_{n}'" for n in range(12)) + ")"

# Sums of doubles, for prices that are no whole cents.
_MANY_DIGITS = (
    f"WITH {ACTIVITY.replace('value AS unit_price_vnd', 'value / 7 AS unit_price_vnd')}"
    + _chain(_LISTED_PROV)
    + """
SELECT province, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units,
       round(sum(revenue_vnd), 2) AS revenue_vnd,
       round(sum(revenue_vnd) / count(*), 2) AS average_order_value_vnd
FROM active GROUP BY province"""
)
# Some fields missing, by the number of the order.
_GAPS = {"quantity": 11, "unit_price_vnd": 13, "event_type": 17, "event_id": 19}
_GAPPY = ACTIVITY.replace("bronze AS", "whole AS") + (
    ", bronze AS (SELECT * REPLACE ("
    + ", ".join(
        f"CASE WHEN CAST(substr(order_id, 2) AS INTEGER) % {n} <> 0 THEN {c} END AS {c}"
        for c, n in _GAPS.items()
    )
    + ") FROM whole)"
)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _GAPS)
_EVENT_COLUMNS = (
    "event_id", "order_id", "customer_id", "product_id", "category", "province", "quantity",
    "unit_price_vnd", "event_type", "event_ts", "ingest_ts",
)
_MEASURES = f"""{_CENTS} AS revenue, CAST(sum(orders) AS BIGINT) AS orders,
  CAST(sum(units) AS BIGINT) AS units, {_CENTS} / sum(orders) AS average_order_value"""
_COUNTS = """
  SELECT (SELECT count(*) FROM bronze) AS bronze,
         (SELECT count(*) FROM deduped) AS deduplicated,
         (SELECT count(*) FROM accepted) AS accepted,
         (SELECT count(*) FROM classified WHERE rejection_reason IS NOT NULL) AS quarantined,
         (SELECT count(*) FROM state) AS "current",
         (SELECT count(*) FROM active) AS active,
         (SELECT count(*) FROM state WHERE event_type = 'cancelled') AS cancelled,
         (SELECT count(*) FROM daily) AS daily_sales,
         (SELECT count(*) FROM provinces) AS province_sales,
         (SELECT count(*) FROM velocity) AS sales_velocity,
         (SELECT count(*) FROM forecast) AS forecast_rows,
         (SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM active) AS revenue_vnd,
         (SELECT CAST(sum(n - 1) AS BIGINT) FROM
            (SELECT count(*) AS n FROM bronze GROUP BY event_id)) AS surplus_copies,
         (SELECT count(*) - count(DISTINCT event_id) FROM bronze) AS duplicates"""
_GATES = f"""SELECT bronze = deduplicated + surplus_copies AS event_occurrences_reconcile,
  deduplicated = accepted + quarantined AS classification_reconciles,
  "current" = active + cancelled AS current_state_reconciles,
  daily_sales > 0 AS daily_sales_nonempty,
  province_sales > 0 AS province_sales_nonempty,
  forecast_rows = 7 AS forecast_horizon_is_seven,
  revenue_vnd > 0 AS positive_revenue
FROM ({_COUNTS})"""
_GEO = """SELECT n_name AS province, r_name AS region
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""

# The preview judges events as they arrive; orders of odd number arrive when the watermark has moved on.
_SOLD = f"""WITH {ACTIVITY},
sold AS (
  SELECT *, CAST(substr(order_id, 2) AS INTEGER) % 2 = 0 AS first_to_arrive,
         CAST(round(quantity * unit_price_vnd * 100) AS BIGINT) AS cents
  FROM bronze
  WHERE CASE WHEN quantity <= 0 THEN 1 WHEN unit_price_vnd <= 0 THEN 1 WHEN NOT ({_LISTED_PROV}) THEN 1
             WHEN event_type NOT IN ('created', 'updated', 'cancelled') THEN 1 END IS NULL
    AND event_type <> 'cancelled'),
in_time AS (
  SELECT * FROM sold
  WHERE first_to_arrive
     OR date_trunc('hour', event_ts) + INTERVAL 1 HOUR >
        (SELECT date_trunc('millisecond', max(event_ts)) - INTERVAL 10 DAY FROM sold WHERE first_to_arrive))
"""

# What the second half of the month of arrival changes in the winners, or the orders, of the first.
_HALVES = f"""WITH {ACTIVITY.replace('bronze AS', 'whole AS')},
arrived AS (SELECT *, day(ingest_ts) > 15 AS fresh FROM whole)"""


def _changed(key: str, rows: str, recency: str, columns: str) -> str:
    return f"""{_HALVES}{rows}
SELECT {columns} FROM candidates
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {recency}, fresh) = 1 AND fresh"""


_RECENCY = (
    "ingest_ts DESC, event_ts DESC, order_id DESC, customer_id DESC, product_id DESC, category DESC,"
    " province DESC, quantity DESC, unit_price_vnd DESC, event_type DESC"
)

ORACLES: dict[str, str] = {
    "bronze_events": _lineitem("SELECT *, CAST(event_ts AS DATE) AS event_date FROM bronze"),
    "dedup_latest_event": _lineitem("SELECT * FROM deduped"),
    "classify_events": _lineitem("SELECT * FROM classified"),
    "classify_against_table": (
        f"WITH {LINEITEM}"
        + _chain("province IN (SELECT n_name FROM nation WHERE n_name <> 'NATION_24')")
        + "\nSELECT * FROM classified"
    ),
    "clean_events": _lineitem("SELECT * FROM accepted"),
    "rejected_events": _lineitem("SELECT * FROM classified WHERE rejection_reason IS NOT NULL"),
    "rejections_by_reason": _lineitem(
        "SELECT rejection_reason, count(*) AS events FROM classified"
        " WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason"
    ),
    "required_field_violations": _lineitem(
        "\nUNION ALL\n".join(
            f"SELECT '{name}' AS field, count(*) FILTER (WHERE {name} IS NULL) AS null_rows"
            " FROM bronze"
            for name in _EVENT_COLUMNS
        )
    ),
    "duplicate_event_ids": _lineitem(
        "SELECT event_id, count(*) AS copies FROM bronze GROUP BY event_id HAVING count(*) > 1"
    ),
    "event_id_uniqueness": _lineitem(
        "SELECT (SELECT count(*) FROM (SELECT event_id FROM bronze GROUP BY event_id"
        " HAVING count(*) > 1)) AS repeated_in_bronze,"
        " (SELECT count(*) FROM (SELECT event_id FROM deduped GROUP BY event_id"
        " HAVING count(*) > 1)) AS repeated_when_resolved"
    ),
    "current_order_state": _lineitem("SELECT * FROM state"),
    "active_orders": _lineitem("SELECT * EXCLUDE (cents) FROM active"),
    "cancelled_orders": _lineitem("SELECT * FROM state WHERE event_type = 'cancelled'"),
    "daily_sales": _lineitem("SELECT * FROM daily ORDER BY order_date, province, category"),
    "province_sales": _lineitem("SELECT * FROM provinces ORDER BY province"),
    "sales_velocity": _lineitem("SELECT * FROM velocity ORDER BY sales_hour, province"),
    "daily_revenue_series": _lineitem("SELECT * FROM history ORDER BY order_date"),
    "series_bounds": _lineitem("SELECT * FROM bounds"),
    "dense_daily_series": _lineitem("SELECT * FROM dense"),
    "dense_daily_series_by_province": _lineitem("SELECT * FROM dense_province"),
    "trend_fit": _lineitem(
        "SELECT round(slope, 6) AS slope, round(intercept, 3) AS intercept,"
        " round(mean_revenue, 3) AS mean_revenue, training_days, last_date FROM trend"
    ),
    "trend_fit_by_province": _lineitem(
        "SELECT province, round(slope, 6) AS slope, round(intercept, 3) AS intercept,"
        " round(mean_revenue, 3) AS mean_revenue, training_days, last_date FROM trend_province"
    ),
    "weekday_factors": _lineitem("SELECT weekday, round(factor, 9) AS factor FROM factors"),
    "sales_forecast": _lineitem("SELECT * FROM forecast"),
    "sales_forecast_by_province": _lineitem("SELECT * FROM forecast_province"),
    "trend_fit_from_moments": _lineitem(
        "SELECT round(slope, 6) AS slope, round(intercept, 3) AS intercept,"
        " round(mean_revenue, 3) AS mean_revenue, training_days, last_date FROM trend"
    ),
    "weekday_factors_from_moments": _lineitem(
        "SELECT weekday, round(factor, 9) AS factor FROM factors"
    ),
    "sales_forecast_from_moments": _lineitem("SELECT * FROM forecast_province"),
    "quality_counts": _lineitem(_COUNTS),
    "release_gates": _lineitem(_GATES),
    "measures_total": _lineitem(f"SELECT {_MEASURES} FROM daily"),
    "measures_by_category": _lineitem(f"SELECT category, {_MEASURES} FROM daily GROUP BY category"),
    "measures_sliced": _lineitem(
        f"SELECT order_date, {_MEASURES} FROM daily WHERE category IN ('ECONOMY', 'PROMO')"
        " GROUP BY order_date"
    ),
    "measures_cube": _lineitem(
        f"SELECT province, category, CAST(grouping(province, category) AS INTEGER) AS context,"
        f" {_MEASURES} FROM daily GROUP BY CUBE (province, category)"
    ),
    "province_geo": _lineitem(f"SELECT * FROM provinces LEFT JOIN ({_GEO}) g USING (province)"),
    "daily_sales_geo": _lineitem(f"SELECT * FROM daily LEFT JOIN ({_GEO}) g USING (province)"),
    "province_map": _lineitem(
        "SELECT * FROM provinces LEFT JOIN (SELECT n_name AS province,"
        " CAST(n_nationkey AS DOUBLE) / 2 AS latitude,"
        " 100 + CAST(n_regionkey AS DOUBLE) * 1.5 AS longitude FROM nation) USING (province)"
    ),
    "ranked_provinces": _lineitem(
        "SELECT *, CAST(rank() OVER (ORDER BY revenue_vnd DESC) AS INTEGER) AS revenue_rank"
        " FROM provinces"
    ),
    "top_provinces": _lineitem(
        "SELECT *, CAST(rank() OVER (ORDER BY revenue_vnd DESC) AS INTEGER) AS revenue_rank"
        " FROM provinces QUALIFY rank() OVER (ORDER BY revenue_vnd DESC) <= 5"
    ),
    "category_matrix": _lineitem(
        "SELECT province, "
        + ", ".join(
            f"CAST(sum(CAST(round(revenue_vnd * 100) AS BIGINT)) FILTER (WHERE category = '{c}')"
            f' AS DOUBLE) / 100 AS "{c}"'
            for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
        )
        + " FROM daily GROUP BY province"
    ),
    "outlook_series": _lineitem(
        "SELECT order_date AS date, revenue_vnd, 'history' AS kind FROM history UNION ALL "
        "SELECT CAST(forecast_date AS DATE), forecast_revenue_vnd, 'forecast' FROM forecast"
    ),
    "bucketed_changed_events": _changed(
        "event_id", ", candidates AS (SELECT * FROM arrived)", _RECENCY, "* EXCLUDE (fresh)"
    ),
    "bucketed_changed_orders": _changed(
        "order_id",
        f""",
resolved AS (
  SELECT * FROM arrived
  QUALIFY row_number() OVER (PARTITION BY fresh, event_id ORDER BY {_RECENCY}) = 1),
candidates AS (
  SELECT * FROM resolved
  WHERE CASE WHEN quantity <= 0 THEN 1 WHEN unit_price_vnd <= 0 THEN 1 WHEN NOT ({_LISTED_PROV}) THEN 1
             WHEN event_type NOT IN ('created', 'updated', 'cancelled') THEN 1 END IS NULL)""",
        "event_ts DESC, ingest_ts DESC, event_id DESC",
        "* EXCLUDE (fresh), CAST(event_ts AS DATE) AS order_date, quantity * unit_price_vnd AS revenue_vnd",
    ),
    "payload_roundtrip": _activity("SELECT * FROM bronze"),
    "multi_source_bronze": (
        f"WITH {LINEITEM.replace('bronze AS', 'files AS')}, {ACTIVITY}"
        " SELECT *, 'lineitem' AS source_file, CAST(NULL AS VARCHAR) AS kafka_topic,"
        " CAST(event_ts AS DATE) AS event_date FROM files UNION ALL BY NAME"
        " SELECT *, CAST(NULL AS VARCHAR) AS source_file, 'events' AS kafka_topic,"
        " CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "activity_daily_sales": _activity("SELECT * FROM daily"),
    "activity_forecast": _activity("SELECT * FROM forecast"),
    "stream_landed_events": _activity(
        "SELECT *, CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "stream_restarted_events": _activity(
        "SELECT *, CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "stream_landed_sources": _activity(
        "SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS directory,"
        " CAST(event_ts AS DATE) AS event_date, count(*) AS events FROM bronze GROUP BY 2"
    ),
    "stream_landed_records": _activity(
        "SELECT *, 'events' AS kafka_topic, CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "replayed_daily_sales": _activity("SELECT * FROM daily"),
    "stream_landing_metrics": _activity(
        "SELECT 'first' AS drain, CAST(0 AS BIGINT) AS rows_before, count(*) AS rows_after,"
        " count(*) AS rows_landed, count(*) AS input_rows FROM bronze UNION ALL "
        "SELECT 'rerun', count(*), count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM bronze"
    ),
    "stream_deduplicated_events": _activity(
        "SELECT DISTINCT *, CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "stream_archived_events": _activity(
        "SELECT *, CAST(event_ts AS DATE) AS event_date FROM bronze"
    ),
    "stream_progress_batches": _activity(
        "SELECT count(*) AS input_rows, TRUE AS each_batch_once FROM bronze"
    ),
    "stream_velocity_preview": _SOLD
    + "SELECT date_trunc('hour', event_ts) AS sales_hour, province, count(*) AS events,"
    " CAST(sum(cents) AS DOUBLE) / 100 AS revenue_per_hour_vnd, TRUE AS approximate"
    " FROM in_time GROUP BY 1, 2",
    "stream_late_rows": _SOLD
    + "SELECT (SELECT count(*) FROM in_time) AS taken,"
    " (SELECT count(*) FROM sold) - (SELECT count(*) FROM in_time) AS late",
    "stream_distinct_orders": _SOLD
    + "SELECT CAST(event_ts AS DATE) AS day, count(DISTINCT order_id) AS orders, TRUE AS within_bound"
    " FROM sold GROUP BY ROLLUP (CAST(event_ts AS DATE))",
    "incremental_refresh_marts": _activity("SELECT * FROM daily"),
    "many_digit_sales": _MANY_DIGITS,
    "incremental_many_digit_sales": _MANY_DIGITS,
    "incremental_rejected_events": _activity(
        "SELECT * FROM classified WHERE rejection_reason IS NOT NULL"
    ),
    "incremental_quality_report": _activity(
        "SELECT 'PASS' AS status, 'fixture-stream' AS profile,"
        f" * EXCLUDE (surplus_copies) FROM ({_COUNTS})"
    ),
    "incremental_release_gates": _activity(_GATES),
    "incremental_published_sales": _activity("SELECT * FROM daily"),
    "incremental_sales_velocity": _activity("SELECT * FROM velocity"),
    "incremental_sales_forecast": _activity("SELECT * FROM forecast"),
    "incremental_order_state": _activity("SELECT * FROM state"),
    "curated_clean_events": _activity(
        "SELECT *, CAST(event_ts AS DATE) AS event_date FROM accepted"
    ),
    "curated_order_state": _activity("SELECT *, CAST(event_ts AS DATE) AS event_date FROM state"),
    "curated_daily_sales": _activity("SELECT * FROM daily"),
    "curated_province_sales": _activity("SELECT * FROM provinces"),
    "curated_sales_velocity": _activity("SELECT * FROM velocity"),
    "curated_sales_forecast": _activity("SELECT * FROM forecast"),
    "exported_daily_sales": _activity("SELECT * FROM daily"),
    "exported_province_sales": _activity("SELECT * FROM provinces"),
    "exported_sales_forecast": _activity("SELECT * FROM forecast"),
    "missing_field_violations": f"WITH {_GAPPY}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS field, count(*) FILTER (WHERE {name} IS NULL) AS null_rows FROM bronze"
        for name in _EVENT_COLUMNS
    ),
    "quarantined_missing_events": (
        f"WITH {_GAPPY.replace('bronze AS', 'gappy AS')},"
        f" bronze AS (SELECT * FROM gappy WHERE {_COMPLETE}){_chain(_LISTED_PROV)}"
        " SELECT *, CAST(event_ts AS DATE) AS event_date FROM classified"
        " WHERE rejection_reason IS NOT NULL UNION ALL"
        " SELECT *, 'missing_required_field', CAST(event_ts AS DATE) FROM gappy"
        f" WHERE NOT ({_COMPLETE})"
    ),
    "curated_rejected_events": _activity(
        "SELECT *, CAST(event_ts AS DATE) AS event_date FROM classified"
        " WHERE rejection_reason IS NOT NULL"
    ),
    "failed_quality_report": f"""WITH {_GAPPY}{_chain(_LISTED_PROV)}
SELECT 'FAIL' AS status, g.*, c."current", c.deduplicated FROM ({_GATES}) g, ({_COUNTS}) c""",
    "exported_sales_velocity": _activity("SELECT * FROM velocity"),
    "quality_report": _activity(
        "SELECT 'PASS' AS status, 'fixture-stream' AS profile, bronze AS rows_landed,"
        f" * EXCLUDE (surplus_copies) FROM ({_COUNTS})"
    ),
}
