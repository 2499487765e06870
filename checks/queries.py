"""One query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.contract import EVENT_COLUMNS
from ordertide.functions.payload import decode_payload, encode_payload
from ordertide.operators import forecast as fc
from ordertide.operators import marts, measures, quality, reconcile, resolve
from ordertide.plans import mapping
from ordertide.plans.bucketed import changed_orders, changed_winners, write_bucketed
from ordertide.plans.curate import (
    GateFailure,
    curate_and_publish,
    exported_path,
    open_table,
    read_reports,
)
from ordertide.plans.layout import Layout
from ordertide.plans.mapping import ACTIVITY_CONTRACT, LINEITEM_CONTRACT
from ordertide.plans.settings import at_once, scratch_path
from ordertide.sinks.files import write_event_files
from ordertide.sources.files import (
    RAW,
    read_bronze,
    read_province_dimension,
    stream_event_files,
    union_bronze,
)
from ordertide.sources.kafka import records_to_bronze
from ordertide.streaming.incremental import IncrementalMarts
from ordertide.streaming.landing import drain, land_file_stream, start_bronze_append
from ordertide.streaming.progress import read_progress, recorded_progress
from ordertide.streaming.velocity import (
    STANDARD_ERROR,
    late_rows,
    merged_orders,
    preview_name,
    read_hours,
    start_velocity_preview,
    velocity_preview,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name; dates and hours are UTC in all of them."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


# --- resolution and quality -------------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = resolve.dedup_latest_event(mapping.lineitem_events(spark, sf_dir))
    return quality.classify_events(events, LINEITEM_CONTRACT)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.current_order_state(quality.accepted_events(_classified(spark, sf_dir)))


@query
def bronze_events(spark, sf_dir):
    events = mapping.lineitem_events(spark, sf_dir)
    return events.withColumn("event_date", F.to_date("event_ts"))


@query
def dedup_latest_event(spark, sf_dir):
    return resolve.dedup_latest_event(mapping.lineitem_events(spark, sf_dir))


@query
def classify_events(spark, sf_dir):
    return _classified(spark, sf_dir)


@query
def classify_against_table(spark, sf_dir):
    nations = mapping.nation_dimension(spark, sf_dir).filter("province <> 'NATION_24'")
    events = resolve.dedup_latest_event(mapping.lineitem_events(spark, sf_dir))
    return quality.classify_against_tables(events, LINEITEM_CONTRACT, nations.select("province"))


@query
def clean_events(spark, sf_dir):
    return quality.accepted_events(_classified(spark, sf_dir))


@query
def rejected_events(spark, sf_dir):
    return quality.rejected_events(_classified(spark, sf_dir))


@query
def rejections_by_reason(spark, sf_dir):
    return quality.rejections_by_reason(quality.rejected_events(_classified(spark, sf_dir)))


@query
def required_field_violations(spark, sf_dir):
    return quality.required_field_violations(mapping.lineitem_events(spark, sf_dir))


@query
def duplicate_event_ids(spark, sf_dir):
    return quality.repeated_event_ids(mapping.lineitem_events(spark, sf_dir))


@query
def event_id_uniqueness(spark, sf_dir):
    events = mapping.lineitem_events(spark, sf_dir)
    resolved = resolve.dedup_latest_event(events)
    return reconcile.one_row(
        reconcile.row_count(quality.repeated_event_ids(events), "repeated_in_bronze"),
        reconcile.row_count(quality.repeated_event_ids(resolved), "repeated_when_resolved"),
    )


@query
def current_order_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query
def active_orders(spark, sf_dir):
    return resolve.active_orders(_state(spark, sf_dir))


@query
def cancelled_orders(spark, sf_dir):
    return resolve.cancelled_orders(_state(spark, sf_dir))


# --- marts and forecast -----------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per active order: what a single mart aggregates directly."""
    return marts.order_cells(resolve.active_orders(_state(spark, sf_dir)))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.daily_sales(_cells(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return fc.dense_daily_series(fc.daily_revenue(_daily(spark, sf_dir), by), by)


@query
def daily_sales(spark, sf_dir):
    return _daily(spark, sf_dir).orderBy("order_date", "province", "category")


@query
def province_sales(spark, sf_dir):
    return marts.province_sales(_cells(spark, sf_dir)).orderBy("province")


@query
def sales_velocity(spark, sf_dir):
    return marts.sales_velocity(_cells(spark, sf_dir)).orderBy("sales_hour", "province")


@query
def daily_revenue_series(spark, sf_dir):
    return fc.daily_revenue(_daily(spark, sf_dir)).orderBy("order_date")


@query
def series_bounds(spark, sf_dir):
    return fc.series_bounds(fc.daily_revenue(_daily(spark, sf_dir)))


@query
def dense_daily_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query
def dense_daily_series_by_province(spark, sf_dir):
    return _series(spark, sf_dir, "province")


def _rounded_trend(trend: DataFrame, *by: str) -> DataFrame:
    """Trend parameters without the float noise that depends on the order of addition."""
    return trend.select(
        *by,
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 3).alias("intercept"),
        F.round("mean_revenue", 3).alias("mean_revenue"),
        "training_days",
        "last_date",
    )


@query
def trend_fit(spark, sf_dir):
    return _rounded_trend(fc.fit_trend(_series(spark, sf_dir)))


@query
def trend_fit_by_province(spark, sf_dir):
    series = _series(spark, sf_dir, "province")
    return _rounded_trend(fc.fit_trend(series, ["province"]), "province")


@query
def weekday_factors(spark, sf_dir):
    factors = fc.weekday_factors(fc.fit_trend(_series(spark, sf_dir)))
    return factors.withColumn("factor", F.round("factor", 9))


@query
def sales_forecast(spark, sf_dir):
    return fc.sales_forecast(_daily(spark, sf_dir))


@query
def sales_forecast_by_province(spark, sf_dir):
    return fc.sales_forecast(_daily(spark, sf_dir), by=["province"])


def _moments(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Moments of the daily mart, taken batch by batch (a category each) and added up."""
    batches = fc.series_moments(_daily(spark, sf_dir), [*by, "category"])
    return fc.merge_moments(batches, by)


@query
def trend_fit_from_moments(spark, sf_dir):
    return _rounded_trend(fc.fit_moments(_moments(spark, sf_dir)))


@query
def weekday_factors_from_moments(spark, sf_dir):
    factors = fc.weekday_factors(fc.fit_moments(_moments(spark, sf_dir)))
    return factors.withColumn("factor", F.round("factor", 9))


@query
def sales_forecast_from_moments(spark, sf_dir):
    fitted = fc.fit_moments(_moments(spark, sf_dir, "province"), ["province"])
    return fc.project_trend(fitted, by=["province"])


# --- reconciliation ---------------------------------------------------------------------------


def _quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table is counted while it is written and read from there, as in a curation run."""
    root = scratch_path(spark, "counts")
    numbers: dict = {}

    def stage(frame: DataFrame, table: str, columns: list) -> DataFrame:
        stored, found = reconcile.observed_write(frame, f"{root}/{table}", columns)
        numbers.update(found)
        return stored

    events = mapping.lineitem_events(spark, sf_dir)
    bronze = stage(events, "bronze", reconcile.row_columns("bronze"))
    resolved = quality.classify_events(resolve.dedup_counting_copies(bronze), LINEITEM_CONTRACT)
    classified = stage(resolved, "classified", reconcile.classification_columns())
    state = resolve.current_order_state(quality.accepted_events(classified))
    state = stage(state, "state", reconcile.state_columns())
    cells = stage(
        marts.sales_cells(resolve.active_orders(state)), "cells", reconcile.revenue_columns()
    )
    daily, _, _ = at_once(
        spark,
        *(
            partial(stage, mart(cells), table, reconcile.row_columns(table))
            for table, mart in (
                ("daily_sales", marts.daily_sales),
                ("province_sales", marts.province_sales),
                ("sales_velocity", marts.sales_velocity),
            )
        ),
    )
    stage(fc.sales_forecast(daily), "forecast", reconcile.row_columns("forecast_rows"))
    return reconcile.counts_of(spark, numbers)


@query
def quality_counts(spark, sf_dir):
    counts = _quality_counts(spark, sf_dir)
    return counts.withColumn("revenue_vnd", F.round("revenue_vnd", 2))


@query
def release_gates(spark, sf_dir):
    return reconcile.release_gates(_quality_counts(spark, sf_dir))


# --- dashboard --------------------------------------------------------------------------------


@query
def measures_total(spark, sf_dir):
    return measures.measures(_daily(spark, sf_dir))


@query
def measures_by_category(spark, sf_dir):
    return measures.measures(_daily(spark, sf_dir), "category")


@query
def measures_sliced(spark, sf_dir):
    """Page 1 with its slicers set: two categories, all provinces."""
    sliced = measures.slice_mart(_daily(spark, sf_dir), categories=["ECONOMY", "PROMO"])
    return measures.measures(sliced, "order_date")


@query
def measures_cube(spark, sf_dir):
    return measures.measures_cube(_daily(spark, sf_dir), "province", "category")


@query
def province_geo(spark, sf_dir):
    mart = marts.province_sales(_cells(spark, sf_dir))
    return measures.with_geography(mart, mapping.nation_dimension(spark, sf_dir))


@query
def daily_sales_geo(spark, sf_dir):
    return measures.with_geography(
        _daily(spark, sf_dir), mapping.nation_dimension(spark, sf_dir)
    )


@query
def province_map(spark, sf_dir):
    """Province sales on a coordinates dimension read from CSV (derived from the nation keys)."""
    nation = mapping.read_table(spark, sf_dir, "nation")
    coordinates = nation.select(
        F.col("n_name").alias("province"),
        (F.col("n_nationkey") / 2).alias("latitude"),
        (100 + F.col("n_regionkey") * 1.5).alias("longitude"),
    )
    path = scratch_path(spark, "dimension")
    coordinates.write.option("header", "true").csv(path)
    mart = marts.province_sales(_cells(spark, sf_dir))
    return measures.with_geography(mart, read_province_dimension(spark, path))


@query
def ranked_provinces(spark, sf_dir):
    return measures.ranked_provinces(marts.province_sales(_cells(spark, sf_dir)))


@query
def top_provinces(spark, sf_dir):
    return measures.ranked_provinces(marts.province_sales(_cells(spark, sf_dir)), top=5)


@query
def category_matrix(spark, sf_dir):
    return measures.category_matrix(_daily(spark, sf_dir), LINEITEM_CONTRACT.categories)


@query
def outlook_series(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    return measures.outlook_series(fc.daily_revenue(daily), fc.sales_forecast(daily))


# --- history in buckets -----------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of the first and of the second half of the month of arrival."""
    events = mapping.activity_events(spark, sf_dir)
    first = F.dayofmonth("ingest_ts") <= 15
    return events.filter(first), events.filter(~first)


def _bucketed(frame: DataFrame, key: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, "buckets")
    return write_bucketed(frame, path.rpartition("/")[2].replace("-", "_"), path, key, 8)


@query
def bucketed_changed_events(spark, sf_dir):
    """Winners that the second half changes, resolved against a bucketed first half."""
    before, after = _halves(spark, sf_dir)
    return changed_winners(_bucketed(resolve.dedup_latest_event(before), "event_id"), after)


@query
def bucketed_changed_orders(spark, sf_dir):
    def accepted(events: DataFrame) -> DataFrame:
        resolved = resolve.dedup_latest_event(events)
        return quality.accepted_events(quality.classify_events(resolved, ACTIVITY_CONTRACT))

    before, after = _halves(spark, sf_dir)
    state = _bucketed(resolve.current_order_state(accepted(before)), "order_id")
    return changed_orders(state, accepted(after))


# --- payload and several sources --------------------------------------------------------------


@query
def payload_roundtrip(spark, sf_dir):
    """Every event encoded as a record value (bytes) and decoded again."""
    records = encode_payload(mapping.activity_events(spark, sf_dir))
    return decode_payload(records.withColumn("value", F.col("value").cast("binary")))


@query
def multi_source_bronze(spark, sf_dir):
    """Two sources with their own provenance columns in one bronze frame."""
    files = mapping.lineitem_events(spark, sf_dir).withColumns(
        {"source_file": F.lit("lineitem"), "event_date": F.to_date("event_ts")}
    )
    topic = mapping.activity_events(spark, sf_dir).withColumns(
        {"kafka_topic": F.lit("events"), "event_date": F.to_date("event_ts")}
    )
    return union_bronze(files, topic)


# --- the events table as a second data set ----------------------------------------------------


def _activity_cells(
    spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame] = lambda e: e
) -> DataFrame:
    events = resolve.dedup_latest_event(change(mapping.activity_events(spark, sf_dir)))
    accepted = quality.accepted_events(quality.classify_events(events, ACTIVITY_CONTRACT))
    return marts.order_cells(resolve.active_orders(resolve.current_order_state(accepted)))


@query
def activity_daily_sales(spark, sf_dir):
    return marts.daily_sales(_activity_cells(spark, sf_dir))


def _many_digits(events: DataFrame) -> DataFrame:
    """The same events with prices of up to 17 digits."""
    return events.withColumn("unit_price_vnd", F.col("unit_price_vnd") / 7)


@query
def many_digit_sales(spark, sf_dir):
    """Prices that no decimal of a fixed scale holds."""
    return marts.province_sales(_activity_cells(spark, sf_dir, _many_digits))


@query
def activity_forecast(spark, sf_dir):
    return fc.sales_forecast(marts.daily_sales(_activity_cells(spark, sf_dir)))


# --- streams and the full run -----------------------------------------------------------------


def _incoming(
    spark: SparkSession,
    sf_dir: str,
    files: int | None = None,
    change: Callable[[DataFrame], DataFrame] = lambda e: e,
) -> tuple[str, str]:
    """The events table as JSON lines under a new scratch path, ``files`` per date; returns (incoming, root)."""
    root = scratch_path(spark, "run")
    events = change(mapping.activity_events(spark, sf_dir))
    if files is not None:  # by as many tasks as the session has partitions
        events = events.repartition(F.to_date("event_ts"), F.pmod(F.xxhash64(*EVENT_COLUMNS), F.lit(files)))
    write_event_files(events, f"{root}/incoming")
    return f"{root}/incoming", root


@query
def stream_landed_events(spark, sf_dir):
    incoming, root = _incoming(spark, sf_dir)
    land_file_stream(spark, incoming, root)
    return read_bronze(spark, Layout(root).bronze_sources).drop("source_file", RAW)


@query
def stream_landed_sources(spark, sf_dir):
    """Events by the directory of the file that each came from; files are written one per date."""
    incoming, root = _incoming(spark, sf_dir)
    land_file_stream(spark, incoming, root)
    directory = F.regexp_extract("source_file", r"event_date=([0-9-]+)/[^/]+\.json$", 1)
    bronze = read_bronze(spark, Layout(root).bronze_sources)
    return bronze.groupBy(directory.alias("directory"), "event_date").agg(
        F.count("*").alias("events")
    )


@query
def stream_restarted_events(spark, sf_dir):
    """Landed in two runs of one checkpoint, with files that arrive in between."""
    root = scratch_path(spark, "run")
    events = mapping.activity_events(spark, sf_dir)
    first = F.dayofmonth("event_ts") <= 15
    for part in (first, ~first):
        write_event_files(events.filter(part), f"{root}/incoming")
        land_file_stream(spark, f"{root}/incoming", root, max_files_per_trigger=7)
    return read_bronze(spark, Layout(root).bronze_sources).drop("source_file", RAW)


@query
def stream_landed_records(spark, sf_dir):
    """Record payloads through the topic landing; text files stand in for the topic."""
    root = scratch_path(spark, "run")
    encode_payload(mapping.activity_events(spark, sf_dir)).select("value").write.text(
        f"{root}/topic"
    )
    records = (
        spark.readStream.schema("value string")
        .text(f"{root}/topic")
        .select(
            F.col("value").cast("binary").alias("value"),
            F.lit("events").alias("topic"),
            F.lit(0).alias("partition"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    layout = Layout(root)
    landing = start_bronze_append(
        records_to_bronze(records),
        layout.kafka_bronze,
        layout.checkpoint("kafka_orders_to_bronze"),
        {"availableNow": True},
    )
    drain(landing)
    bronze = read_bronze(spark, layout.bronze_sources)
    return bronze.drop("kafka_partition", "kafka_offset", RAW)


@query
def replayed_daily_sales(spark, sf_dir):
    """Every event delivered twice: the daily mart is that of one delivery."""
    incoming, root = _incoming(spark, sf_dir)
    write_event_files(mapping.activity_events(spark, sf_dir), incoming)
    land_file_stream(spark, incoming, root, files_per_date=2)
    events = resolve.dedup_latest_event(read_bronze(spark, Layout(root).bronze_sources))
    accepted = quality.accepted_events(quality.classify_events(events, ACTIVITY_CONTRACT))
    state = resolve.current_order_state(accepted)
    return marts.daily_sales(marts.order_cells(resolve.active_orders(state)))


@query
def stream_landing_metrics(spark, sf_dir):
    """First drain in several micro-batches, then a rerun that finds nothing new."""
    incoming, root = _incoming(spark, sf_dir)
    names = ("rows_before", "rows_after", "rows_landed", "input_rows")
    rows = []
    for run in ("first", "rerun"):
        result = land_file_stream(
            spark, incoming, root, max_files_per_trigger=10, count_bronze=True
        )
        rows.append((run, *(result[name] for name in names)))
    return spark.createDataFrame(
        rows, "drain string, " + ", ".join(f"{name} bigint" for name in names)
    )


@query
def stream_deduplicated_events(spark, sf_dir):
    """Every file delivered twice: exact copies stop before bronze."""
    incoming, root = _incoming(spark, sf_dir)
    write_event_files(mapping.activity_events(spark, sf_dir), incoming)
    land_file_stream(spark, incoming, root, max_files_per_trigger=20, replays_within="30 days")
    return read_bronze(spark, Layout(root).bronze_sources).drop("source_file", RAW)


@query
def stream_archived_events(spark, sf_dir):
    """Landed in two runs; files of the first are moved away while the second lands the others."""
    root = scratch_path(spark, "run")
    events = mapping.activity_events(spark, sf_dir)
    first = F.dayofmonth("event_ts") <= 15
    for part in (first, ~first):
        write_event_files(events.filter(part), f"{root}/incoming")
        land_file_stream(spark, f"{root}/incoming", root, archive=f"{root}/archive")
    return read_bronze(spark, Layout(root).bronze_sources).drop("source_file", RAW)


@query
def stream_progress_batches(spark, sf_dir):
    """The table of all batches of two drains: no batch is missing or counted twice."""
    incoming, root = _incoming(spark, sf_dir)
    for _ in range(2):
        land_file_stream(spark, incoming, root, max_files_per_trigger=10, metrics=f"{root}/progress")
    batches = read_progress(spark, f"{root}/progress")
    once = F.max("batch_id") + 1 == F.count("*")
    return batches.agg(F.sum("input_rows").alias("input_rows"), once.alias("each_batch_once"))


def _previewed(
    spark: SparkSession, sf_dir: str, late: str, parts: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Hours of the velocity preview and its progress; ``parts`` of the events arrive one after the other."""
    root = scratch_path(spark, "preview")
    hours = f"{root}/hours"
    for part in parts:
        write_event_files(mapping.activity_events(spark, sf_dir).filter(part), f"{root}/incoming")
        with recorded_progress(spark, f"{root}/progress", [preview_name(hours)]):
            events = stream_event_files(spark, f"{root}/incoming")
            drain(
                start_velocity_preview(
                    events, hours, f"{root}/checkpoint", late, ACTIVITY_CONTRACT, {"availableNow": True}
                )
            )
    return read_hours(spark, hours), read_progress(spark, f"{root}/progress")


def _half_late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of odd number arrive after the watermark of the others has moved on."""
    even = F.substring("order_id", 2, 20).cast("int") % 2 == 0
    return _previewed(spark, sf_dir, "10 days", [even, ~even])


@query
def stream_velocity_preview(spark, sf_dir):
    hours, _ = _half_late(spark, sf_dir)
    return velocity_preview(hours).drop("orders_per_hour")


@query
def stream_late_rows(spark, sf_dir):
    hours, progress = _half_late(spark, sf_dir)
    late = late_rows(hours, progress)
    taken = F.sum("events").alias("taken")
    return hours.agg(taken).withColumn("late", F.lit(late).cast("long"))


@query
def stream_distinct_orders(spark, sf_dir):
    """Distinct orders per day and in all, from hourly sketches: whether they are within three standard errors."""
    hours, _ = _previewed(spark, sf_dir, "60 days", [F.lit(True)])
    day = F.to_date("sales_hour").alias("day")
    days = merged_orders(hours, day)
    total = merged_orders(days).withColumn("day", F.lit(None).cast("date"))
    estimates = days.unionByName(total).select("day", F.col("orders").alias("estimate"))
    events = mapping.activity_events(spark, sf_dir)
    accepted = quality.accepted_events(quality.classify_events(events, ACTIVITY_CONTRACT))
    sold = resolve.active_orders(accepted).withColumn("day", F.to_date("event_ts"))
    exact = sold.rollup("day").agg(F.countDistinct("order_id").alias("orders")).alias("x")
    pairs = exact.join(estimates.alias("e"), F.col("x.day").eqNullSafe(F.col("e.day")), "left")
    bound = F.abs(F.col("estimate") - F.col("orders")) <= 3 * STANDARD_ERROR * F.col("orders")
    return pairs.select("x.day", "orders", bound.alias("within_bound"))


def _refreshed(
    spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame] = lambda e: e
) -> IncrementalMarts:
    """The events table through the incremental marts, in several micro-batches."""
    incoming, root = _incoming(spark, sf_dir, files=4, change=change)
    target = IncrementalMarts(spark, root, ACTIVITY_CONTRACT)
    target.refresh(stream_event_files(spark, incoming, max_files_per_trigger=64))
    return target


@query
def incremental_refresh_marts(spark, sf_dir):
    return _refreshed(spark, sf_dir).daily_sales()


@query
def incremental_many_digit_sales(spark, sf_dir):
    return _refreshed(spark, sf_dir, _many_digits).province_sales()


@query
def incremental_rejected_events(spark, sf_dir):
    return _refreshed(spark, sf_dir).rejected_events()


def _published(spark: SparkSession, sf_dir: str) -> str:
    """Root of a run published from the keyed state."""
    target = _refreshed(spark, sf_dir)
    target.publish(target.root)
    return target.root


@query
def incremental_quality_report(spark, sf_dir):
    report = read_reports(spark, _published(spark, sf_dir))
    return report.select("status", "profile", "events.*", "orders.*", "gold.*").withColumn(
        "revenue_vnd", F.round("revenue_vnd", 2)
    )


@query
def incremental_release_gates(spark, sf_dir):
    return read_reports(spark, _published(spark, sf_dir)).select("assertions.*")


@query
def incremental_published_sales(spark, sf_dir):
    return open_table(spark, _published(spark, sf_dir), "daily_sales")


@query
def incremental_sales_velocity(spark, sf_dir):
    return _refreshed(spark, sf_dir).sales_velocity()


@query
def incremental_sales_forecast(spark, sf_dir):
    return _refreshed(spark, sf_dir).sales_forecast()


@query
def incremental_order_state(spark, sf_dir):
    return _refreshed(spark, sf_dir).order_state()


def _curated(
    spark: SparkSession,
    sf_dir: str,
    change: Callable[[DataFrame], DataFrame] = lambda e: e,
    **options,
) -> str:
    """Root of a full run over the events table."""
    incoming, root = _incoming(spark, sf_dir, change=change)
    landing = land_file_stream(spark, incoming, root)
    curate_and_publish(spark, root, contract=ACTIVITY_CONTRACT, stream=landing, **options)
    return root


def _stored(table: str) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = open_table(spark, _curated(spark, sf_dir), table)
        return stored.drop("source_file", RAW)

    return read


def _exported(table: str, columns: str) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = exported_path(spark, _curated(spark, sf_dir), table)
        return spark.read.schema(columns).option("header", "true").csv(path)

    return read


_SALES = "orders bigint, units bigint, revenue_vnd double, average_order_value_vnd double"
_EXPORTS = {
    "daily_sales": f"order_date date, province string, category string, {_SALES}",
    "province_sales": f"province string, {_SALES}",
    "sales_velocity": "sales_hour timestamp, province string, orders_per_hour bigint,"
    " revenue_per_hour_vnd double",
    "sales_forecast": "forecast_date string, forecast_revenue_vnd double, model string,"
    " training_days bigint",
}
for _name, _table in {
    "curated_clean_events": "order_events_clean",
    "curated_rejected_events": "order_events_rejected",
    "curated_order_state": "current_order_state",
    "curated_daily_sales": "daily_sales",
    "curated_province_sales": "province_sales",
    "curated_sales_velocity": "sales_velocity",
    "curated_sales_forecast": "sales_forecast",
}.items():
    _read = _stored(_table)
    _read.__name__ = _name
    query(_read)
for _table, _columns in _EXPORTS.items():
    _read = _exported(_table, _columns)
    _read.__name__ = f"exported_{_table}"
    query(_read)


def _with_gaps(events: DataFrame) -> DataFrame:
    """The same events without some quantities, prices, types and ids."""
    number = F.regexp_extract("order_id", "[0-9]+", 0).cast("int")
    return events.withColumns(
        {
            "quantity": F.when(number % 11 != 0, F.col("quantity")),
            "unit_price_vnd": F.when(number % 13 != 0, F.col("unit_price_vnd")),
            "event_type": F.when(number % 17 != 0, F.col("event_type")),
            "event_id": F.when(number % 19 != 0, F.col("event_id")),
        }
    )


@query
def missing_field_violations(spark, sf_dir):
    return quality.required_field_violations(_with_gaps(mapping.activity_events(spark, sf_dir)))


@query
def quarantined_missing_events(spark, sf_dir):
    """What a run rejects that quarantines incomplete occurrences: each of them, and broken rules."""
    root = _curated(spark, sf_dir, _with_gaps, quarantine_missing=True)
    return open_table(spark, root, "order_events_rejected").drop("source_file", RAW)


@query
def failed_quality_report(spark, sf_dir):
    """A run with orders of no event type: it leaves its report and is not published."""
    incoming, root = _incoming(spark, sf_dir, change=_with_gaps)
    land_file_stream(spark, incoming, root)
    try:
        curate_and_publish(spark, root, contract=ACTIVITY_CONTRACT)
    except GateFailure:
        report = read_reports(spark, root)
        return report.select("status", "assertions.*", "orders.current", "events.deduplicated")
    raise AssertionError("the gates must fail")


@query
def quality_report(spark, sf_dir):
    """The stored report of a full run, flattened, without its clock."""
    root = _curated(spark, sf_dir)
    revenue = F.round("gold.revenue_vnd", 2)
    return read_reports(spark, root).select(
        "status",
        "profile",
        *(F.col(f"events.{n}") for n in ("bronze", "deduplicated", "duplicates", "accepted")),
        "events.quarantined",
        "orders.current",
        "orders.active",
        "orders.cancelled",
        "gold.daily_sales",
        "gold.province_sales",
        "gold.sales_velocity",
        "gold.forecast_rows",
        revenue.alias("revenue_vnd"),
        "stream.rows_landed",
    )
